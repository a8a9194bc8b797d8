"""Readers of sweeps, features and shapes; files that can't be read are told apart, not fatal."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyshear.operators.match import nearest_within
from skyshear.operators.scan import parse_names

GATES = "path string, elevation double, ray int, azimuth double, gate int, value double, corrupt string"


#: Columns of Spark's binary files, which a stream of them must be told.
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, root: str, pattern: str, stream: int = 0) -> DataFrame:
    reader = spark.readStream.schema(_BINARY).option("maxFilesPerTrigger", stream) if stream else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def read_sweeps(spark: SparkSession, root: str, station: str = "*", time: str = "*", product: str = "*", layer: str = "*", code: str = "*", stream: int = 0) -> DataFrame:
    """Gates of all sweeps under ``root``, one .npz archive each: ``path, elevation, ray, azimuth, gate, value, corrupt``.

    The parts of a file's name may be patterns (``time="20260511*"``); files whose
    names don't match are left out as folders are listed, so none of them is
    opened. With ``stream`` the folder is a stream of at most so many files a
    batch: each file once, new ones as they arrive.

    An archive holds azimuth (degrees, a ray) and fields of (ray, gate), of which
    the first counts; its elevation stands in ``elevation``, else in ``params``,
    else it is 0. Values that aren't finite are null. A file that can't be read
    gives one row with the reason in ``corrupt``.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        azimuth = np.asarray(z["azimuth"], float)
                        name = next(n for n in z.files if z[n].ndim == 2)
                        value = np.asarray(z[name], float)
                        elevation = next((float(z[n].ravel()[0]) for n in ("elevation", "params") if n in z.files and z[n].size), 0.0)
                    ray, gate = (a.ravel() for a in np.indices(value.shape))
                    yield pd.DataFrame({"path": path, "elevation": elevation, "ray": ray, "azimuth": azimuth[ray], "gate": gate, "value": value.ravel(), "corrupt": None})
                except Exception as e:  # any damage to a file
                    yield pd.DataFrame([(path, None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=["path", "elevation", "ray", "azimuth", "gate", "value", "corrupt"])

    parts = (station, time, product, layer, code)
    name = "*" if set(parts) == {"*"} else "_".join(parts)
    out = _files(spark, root, f"{name}.npz", stream).mapInPandas(decode, GATES)
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return out.withColumn("value", F.when(finite, F.col("value")))


def volume(sweeps: DataFrame) -> DataFrame:
    """Sweeps of readable files with station, time, product and layer from their names, numbered by elevation within a volume."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    good = sweeps.filter("corrupt IS NULL").withColumn("name", name)
    order = good.select("name", "elevation").distinct()
    named = order.join(parse_names(order.select("name").distinct()), "name")
    number = F.expr("row_number() OVER (PARTITION BY station, ts ORDER BY elevation, name) - 1")
    return good.join(named.withColumn("sweep", number), ["name", "elevation"])


def nearest_features(features: DataFrame, wanted: DataFrame, tolerance: int = 600) -> DataFrame:
    """Detected rotations (``ts`` in seconds and any columns) of the product nearest to each wanted time ``t1``, within ``tolerance``."""
    times = features.select(F.col("ts").alias("t2")).distinct()
    near = nearest_within(wanted.select("t1").distinct(), times, tolerance).filter("t2 IS NOT NULL")
    return near.join(features, F.col("t2") == F.col("ts")).drop("t2")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Points of the longest part of every line or polygon in the shape files under ``root``: ``path, line, seq, lon, lat``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                at = 100
                while at + 12 <= len(raw):
                    number, words = struct.unpack(">ii", raw[at : at + 8])
                    body, at = raw[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
                    if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (3, 5, 13, 15, 23, 25):
                        continue
                    parts, points = struct.unpack("<ii", body[36:44])
                    starts = np.append(np.frombuffer(body, "<i4", parts, 44), points)
                    xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
                    n = int(np.argmax(np.diff(starts)))
                    own = xy[starts[n] : starts[n + 1]]
                    yield pd.DataFrame({"path": path, "line": number, "seq": np.arange(len(own)), "lon": own[:, 0], "lat": own[:, 1]})

    return _files(spark, root, "*.shp").mapInPandas(decode, "path string, line int, seq int, lon double, lat double")


def lines_in(points: DataFrame, box: tuple[float, float, float, float], keys: tuple[str, ...] = ("line",), x: str = "lon", y: str = "lat") -> DataFrame:
    """``points`` of the lines whose bounding boxes meet ``box`` (west, east, south, north); others are rejected as a whole."""
    west, east, south, north = box
    edge = points.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    kept = edge.filter((F.col("x1") >= west) & (F.col("x0") <= east) & (F.col("y1") >= south) & (F.col("y0") <= north))
    return points.join(kept.select(*keys), list(keys), "left_semi")


def baseline_set(cells: DataFrame, pattern: str, count: int = 6) -> DataFrame:
    """Cells of the stored cases whose names match ``pattern``: exactly ``count`` of them and all on one grid, else an error."""
    chosen = cells.filter(F.col("case_id").rlike(pattern))
    cases = chosen.groupBy("case_id").agg(F.count("*").alias("n"))
    places = chosen.groupBy("k", "j", "i").agg(F.count_distinct("case_id").alias("n"), F.count_distinct("x", "y", "z").alias("places"))
    n = cases.count()
    if n != count:
        raise ValueError(f"{n} cases match, {count} are needed")
    if not places.filter((F.col("n") != n) | (F.col("places") != 1)).isEmpty():
        raise ValueError("the cases aren't on one grid")
    return chosen
