"""Product files: names, discovery, Nyquist speeds, volumes, provenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyshear.model import NYQUIST_FALLBACK, PRODUCTS, STATIONS


def products(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(PRODUCTS), "code string, quantity string, resolution string"))


def stations(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(STATIONS), "station string, lat double, lon double, height_m double"))


def parse_names(files: DataFrame) -> DataFrame:
    """``name, station, ts, product, layer, code`` of names with four parts or more; others have nulls."""
    p = F.split("name", "_")
    ok = F.size(p) >= 4
    part = lambda i: F.when(ok, p[i])
    return files.select("name", part(0).alias("station"), part(1).alias("ts"), part(2).alias("product"), part(3).alias("layer"), F.when(F.size(p) >= 5, p[4]).alias("code"))


def discover(files: DataFrame, quantity: str, resolution: str) -> DataFrame:
    """Files of one quantity and resolution, without index files: codes of each (station, ts, layer)."""
    named = parse_names(files).filter((F.col("product") != "ProductIndex") & F.col("code").isNotNull())
    mapped = named.join(products(files.sparkSession), "code").filter((F.col("quantity") == quantity) & (F.col("resolution") == resolution))
    return mapped.groupBy("station", "ts", "layer").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count("*").alias("files"))


def stamps(files: DataFrame) -> DataFrame:
    """First and second time of a result's name: parts of 15 characters that end in Z; one counts twice."""
    found = F.filter(F.split("name", "_"), lambda x: (F.length(x) == 15) & x.endswith("Z"))
    return files.select("name", F.when(F.size(found) >= 1, found[0]).alias("ts1"), F.when(F.size(found) >= 2, found[1]).when(F.size(found) == 1, found[0]).alias("ts2"))


def nyquist(wanted: DataFrame, config: DataFrame) -> DataFrame:
    """``id, nyquist``: of scan settings (elev, speed) the fastest within 0.02 degrees of the nearest, if that is within 0.25; else the fallback.

    ``config`` is one volume's scan settings, tens of rows, so it is broadcast.
    """
    near = wanted.join(F.broadcast(config), F.abs(wanted["elevation"] - config["elev"]) <= 0.25 + 0.02, "left").withColumn("d", F.round(F.abs(F.col("elevation") - F.col("elev")), 6))
    least = near.withColumn("least", F.min("d").over(Window.partitionBy("id")))
    hit = (F.col("least") <= 0.25) & (F.col("d") <= F.round(F.col("least") + 0.02, 6)) & (F.col("speed") > 0)
    return least.groupBy("id").agg(F.coalesce(F.max(F.when(hit, F.col("speed"))), F.lit(NYQUIST_FALLBACK)).alias("nyquist"))


def volume_rays(gates: DataFrame) -> DataFrame:
    """Rays in order of elevation and azimuth: running index, values of as many gates as the radar's lowest sweep has (cut or padded with nulls)."""
    sweeps = gates.groupBy("radar", "sweep", "elevation").agg((F.max("gate") + 1).alias("n"))
    first = sweeps.groupBy("radar").agg(F.min_by("n", F.struct("elevation", "sweep")).alias("n_gates"))  # one row a radar
    cut = gates.join(F.broadcast(first), "radar")
    values = F.map_from_entries(F.collect_list(F.when(F.col("gate") < F.col("n_gates"), F.struct("gate", "vr"))))
    rays = cut.groupBy("radar", "sweep", "elevation", "ray", "n_gates").agg(values.alias("m"))
    at = F.row_number().over(Window.partitionBy("radar").orderBy("elevation", "sweep", "ray")) - 1
    return rays.select("radar", "sweep", "ray", at.alias("ray_idx"), F.transform(F.sequence(F.lit(0), F.col("n_gates") - 1), lambda g: F.try_element_at("m", g)).alias("values"))


def without_extremes(gates: DataFrame, speed: float = 100.0, dbz: tuple[float, float] = (-20.0, 80.0)) -> DataFrame:
    """Values that no weather has are null: radial velocities beyond ``speed``, reflectivities outside ``dbz``."""
    return gates.withColumns({"vr": F.when(F.abs("vr") <= speed, F.col("vr")), "dbz": F.when(F.col("dbz").between(*dbz), F.col("dbz"))})


def repeated_sweeps(sweeps: DataFrame) -> DataFrame:
    """How often each elevation (two decimals, half to even) occurs at its station."""
    w = Window.partitionBy("station", F.bround("elevation", 2))
    return sweeps.withColumn("same", F.count("*").over(w)).withColumn("repeated", F.col("same") > 1)


def gate_stats(gates: DataFrame, limit: float = 20.0) -> DataFrame:
    """Gates of each radar: all, present, and those that quality control keeps or masks."""
    present, kept = F.col("vr").isNotNull(), F.abs("vr") <= limit
    count = lambda c, name: F.count_if(c).alias(name)
    return gates.groupBy("radar").agg(F.count("*").alias("total"), count(present, "present"), count(kept, "passed"), count(present & ~kept, "masked"))


def byte_histogram(texts: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent bytes of all contents: a batch of texts is counted as one buffer and gives 256 rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            if len(column) and column.buffers()[2] is not None:
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                n += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], minlength=256)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([f"{b:02X}" for b in seen]), pa.array(n[seen])], ["byte", "n"])

    one = texts.select("text").mapInArrow(count, "byte string, n long")
    return one.groupBy("byte").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "byte").limit(top)


def provenance(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.sha2("text", 256).alias("sha256"))


def resolve_stations(wanted: DataFrame) -> DataFrame:
    """Registered place of each station, else what the file header says."""
    known = stations(wanted.sparkSession)
    joined = wanted.join(known, "station", "left")
    return joined.select("station", F.coalesce("lat", "header_lat").alias("lat"), F.coalesce("lon", "header_lon").alias("lon"), F.col("lat").isNotNull().alias("registered"))


def dem_tiles(domains: DataFrame) -> DataFrame:
    """Names of the one-degree tiles that cover each domain."""
    down, right = (F.explode(F.sequence(F.floor(f"{a}_min").cast("int"), (F.ceil(f"{a}_max") - 1).cast("int"))) for a in ("lat", "lon"))
    return domains.withColumn("la", down).withColumn("lo", right).select("id", F.format_string("N%02dE%03d", "la", "lo").alias("tile")).distinct()


def label_names(labels: DataFrame) -> DataFrame:
    """The part after the last bar, trimmed."""
    return labels.select("id", F.trim(F.element_at(F.split("name", r"\|"), -1)).alias("label"))
