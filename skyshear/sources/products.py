"""Readers and sinks: product folders, elevation tiles, results and their manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyshear.operators.scan import parse_names


def list_products(spark: SparkSession, root: str) -> DataFrame:
    """Path, size, time and name parts of all files under ``root``; contents aren't read unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select("path", "length", "modificationTime", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "").alias("name"))
    return named.join(parse_names(named.select("name").distinct()), "name")


def read_dem(spark: SparkSession, root: str, size: int = 1201) -> DataFrame:
    """Elevation of tile files N..E..: ``tile, row, col, lat, lon, elev_m, corrupt``; big-endian 16-bit rows from the north edge, -32768 and less is null.

    A tile that isn't of ``size`` rows and columns gives one row with the reason in ``corrupt``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "N*E*.hgt").load(root).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1][:7]
                if len(content) != 2 * size * size:
                    yield pd.DataFrame([(name, *[None] * 5, f"{len(content)} bytes, not {2 * size * size}")], columns=["tile", "row", "col", "lat", "lon", "elev_m", "corrupt"])
                    continue
                v = np.frombuffer(content, dtype=">i2").astype(float)
                v[v <= -32768] = np.nan
                row, col = np.divmod(np.arange(size * size), size)
                step = 1 / (size - 1)
                yield pd.DataFrame({"tile": name, "row": row, "col": col, "lat": int(name[1:3]) + 1 - row * step, "lon": int(name[4:7]) + col * step, "elev_m": v, "corrupt": None})

    out = files.mapInPandas(decode, "tile string, row int, col int, lat double, lon double, elev_m double, corrupt string")
    return out.withColumn("elev_m", F.nanvl("elev_m", F.lit(None).cast("double")))


def write_wind(wind: DataFrame, path: str, by: str = "case_id") -> None:
    """Results by case; writing some cases leaves the others as they are."""
    wind.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_wind(spark: SparkSession, path: str, columns: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """A stored wind field; fill values below -9000 are null, a missing dual mask falls back on defined vorticity."""
    df = spark.read.parquet(path)
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c) > -9000, F.col(c)))
    if "dual_doppler_mask" not in df.columns and "vorticity" in df.columns:
        df = df.withColumn("dual_doppler_mask", F.col("vorticity").isNotNull())
    return df


def write_grid(cells: DataFrame, path: str, by: str = "case_id") -> None:
    """Gridded fields by case in order of level, row and column, so a reader's filter on a level skips row groups."""
    cells.repartition(by).sortWithinPartitions(by, "k", "j", "i").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_diagnostics(df: DataFrame, path: str) -> None:
    """Diagnostics in small types: doubles as floats, truth values as bytes."""
    small = {"double": "float", "boolean": "tinyint"}
    df.select(*[F.col(c).cast(small.get(t, t)).alias(c) for c, t in df.dtypes]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def enrich(spark: SparkSession, path: str, columns: dict) -> DataFrame:
    """Adds ``columns`` (name to expression) to a stored table: the new one is written beside it and then takes its name."""
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    spark.read.parquet(path).withColumns(columns).write.mode("overwrite").parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
    return spark.read.parquet(path)


def append_records(*tables: DataFrame) -> DataFrame:
    """Records of unlike columns under one another, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row; numbers that aren't finite are null."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def still_to_do(wanted: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Cases that no finished entry of the manifest has with the same code and configuration."""
    return wanted.join(manifest.filter("finished").select(*keys).distinct(), keys, "left_anti")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that a table lacks."""
    return sorted(set(required) - set(df.columns))
