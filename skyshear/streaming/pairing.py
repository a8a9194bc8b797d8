"""Scans as streams: pairing two radars' volumes as they arrive, and recent coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_streams(first: DataFrame, second: DataFrame, minutes: int = 2, late: str = "10 minutes") -> DataFrame:
    """Volumes of two radars (ts, and any other columns) at most ``minutes`` apart.

    Watermarks bound the state: a volume is dropped once none that may still
    arrive can match it. Emits all pairs; the greedy choice is a batch step, since
    a nearer volume may still come.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / (60 * minutes))
    a = first.withWatermark("ts", late).select(*[F.col(c).alias(f"{c}_1") for c in first.columns])
    a = a.withColumn("_b", F.explode(F.array(*[bucket("ts_1") + d for d in (-1, 0, 1)])))
    b = second.withWatermark("ts", late).select(*[F.col(c).alias(f"{c}_2") for c in second.columns]).withColumn("_c", bucket("ts_2"))
    reach = F.expr(f"INTERVAL {minutes} MINUTES")
    near = (F.col("_b") == F.col("_c")) & (F.col("ts_2") >= F.col("ts_1") - reach) & (F.col("ts_2") <= F.col("ts_1") + reach)
    return a.join(b, near).drop("_b", "_c")


def scan_rate(scans: DataFrame, window: str = "30 minutes", step: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Volumes of each station in sliding windows; late ones count until the watermark passes."""
    return scans.withWatermark("ts", late).groupBy(F.window("ts", window, step), "station").agg(F.count("*").alias("n")).select("window.start", "window.end", "station", "n")
