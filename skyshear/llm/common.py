"""Helpers that the corpus operators share: tables, the shared folder, session settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyshear.sources.store import discard, shared_dir, stored

__all__ = ["WORD", "discard", "ranges", "shared_dir", "stored", "table", "text_of"]

#: Bytes of input, as Spark estimates it, in one range of a sorted table.
RANGE_BYTES = 128 << 20

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> F.Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def ranges(df: DataFrame, size: int = RANGE_BYTES) -> int:
    """Ranges to deal ``df`` into: spark.sql.shuffle.partitions, or more where these would pass ``size`` bytes each."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= 1 << 58:  # rows that aren't from files have no estimate
        estimate = 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimate // size))
