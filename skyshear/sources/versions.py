"""Stored tables that are replaced in one step.

A table's folder holds its versions side by side and a file that names the
current one. A writer adds a version and then renames a new pointer over the old
one, which is a single step; a reader resolves the pointer once and goes on with
that version. A writer that dies before the rename leaves only a version that
nothing names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the current version, or None before the first."""
    at, fs = _hadoop(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table; it stays readable while newer ones are published."""
    name = current_version(spark, path)
    if name is None:
        raise FileNotFoundError(f"{path} has no current version")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def add_version(df: DataFrame, path: str) -> str:
    """Writes a version that nothing names yet, and returns its name."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    return name


def point_to(spark: SparkSession, path: str, name: str) -> None:
    """Makes ``name`` the current version, by one rename over the pointer."""
    base = path.rstrip("/")
    new, fs = _hadoop(spark, f"{base}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    files.rename(fs.makeQualified(new), fs.makeQualified(_hadoop(spark, f"{base}/{POINTER}")[0]), over)


def publish(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the new current version of the table at ``path``; it may have been read from there."""
    point_to(df.sparkSession, path, add_version(df, path))
    return read_current(df.sparkSession, path)


def enrich_current(spark: SparkSession, path: str, columns: dict[str, Column]) -> DataFrame:
    """Adds ``columns`` (name to expression) to a table, as a new version of it."""
    return publish(read_current(spark, path).withColumns(columns), path)


def drop_old(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the current one, and pointers that never took its place; returns how many.

    Whoever still reads an older version loses it, so this is for when none does.
    """
    now, at_and_fs = current_version(spark, path), _hadoop(spark, path)
    dropped = 0
    for status in at_and_fs[1].listStatus(at_and_fs[0]):
        name = status.getPath().getName()
        if name != now and re.fullmatch(rf"v-[0-9a-f]{{32}}|\.{POINTER}-[0-9a-f]{{32}}", name):
            at_and_fs[1].delete(status.getPath(), True)
            dropped += 1
    return dropped
