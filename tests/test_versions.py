"""Tables are replaced in one step: readers see the old or the new version, whenever they look."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyshear.sources import versions


def total(spark, path):
    return versions.read_current(spark, path).agg(F.sum("id")).first()[0]


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, path)
    assert versions.publish(spark.range(5), path).count() == 5
    reader = versions.read_current(spark, path)  # opened before what follows
    name = versions.add_version(spark.range(100), path)
    assert total(spark, path) == 10  # written, and not named yet
    versions.point_to(spark, path, name)
    assert total(spark, path) == 4950
    assert reader.agg(F.sum("id")).first()[0] == 10  # its version is still there
    out = versions.enrich_current(spark, path, {"twice": F.col("id") * 2})
    assert out.columns == ["id", "twice"] and out.agg(F.sum("twice")).first()[0] == 9900
    assert versions.drop_old(spark, path) == 2 and total(spark, path) == 4950


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    versions.publish(spark.range(5), path)
    with pytest.raises(Exception, match="dies"):  # while it writes
        versions.publish(spark.range(9).select(F.raise_error(F.lit("it dies")).alias("id")), path)
    assert total(spark, path) == 10

    def dies(*_):
        raise RuntimeError("before the rename")

    monkeypatch.setattr(versions, "point_to", dies)
    with pytest.raises(RuntimeError):
        versions.publish(spark.range(9), path)
    monkeypatch.undo()
    assert total(spark, path) == 10
    versions.publish(spark.range(9), path)
    assert total(spark, path) == 36
    assert versions.drop_old(spark, path) >= 2 and total(spark, path) == 36
