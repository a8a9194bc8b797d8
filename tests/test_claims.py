"""Matching on streams against the batch match."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyshear.operators import match
from skyshear.streaming.claims import claimed, claims

DAY = 1_767_225_600


def literal(first, second, tolerance):
    """One first time after the other claims its nearest second time, if that is free."""
    taken, out = set(), []
    for t1 in sorted(set(first)):
        t2 = min(sorted(set(second)), key=lambda t: (abs(t - t1), t))
        if abs(t2 - t1) <= tolerance and t2 not in taken:
            taken.add(t2)
            out.append((t1, t2, abs(t2 - t1)))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_claims_of_a_group(seed):
    rng = random.Random(seed)
    one, two = ([DAY + rng.randrange(2000) for _ in range(rng.randrange(1, 40))] for _ in range(2))
    a, b = np.unique(one), np.unique(two)
    assert sorted(claimed(a, b, b, 60)) == sorted(literal(one, two, 60))
    assert claimed(a[:0], b, b, 60) == claimed(a, b[:0], b[:0], 60) == []


def streamed(spark, folder, name, files, order):
    """Runs files as one batch each; returns the rows and the greatest number of groups held."""
    for n in order:
        spark.createDataFrame(files[n], "pair string, side int, sec long").withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    s = spark.readStream.schema("pair string, side int, sec long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = claims(s.filter("side = 1"), s.filter("side = 2"), 60, "5 minutes", ("pair",)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name).collect(), [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def test_stream_equals_batch(spark, tmp_path):
    """Three pairs over eight hours in files whose times overlap by minutes; a last file settles all; state doesn't grow with the stream."""
    rng = random.Random(5)
    rows = [(p, side, DAY + t) for p in "abc" for side in (1, 2) for t in (rng.randrange(8 * 3600) for _ in range(200))]
    rows += rows[:30]
    rows.sort(key=lambda r: r[2] + rng.randrange(120))
    cut = -(-len(rows) // 6)
    files = [rows[n : n + cut] for n in range(0, len(rows), cut)] + [[("z", 1, DAY + 90_000)]]
    got, held = streamed(spark, tmp_path, "claims_all", files, range(len(files)))
    want = [(p, *m) for p in "abc" for m in literal([r[2] for r in rows if r[:2] == (p, 1)], [r[2] for r in rows if r[:2] == (p, 2)], 60)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    for p in "abc":
        side = lambda n, p=p: spark.createDataFrame([(r[2],) for r in rows if r[:2] == (p, n)], f"t{n} long").distinct()
        assert sorted(tuple(r) for r in match.match_times(side(1), side(2), 60).collect()) == sorted(r[1:] for r in want if r[0] == p)
    assert max(held) <= 12 and held[-1] <= 1  # three pairs, at most a few stretches each, of some 24 that pass


def test_late_and_open_times(spark, tmp_path):
    """A row behind the watermark changes nothing; a time that isn't settled waits."""
    files = [[("a", 1, DAY + 50), ("a", 2, DAY), (None, 1, DAY), (None, 2, DAY + 5), ("a", 1, None)], [("a", 1, DAY + 4000)], [("a", 1, DAY + 4005)], [("a", 2, DAY + 49), ("a", 2, DAY + 4010)]]
    got, held = streamed(spark, tmp_path, "claims_late", files, range(4))
    assert sorted((tuple(r) for r in got), key=str) == sorted([("a", DAY + 50, DAY, 50), (None, DAY, DAY + 5, 5)], key=str) and held[-1] == 1
