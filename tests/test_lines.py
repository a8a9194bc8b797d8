"""Streamlines through tiles against the same lines through one array."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyshear.operators import kernels, lines

SHAPE = (4, 14, 17)


def field(seed):
    rng = np.random.default_rng(seed)
    k, j, i = np.indices(SHAPE)
    u = 6 - 0.8 * (j - 6) + 0.3 * rng.normal(size=SHAPE)
    v = 2 + 0.8 * (i - 8) + 0.3 * rng.normal(size=SHAPE)
    w = 0.02 * (k - 1) + 0.01 * rng.normal(size=SHAPE)
    return np.stack([u, v, w])


def tables(spark):
    winds = [field(c) for c in range(2)]
    rows = [(c, *map(int, p), *[float(x[(n, *p)]) for n in range(3)]) for c, x in enumerate(winds) for p in np.ndindex(*SHAPE) if (p[1] * 7 + p[2]) % 23]
    for x in winds:
        for p in np.ndindex(*SHAPE):
            if not (p[1] * 7 + p[2]) % 23:
                x[(slice(None), *p)] = 0.0  # missing cells have no wind
    rng = np.random.default_rng(5)
    seeds = [(c, n, *map(float, (rng.uniform(-200, 1700), rng.uniform(0, 1300), rng.uniform(0, 300)))) for c in range(2) for n in range(12)]
    return winds, spark.createDataFrame(rows, "case int, k int, j int, i int, u double, v double, w double"), seeds, spark.createDataFrame(seeds, "case int, seed long, x double, y double, z double")


@pytest.mark.parametrize(("tile", "crowd"), [(5, 50_000), (3, 2)])
def test_tiles_give_the_lines_of_one_array(spark, tile, crowd):
    winds, cells, _, seeds = tables(spark)
    got = {}
    for r in lines.streamlines(seeds, cells, (0, 0, 0), (100, 100, 100), length=60.0, most=25, tile=tile, crowd=crowd).collect():
        got.setdefault((r["case"], r.seed), []).append((r.seq, r.x, r.y, r.z, r.speed))
    for case, x in enumerate(winds):
        cube = np.moveaxis(x, (1, 2, 3), (3, 2, 1))
        want = {}
        for r in kernels.streamlines(seeds.filter(F.col("case") == case).drop("case"), cube, (0, 0, 0), (100, 100, 100), length=60.0, most=25).collect():
            want.setdefault((case, r.seed), []).append((r.seq, r.x, r.y, r.z, r.speed))
        assert {k for k in got if k[0] == case} == set(want) and len(want) > 5
        for key, rows in want.items():
            assert [r[0] for r in sorted(got[key])] == [r[0] for r in sorted(rows)] == list(range(len(rows)))
            for a, b in zip(sorted(got[key]), sorted(rows), strict=True):
                assert a == pytest.approx(b, abs=2e-5)


def test_a_circle_closes(spark):
    n = 41
    rows = [(k, j, i, float(-(j - 20)), float(i - 20), 0.0) for k in range(3) for j in range(n) for i in range(n)]
    cells = spark.createDataFrame(rows, "k int, j int, i int, u double, v double, w double")
    seeds = spark.createDataFrame([(1, 28.0, 20.0, 1.0), (2, 20.0, 20.0, 1.0), (3, -5.0, 3.0, 1.0), (4, None, 1.0, 1.0)], "seed long, x double, y double, z double")
    got = lines.streamlines(seeds, cells, (0, 0, 0), (1, 1, 1), length=0.25, most=120, tile=9).collect()
    assert {r.seed for r in got} == {1} and len(got) == 240
    assert max(abs(math.hypot(r.x - 20, r.y - 20) - 8) for r in got) < 1e-3
    none = lines.streamlines(seeds.filter("false"), cells, (0, 0, 0), (1, 1, 1), tile=9)
    assert none.count() == lines.streamlines(seeds, cells.filter("false"), (0, 0, 0), (1, 1, 1), tile=9).count() == 0
