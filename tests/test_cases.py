"""First guess, filters and the variational wind: against plain arrays, in tiles, and case by case."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyshear.model import DX, DY, DZ
from skyshear.operators import grid, retrieval, variational, wind

KEY = ["k", "j", "i"]


def two_cases(spark, shape=((4, 13, 11), (3, 9, 14))):
    """Cells of two cases of different size, seen in part by both radars."""
    rng = np.random.default_rng(3)
    rows = []
    for case, (nk, nj, ni) in enumerate(shape):
        for k, j, i in np.ndindex(nk, nj, ni):
            seen = [float(v) if rng.random() < 0.8 else None for v in rng.normal(0, 8, 2)]
            rows.append((case, k, j, i, (i - 6) * DX, (j - 4) * DY, DZ * (k + 1), *seen))
    return spark.createDataFrame(rows, "case int, k int, j int, i int, x double, y double, z double, vr1 double, vr2 double")


def background(spark):
    return spark.range(5).select(F.col("id").cast("int").alias("k"), (4.0 + F.col("id")).alias("ub"), F.lit(-2.0).alias("vb"))


def given_of(cells):
    return wind.beams(cells).select(*[c for c in ("case",) if c in cells.columns], *KEY, "z", *[f"b{a}{n}" for n in (1, 2) for a in "xyz"], "vr1", "vr2", F.lit(5.0).alias("u0"), (F.col("k") * 1.0).alias("v0"))


def by_place(df, *columns):
    keys = [*[c for c in ("case",) if c in df.columns], *KEY]
    return {tuple(r[c] for c in keys): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("options", [{"most": 12, "change": 2.5, "check": 3}, {"most": 0}])
def test_tiles_take_the_same_steps(spark, options):
    cells = given_of(two_cases(spark))
    whole = by_place(variational.solve(cells, steps=(DX, DY, DZ), **options), "u", "v", "w", "iterations", "residual")
    tiled = by_place(variational.solve_tiled(cells, steps=(DX, DY, DZ), tile=4, **options), "u", "v", "w", "iterations", "residual")
    assert set(whole) == set(tiled) and len(whole) == cells.count()
    for place, values in whole.items():
        assert tiled[place][3] == values[3]
        assert tiled[place] == pytest.approx(values, abs=2e-4)
    if "change" in options:
        assert max(v[3] for v in whole.values()) < 12  # it ended by how far the wind moved


def test_small_and_large_cases_in_one_call(spark):
    cells = given_of(two_cases(spark, ((2, 5, 5), (3, 9, 8))))
    mixed = by_place(variational.wind_of(cells, steps=(DX, DY, DZ), most=3, task=60, tile=5), "u", "v", "w")
    whole = by_place(variational.solve(cells, steps=(DX, DY, DZ), most=3), "u", "v", "w")
    assert set(mixed) == set(whole) and all(mixed[p] == pytest.approx(whole[p], abs=2e-4) for p in whole)
    assert variational.wind_of(cells.filter("false"), steps=(DX, DY, DZ)).count() == 0
    assert variational.solve_tiled(cells.filter("case = 0").drop("case"), steps=(DX, DY, DZ), most=1, tile=3).select("case").distinct().count() == 1


def test_the_operator_is_symmetric():
    rng = np.random.default_rng(4)
    given = rng.normal(size=(11, 4, 6, 5))
    given[10] = np.abs(given[10]) * 1000
    given[6:8][rng.random((2, 4, 6, 5)) < 0.3] = np.nan
    system = variational.System(given, variational.WEIGHTS, (DX, DY, DZ))
    x, y = rng.normal(size=(2, 3, 4, 6, 5))
    assert (x * system.apply(y)).sum() == pytest.approx((y * system.apply(x)).sum(), rel=1e-10)
    g = rng.normal(size=(3, 5, 4))
    assert (system.divergence(x) * g).sum() == pytest.approx((x * system.divergence_adjoint(g)).sum(), rel=1e-10)


def test_first_guess_equals_arrays(spark):
    cells = two_cases(spark).filter("case = 0").drop("case")
    direct = by_place(retrieval.direct_wind(cells), "direct", "u", "v", "w")
    got = by_place(retrieval.initial_wind(cells, background(spark)), "direct", "u0", "v0", "w0")
    shape = (4, 13, 11)
    values, mask = np.zeros((3, *shape)), np.zeros(shape)
    for place, (ok, *uvw) in direct.items():
        if ok:
            mask[place] = 1
            values[(slice(None), *place)] = uvw
    kernel = np.exp(-np.arange(-8, 9) ** 2 / 8.0)
    kernel /= kernel.sum()

    def blur(a):
        for axis in range(3):
            a = np.apply_along_axis(lambda line: np.convolve(line, kernel)[8 : 8 + len(line)], axis, a)
        return a

    assert 50 < mask.sum() < 500 and np.abs(values[2]).max() <= retrieval.W_LIMIT
    weight = np.maximum(blur(mask), 1e-6)
    means = [blur(np.where(mask, v, 0)) / weight for v in values]
    for place, (ok, *uvw) in got.items():
        want = [m[place] for m in means] if mask[place] else [4.0 + place[0], -2.0, 0.0]
        assert ok == bool(mask[place]) and uvw == pytest.approx(want, abs=1e-9)
    bare = by_place(retrieval.initial_wind(cells, None), "u0", "v0", "w0")
    assert all(bare[p] == pytest.approx(tuple(values[(slice(None), *p)]), abs=1e-12) for p in bare)


def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(c, k, j, i, float(2.0 * i + 0.1 * i * i), float(3.0 * j), bool(rng.random() < 0.07 and k != 1)) for c in range(2) for k in range(3) for j in range(12) for i in range(15) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "case int, k int, j int, i int, x double, y double, valid boolean")
    got = by_place(grid.distances(cells), "d2")
    for c, k, j, i, x, y, _ in rows:
        near = [(x - r[4]) ** 2 + (y - r[5]) ** 2 for r in rows if r[:2] == (c, k) and r[6]]
        assert got[c, k, j, i][0] == (pytest.approx(min(near), abs=1e-9) if near else None)


def test_low_pass_equals_polynomials(spark):
    rng = np.random.default_rng(7)
    field = rng.normal(size=(4, 9, 7))
    cells = spark.createDataFrame([(1, *map(int, p), float(field[p])) for p in np.ndindex(field.shape)], "case int, k int, j int, i int, u double")
    got = by_place(grid.low_pass(cells, ("u",)), "u")

    def line(values):
        n = len(values)
        if n < 5:
            return values
        out = []
        for a in range(n):
            first = max(0, min(n - 5, a - 2))
            out.append(np.polyval(np.polyfit(np.arange(5.0), values[first : first + 5], 3), a - first))
        return np.array(out)

    want = field
    for axis in range(3):
        want = np.apply_along_axis(line, axis, want)
    assert all(got[1, *map(int, p)][0] == pytest.approx(want[p], abs=1e-9) for p in np.ndindex(field.shape))
    holed = by_place(grid.low_pass(cells.filter("NOT (k = 1 AND j = 4 AND i = 3)"), ("u",)), "u")
    assert len(holed) == field.size - 1 and all(v[0] is not None for v in holed.values())


def test_whole_cases_dont_mix(spark):
    """Gridding, first guess and retrieval give each case of a table what it gives the case alone."""
    rng = np.random.default_rng(8)
    shape = (3, 6, 7)
    cells = spark.createDataFrame([(c, *map(int, p), (p[2] - 3) * DX, (p[1] - 3) * DY, DZ * (p[0] + 1)) for c in range(2) for p in np.ndindex(shape)], "case int, k int, j int, i int, x double, y double, z double")
    gates = [(c, n, *[float(a) for a in (rng.uniform(-18e3, 18e3), rng.uniform(-18e3, 15e3), rng.uniform(400, 1600))], float(rng.normal(0, 5)), 30.0) for c in range(2) for n in (1, 2) for _ in range(500)]
    gates = spark.createDataFrame(gates, "case int, radar int, gx double, gy double, gz double, vr double, dbz double")

    def chain(c, g):
        gridded = retrieval.grid_volume(c, g, 3000.0)
        both = retrieval.both_radars(c, gridded).cache()
        return both, retrieval.initial_wind(both, background(spark)), retrieval.retrieve(both, background(spark), most=5, filter_window=5)

    wanted = (("vr1", "vr2"), ("u0", "v0", "w0"), ("u", "v", "w", "divergence", "iterations"))
    together = chain(cells, gates)
    for case in (0, 1):
        alone = chain(cells.filter(F.col("case") == case).drop("case"), gates.filter(F.col("case") == case).drop("case"))
        for columns, one, all_cases in zip(wanted, alone, together, strict=True):
            got = {p[1:]: v for p, v in by_place(all_cases, *columns).items() if p[0] == case}
            want = by_place(one, *columns)
            assert set(got) == set(want)
            for p in want:
                assert [x if x is None else round(x, 6) for x in got[p]] == [x if x is None else round(x, 6) for x in want[p]], (case, p, columns)
    with pytest.raises(ValueError, match="case"):
        retrieval.both_radars(cells.drop("case"), retrieval.grid_volume(cells, gates, 3000.0))
