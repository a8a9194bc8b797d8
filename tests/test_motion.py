"""Motion with its overlap and confidence, windows by level, and fits against profiles: literal versions and hard rows."""

from __future__ import annotations

import numpy as np
import pytest

from skyshear.operators import aggregate, grid


def brute(source, target, most, floor, least):
    """Every shift of two arrays with NaN where nothing is seen."""
    ny, nx = source.shape
    found = {}
    for dj in range(-most, most + 1):
        for di in range(-most, most + 1):
            pairs = [(source[j, i], target[j + dj, i + di]) for j in range(ny) for i in range(nx) if 0 <= j + dj < ny and 0 <= i + di < nx]
            pairs = [(max(a - floor, 0), max(b - floor, 0)) for a, b in pairs if np.isfinite(a) and np.isfinite(b)]
            union = [(a, b) for a, b in pairs if a > 0 or b > 0]
            norm = np.sqrt(sum(a * a for a, _ in union) * sum(b * b for _, b in union))
            if len(union) >= least and norm > 0:
                found[dj, di] = (round(sum(a * b for a, b in union) / norm, 9), sum(a > 0 and b > 0 for a, b in union) / len(union), len(pairs))
    if not found:
        return None
    (dj, di), (peak, overlap, n) = max(found.items(), key=lambda x: (x[1][0], -x[0][0], -x[0][1]))
    far = [v[0] for (j, i), v in found.items() if abs(j - dj) > 1 or abs(i - di) > 1]
    edge = most in (abs(dj), abs(di))
    second = max(far) if far else None
    level = "high" if peak >= 0.8 and overlap >= 0.45 and far and peak - second >= 0.02 and not edge else "medium" if peak >= 0.6 and overlap >= 0.25 and not edge else "low"
    return dj, di, peak, second, overlap, n / min(np.isfinite(source).sum(), np.isfinite(target).sum()), edge, level


def storm(ny, nx, y, x, width=3.0, top=55.0):
    j, i = np.mgrid[:ny, :nx]
    return top * np.exp(-((j - y) ** 2 + (i - x) ** 2) / (2 * width**2))


def test_motion_found_against_loops(spark):
    """Two cases: a storm that moves through gaps, and noise; a null, a NaN and a time without any excess."""
    rng = np.random.default_rng(8)
    fields = {0: [storm(18, 20, 7 + 2 * t, 6 + t) for t in range(3)] + [np.zeros((18, 20))], 1: [rng.uniform(0, 45, (18, 20)) for _ in range(3)]}
    rows = []
    for c, times in fields.items():
        for t, f in enumerate(times):
            f[rng.random(f.shape) < 0.1] = np.nan
            rows += [(c, t, j, i, None if np.isnan(v) and (i + j) % 2 else float(v)) for (j, i), v in np.ndenumerate(f) if not (np.isnan(v) and i % 3 == 0)]
    df = spark.createDataFrame(rows, "case int, t int, j int, i int, v double")
    got = {(r["case"], r["t"]): r for r in grid.motion_found(df, 4).collect()}
    want = {(c, t): brute(f[t], f[t + 1], 4, 20.0, 25) for c, f in fields.items() for t in range(len(f) - 1)}
    assert set(got) == {k for k, v in want.items() if v} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for k, r in got.items():
        assert (r.dj, r.di, r.at_edge, r.confidence) == (*want[k][:2], *want[k][6:])
        assert (r.peak, r.second, r.overlap, r.finite) == pytest.approx((want[k][2], *want[k][3:6]), abs=2e-9) and r.margin == pytest.approx(r.peak - r.second)
    assert (got[0, 0].dj, got[0, 0].di, got[0, 0].confidence) == (2, 1, "high") and abs(got[0, 0].oj) < 0.3 and got[1, 0].confidence == "low"
    assert grid.motion_found(df.limit(0), 2).count() == 0


def test_windows_against_loops(spark):
    """Repeated rows, times outside, a window longer than the series."""
    rng = np.random.default_rng(9)
    seen = rng.random((7, 3, 4, 5)) < 0.6
    rows = [tuple(map(int, x)) for x in np.argwhere(seen)]
    df = spark.createDataFrame(rows + rows[:40] + [(9, 0, 0, 0)], "t int, k int, j int, i int").repartition(5)
    got = {(r.length, r.start, r.k): (r.union, r.intersection, r.of_union, r.of_level) for r in aggregate.window_levels(df, 1, 5, 20, (3, 5, 6)).collect()}
    want = {}
    for n in (3, 5):
        for start in range(1, 7 - n):
            for k in range(3):
                some, every = seen[start : start + n, k].any(0).sum(), seen[start : start + n, k].all(0).sum()
                want[n, start, k] = (some, every, round(every / some, 6), round(every / 20, 6))
    assert got == want and len(want) == 12


def test_fit_against_profile(spark):
    """A wind towards 60 degrees, seen in the band alone; a second profile that blows the other way; a third without a valid level."""
    rows = [(s, float(a), h, float(12.0 * np.sin(np.radians(60)) * np.sin(np.radians(a)) + 12.0 * np.cos(np.radians(60)) * np.cos(np.radians(a)) + 1.5) if 350 <= h <= 700 else 99.0) for s in (1, 2, 3) for a in range(0, 360, 10) for h in (300.0, 350.0, 500.0, 700.0, 750.0)]
    gates = spark.createDataFrame([*rows, (1, 5.0, 500.0, None)], "station int, azimuth double, height_m double, v double")
    profile = spark.createDataFrame([(1, 100.0, None, 10.0), (1, 300.0, 0.0, 10.0), (1, 500.0, 11.0, 238.0), (1, 900.0, 20.0, 90.0), (2, 500.0, 11.0, 60.0), (3, 500.0, None, 60.0)], "station int, height_m double, speed double, direction double")
    got = {r.station: r for r in aggregate.fit_against_profile(gates, profile).collect()}
    assert set(got) == {1, 2}
    assert got[1].samples == 108 and got[1].toward == pytest.approx(60, abs=1e-3) and got[1].mean == pytest.approx(1.5, abs=1e-4) and got[1].apart == pytest.approx(2, abs=1e-3) and got[1].agrees
    assert got[2].dot < 0 and not got[2].agrees
