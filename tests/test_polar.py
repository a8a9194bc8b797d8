"""Gates around places, and the reasons that follow, against plain loops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skyshear.operators import polar

RADARS = ((0.0, 0.0, 0.0), (30_000.0, -5_000.0, 100.0))


def brute(place, gates):
    """Literal search of every gate of the nearest sweep."""
    out = []
    for n, (x, y, z) in enumerate(RADARS, 1):
        mine = [g for g in gates if g[0] == n]
        if not mine:
            out += [None, None, None, 0, 0, False]
            continue
        e, o, u = (a - b for a, b in zip(place, (x, y, z), strict=True))
        az, el, far = round(math.degrees(math.atan2(e, o)) % 360, 6), round(math.degrees(math.atan2(u, math.hypot(e, o))), 6), round(math.sqrt(e * e + o * o + u * u), 6)
        off, sweep, elevation = min((round(abs(g[2] - el), 6), g[1], g[2]) for g in mine)
        near = [g for g in mine if g[1] == sweep and round(abs((g[3] - az + 180) % 360 - 180), 6) <= 1.5 and round(abs(g[4] - far), 6) <= 2000]
        out += [sweep, elevation, off, len(near), sum(g[5] is not None for g in near), far <= max(g[4] for g in mine) + 2000]
    return out


def names():
    return [f"{c}{n}" for n in (1, 2) for c in ("sweep", "elevation", "offset", "samples", "valid", "in_range")]


def test_support_against_loops(spark):
    """Two cases of one table, azimuths on both sides of north, sweeps as near as each other, masked gates, places out of range."""
    rng = np.random.default_rng(41)
    gates = {c: [(r, s, 0.5 + 1.5 * s, float(a), 500.0 + 1000 * g, None if rng.random() < 0.3 else 1.0) for r in (1, 2) for s in range(3) for a in range(360) for g in range(20 + 5 * c) if rng.random() < 0.2] for c in range(2)}
    places = {c: [(float(a), float(b), float(h)) for a, b, h in zip(rng.uniform(-3e4, 4e4, 40), rng.uniform(-3e4, 3e4, 40), rng.uniform(0, 3e3, 40), strict=True)] + [(0.0, 10_000.0, 300.0), (-1.0, 10_000.0, 300.0), (0.0, 0.0, 0.0), (10_000.0, 0.0, 10_000 * math.tan(math.radians(1.25)))] for c in range(2)}
    g = spark.createDataFrame([(c, *r) for c in range(2) for r in gates[c]], "case int, radar int, sweep int, elevation double, azimuth double, range_m double, value double")
    p = spark.createDataFrame([(c, k, *r) for c in range(2) for k, r in enumerate(places[c])], "case int, id int, x double, y double, z double")
    got = {(r["case"], r["id"]): [r[n] for n in names()] for r in polar.support(p, g, RADARS).collect()}
    assert got == {(c, k): brute(r, gates[c]) for c in range(2) for k, r in enumerate(places[c])}
    assert any(v[3] for v in got.values()) and any(not v[5] for v in got.values())
    one = polar.support(p.filter("case = 1").drop("case"), g.filter("case = 1").drop("case").repartition(7), RADARS)
    assert {r["id"]: [r[n] for n in names()] for r in one.collect()} == {k: v for (c, k), v in got.items() if c == 1}


def test_hard_rows(spark):
    """A radar without gates, places without height, and no gates at all."""
    g = spark.createDataFrame([(1, 0, 0.5, 90.0, 10_000.0, 1.0), (1, 0, 0.5, None, 10_000.0, 1.0), (1, 0, 0.5, 90.0, None, 1.0)], "radar int, sweep int, elevation double, azimuth double, range_m double, value double")
    p = spark.createDataFrame([(1, 10_000.0, 0.0, 87.0), (2, 10_000.0, 0.0, None)], "id int, x double, y double, z double")
    got = {r.id: r for r in polar.support(p, g, RADARS).collect()}
    assert (got[1].samples1, got[1].valid1, got[1].in_range1) == (1, 1, True) and (got[1].sweep2, got[1].samples2, got[1].in_range2) == (None, 0, False)
    assert (got[2].sweep1, got[2].samples1, got[2].in_range1, got[2].in_range2) == (None, 0, False, False)
    none = polar.support(p, g.limit(0), RADARS).collect()
    assert len(none) == 2 and not any(r.samples1 or r.in_range1 for r in none)
    assert polar.support(p.limit(0), g, RADARS).count() == 0


def test_every_reason(spark):
    """Every combination of what decides, against nested rules written out."""
    b = (False, True)
    rows = [(s1, s2, a, d, n1, n2, v1, v2) for s1 in b for s2 in b for a in b for d in b for n1 in b for n2 in b for v1 in (0, 2) for v2 in (0, 2)]
    df = spark.createDataFrame(rows, "s1 boolean, s2 boolean, a boolean, d boolean, in_range1 boolean, in_range2 boolean, valid1 long, valid2 long")

    def rule(s1, s2, a, d, n1, n2, v1, v2):
        if s1 and s2:
            return "accepted" if a and d else "downstream" if a else "angle"
        if not s1 and not s2:
            out = [n for n, near in ((1, n1), (2, n2)) if not near]
            if out:
                return "out of both ranges" if len(out) == 2 else f"out of range of radar {out[0]}"
            return "gates nearby but no value" if v1 or v2 else "no valid gate nearby"
        n, near, v = (2, n2, v2) if s1 else (1, n1, v1)
        return f"radar {n} out of range" if not near else f"radar {n} has gates nearby but no value" if v else f"radar {n} has no valid gate nearby"

    got = df.select("*", polar.why(F.col("s1"), F.col("s2"), F.col("a"), F.col("d")).alias("reason")).collect()
    assert all(r.reason == rule(*r[:8]) for r in got) and len({r.reason for r in got}) == 14
