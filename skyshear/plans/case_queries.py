"""Queries on whole cases: gridding in space, quality control, retrieval, the low-rank study, axis checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.model import DX, DY, DZ, RADARS
from skyshear.operators import grid, qc, retrieval, stencil, study
from skyshear.plans.views import oracle, view
from skyshear.plans.wind_queries import _MEDIAN_JOIN, _SYN
from skyshear.sources import volumes

R = geo.rounded
KEY = ["k", "j", "i"]
GATE_M = 700.0


def _cells(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "cells").select(*KEY, "x", "y", "z")


def _gates(s, d):  # noqa: ANN001, ANN202
    return retrieval.place(view(s, d, "gates"), F.col("sweep") * 0.5 + 0.25, GATE_M)


def _grid(s, d):  # noqa: ANN001, ANN202
    out = retrieval.grid_volume(_cells(s, d), _gates(s, d), retrieval.ROI_DISPLAY)
    return out.select("radar", *KEY, R(F.col("vr"), 5).alias("vr"), R(F.col("dbz"), 5).alias("dbz"), "n")


def _control(s, d):  # noqa: ANN001, ANN202
    """All gates; the velocity is a corrected one, so it isn't unfolded again."""
    return qc.control(view(s, d, "gates"), "Vc").select(*qc.GATE, "vr", "dbz")


def _background(s, d):  # noqa: ANN001, ANN202
    return s.range(5).select(F.col("id").cast("int").alias("k"), (4.0 + F.col("id")).alias("ub"), F.lit(-2.0).alias("vb"))


def _first_guess(s, d):  # noqa: ANN001, ANN202
    out = retrieval.initial_wind(view(s, d, "cells"), _background(s, d))
    return out.select(*KEY, "direct", R(F.col("u0"), 3).alias("u0"), R(F.col("v0"), 3).alias("v0"), R(F.col("w0"), 3).alias("w0"))


def _retrieve(s, d):  # noqa: ANN001, ANN202
    """From gates to wind: gridding, first guess, solution, masks."""
    cells = _cells(s, d)
    both = retrieval.both_radars(cells, retrieval.grid_volume(cells, _gates(s, d), retrieval.ROI_DISPLAY))
    out = retrieval.retrieve(both, _background(s, d))
    return out.select(*KEY, *[R(F.col(c), 2).alias(c) for c in "uvw"], "wind_masked", "diagnostics_masked")


def _cases(s, d):  # noqa: ANN001, ANN202
    """Even and odd sweeps as two cases of one table, each on its own copy of the grid."""
    cells = _cells(s, d).withColumn("case", F.explode(F.array(F.lit(0), F.lit(1))))
    gates = _gates(s, d).withColumn("case", F.col("sweep") % 2)
    return retrieval.both_radars(cells, retrieval.grid_volume(cells, gates, retrieval.ROI_DISPLAY))


def _record(out):  # noqa: ANN001, ANN202
    return out.select("case", *KEY, *[R(F.col(c), 2).alias(c) for c in "uvw"], "wind_masked", "diagnostics_masked", "iterations", R(F.col("residual")).alias("residual"))


def _retrieve_cases(s, d):  # noqa: ANN001, ANN202
    """Two cases in one call, ended when the wind moves by less than half a metre a second, and smoothed."""
    return _record(retrieval.retrieve(_cases(s, d), _background(s, d), most=50, change=0.5, filter_window=5))


def _retrieve_tiled(s, d):  # noqa: ANN001, ANN202
    """The same in tiles, ten steps from the first guess."""
    return _record(retrieval.retrieve(_cases(s, d), _background(s, d), most=10, task=0, tile=11))


def _smooth3(s, d):  # noqa: ANN001, ANN202
    """All three components of the wind, two cells in every direction."""
    w = view(s, d, "wind").select(*KEY, *[F.when(F.col("valid"), F.col(c)).alias(c) for c in "uvw"])
    return grid.smoothed(w, ("u", "v", "w"), 2.0, 8).select(*KEY, *[R(F.col(f"s_{c}"), 4).alias(c) for c in "uvw"])


def _distance(s, d):  # noqa: ANN001, ANN202
    """How far each cell is from the nearest valid one of its level."""
    w = view(s, d, "wind").withColumn("valid", F.col("valid") & ((F.col("i") + 3 * F.col("j")) % 17 == 0))
    return grid.distances(w).select(*KEY, R(F.sqrt("d2"), 3).alias("distance"))


def _low_pass(s, d):  # noqa: ANN001, ANN202
    """The wind on the full grid, zero where there is none, by polynomials of third order over five cells."""
    full = s.range(5 * 21 * 21).select(F.floor(F.col("id") / 441).cast("int").alias("k"), F.floor(F.col("id") % 441 / 21).cast("int").alias("j"), (F.col("id") % 21).cast("int").alias("i"))
    w = full.join(view(s, d, "wind").filter("valid").select(*KEY, "u", "v"), KEY, "left").select(*KEY, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "uv"])
    return grid.low_pass(w, ("u", "v")).select(*KEY, *[R(F.col(c), 4).alias(c) for c in "uv"])


def _cardinal(s, d):  # noqa: ANN001, ANN202
    """The ray nearest to each axis of the compass, and whether its gate at 50 km lies on that side of the radar."""
    rays = view(s, d, "gates").select("radar", "sweep", "ray").distinct()
    axis = F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])).alias("axis")
    off = geo.wrapped(F.col("ray").cast("double"), F.col("axis").cast("double"))
    near = rays.select("radar", "sweep", "ray", axis).groupBy("radar", "sweep", "axis").agg(F.min(F.struct(off.alias("off"), "ray")).alias("m"))
    e, n, _ = geo.cosines(F.col("m.ray").cast("double"), F.col("sweep") * 0.5 + 0.25)
    lon, lat = geo.enu_to_lonlat(50.0 * e, 50.0 * n, 35.25, 118.421)
    right = F.when(F.col("axis") == 0, lat > 35.25).when(F.col("axis") == 90, lon > 118.421).when(F.col("axis") == 180, lat < 35.25).otherwise(lon < 118.421)
    return near.select("radar", "sweep", "axis", F.col("m.ray").alias("ray"), F.col("m.off").alias("off"), (F.col("m.off") >= 45).alias("missing"), right.alias("agrees"))


def _reject(s, d):  # noqa: ANN001, ANN202
    """Lines through features whose boxes meet the domain."""
    p = view(s, d, "features").select((F.col("id") % 97).alias("line"), F.col("id").alias("seq"), "fx", "fy")
    return volumes.lines_in(p, (-35_000.0, 35_000.0, -30_000.0, 30_000.0), ("line",), "fx", "fy").groupBy("line").agg(F.count("*").alias("points"))


def _stretch(s, d):  # noqa: ANN001, ANN202
    """Points of a scene: kilometres, heights stretched."""
    return view(s, d, "features").select("id", R(F.col("fx") / 1000.0).alias("x_km"), R(F.col("fy") / 1000.0).alias("y_km"), R(geo.stretched(F.col("fz") / 1000.0, 3.0)).alias("z_km"))


def _study(s, d):  # noqa: ANN001, ANN202
    return study.rank_study(view(s, d, "field"), (0.5, 1.0), 6, 15, 15)


def _kept(s, d):  # noqa: ANN001, ANN202
    """The wind against its own 3-cell means along rows."""
    mean = lambda c: stencil.around(F.avg, F.when(F.col("valid"), F.col(c)), "i", 1)
    w = view(s, d, "wind").withColumns({"eu": mean("u"), "ev": mean("v")})
    out = study.vortex_kept(w, DX, DY, DZ)
    return out.select(*[R(F.col(c) * (1e4 if c in ("zeta", "zeta_est") else 1), 4).alias(c) for c in out.columns])


QUERIES = {
    "grid_volume": _grid,
    "qc_chain": _control,
    "initial_wind": _first_guess,
    "retrieve_case": _retrieve,
    "retrieve_cases": _retrieve_cases,
    "retrieve_tiled": _retrieve_tiled,
    "gaussian_smooth_3d": _smooth3,
    "distance_transform": _distance,
    "low_pass_polynomial": _low_pass,
    "cardinal_axes": _cardinal,
    "line_reject": _reject,
    "vertical_stretch": _stretch,
    "rank_study": _study,
    "vortex_kept": _kept,
}
_X = " ".join(f"WHEN {n} THEN {r[0]}::DOUBLE" for n, r in enumerate(RADARS, 1))
_Y = " ".join(f"WHEN {n} THEN {r[1]}::DOUBLE" for n, r in enumerate(RADARS, 1))
_PLACED = f"""+q AS (SELECT radar, vr, dbz, (gate + 0.5::DOUBLE) * {GATE_M}::DOUBLE AS r, radians(ray::DOUBLE) AS az, radians(sweep * 0.5::DOUBLE + 0.25::DOUBLE) AS el FROM gates),
  g AS (SELECT radar, vr, dbz, round(CASE radar {_X} END + r * (cos(el) * sin(az)), 3) + 0e0 AS gx, round(CASE radar {_Y} END + r * (cos(el) * cos(az)), 3) + 0e0 AS gy, round(0e0 + r * sin(el), 3) + 0e0 AS gz FROM q)"""
#: Masked means over 17 cells along i, then j, then k, of m (one for a valid cell) and u, v, w of q.
_GAUSS = "s0 AS (SELECT k, j, i, 1e0 AS m, u, v, w FROM q WHERE u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL)" + "".join(
    f", s{n} AS (SELECT {', '.join(f'{c} + d AS {c}' if c == axis else c for c in KEY)}, {', '.join(f'sum({c} * exp(-(d * d) / 8::DOUBLE)) AS {c}' for c in 'muvw')} FROM s{n - 1}, range(-8, 9) t(d) GROUP BY ALL)" for n, axis in enumerate("ijk", 1)
)
_PASS = [[float(w) for w in row] for row in np.vander(np.arange(5.0), 4, increasing=True) @ np.linalg.pinv(np.vander(np.arange(5.0), 4, increasing=True))]


def _pass_sql(n: int, axis: str, size: int) -> str:
    """One axis of the polynomial smoothing: each cell from the five of its window."""
    first = f"greatest(0, least({size - 5}, a.{axis} - 2))"
    keys = " AND ".join(f"b.{c} = a.{c}" for c in KEY if c != axis)
    return f"p{n} AS (SELECT a.k, a.j, a.i, sum(b.u * w) AS u, sum(b.v * w) AS v FROM p{n - 1} a JOIN p{n - 1} b ON {keys} AND b.{axis} BETWEEN {first} AND {first} + 4 JOIN c ON c.a = a.{axis} - {first} AND c.m = b.{axis} - {first} GROUP BY ALL)"


ORACLES = {
    "gaussian_smooth_3d": oracle("wind", f"+q AS (SELECT k, j, i, CASE WHEN valid THEN u END AS u, CASE WHEN valid THEN v END AS v, CASE WHEN valid THEN w END AS w FROM wind), {_GAUSS} SELECT k, j, i, {', '.join(f'round(s3.{c} / s3.m, 4) + 0e0 AS {c}' for c in 'uvw')} FROM (SELECT k, j, i FROM wind) LEFT JOIN s3 USING (k, j, i)"),
    "distance_transform": oracle("wind", "+v AS (SELECT k, x, y FROM wind WHERE valid AND (i + 3 * j) % 17 = 0) SELECT c.k, c.j, c.i, round(sqrt(min((c.x - v.x) ** 2 + (c.y - v.y) ** 2)), 3) + 0e0 AS distance FROM wind c LEFT JOIN v ON v.k = c.k GROUP BY c.k, c.j, c.i"),
    "low_pass_polynomial": oracle("wind", f"+c(a, m, w) AS (VALUES {', '.join(f'({a}, {m}, {w!r}::DOUBLE)' for a, row in enumerate(_PASS) for m, w in enumerate(row))}), p0 AS (SELECT g.k, g.j, g.i, coalesce(w.u, 0) AS u, coalesce(w.v, 0) AS v FROM (SELECT k::INT AS k, j::INT AS j, i::INT AS i FROM range(5) t1(k), range(21) t2(j), range(21) t3(i)) g LEFT JOIN (SELECT * FROM wind WHERE valid) w USING (k, j, i)), {_pass_sql(1, 'k', 5)}, {_pass_sql(2, 'j', 21)}, {_pass_sql(3, 'i', 21)} SELECT k, j, i, round(u, 4) + 0e0 AS u, round(v, 4) + 0e0 AS v FROM p3"),
    "initial_wind": oracle("cells", f"""{_SYN}, d AS (SELECT k, j, i, ok, CASE WHEN ok THEN (by2 * vr1 - by1 * vr2) / det END AS u, CASE WHEN ok THEN (bx1 * vr2 - bx2 * vr1) / det END AS v FROM s),
      n AS (SELECT d.*, (e.u - f.u) / 1e4 + (g2.v - h.v) / 1e4 AS div FROM d LEFT JOIN d e ON e.k = d.k AND e.j = d.j AND e.i = d.i + 1 LEFT JOIN d f ON f.k = d.k AND f.j = d.j AND f.i = d.i - 1 LEFT JOIN d g2 ON g2.k = d.k AND g2.i = d.i AND g2.j = d.j + 1 LEFT JOIN d h ON h.k = d.k AND h.i = d.i AND h.j = d.j - 1),
      r AS (SELECT k, j, i, ok, 0e0 AS w FROM n WHERE NOT EXISTS (SELECT 1 FROM n a WHERE a.j = n.j AND a.i = n.i AND a.k = n.k + 1)
        UNION ALL SELECT n.k, n.j, n.i, n.ok, CASE WHEN n.ok AND r.ok AND n.div IS NOT NULL THEN r.w + n.div * 500 ELSE 0e0 END FROM r JOIN n ON n.j = r.j AND n.i = r.i AND n.k = r.k - 1),
      q AS (SELECT d.k, d.j, d.i, d.ok, d.u, d.v, CASE WHEN d.ok THEN greatest(-30e0, least(30e0, r.w)) END AS w FROM d JOIN r USING (k, j, i)), {_GAUSS}
      SELECT k, j, i, ok AS direct, round(CASE WHEN ok THEN s3.u / s3.m ELSE 4e0 + k END, 3) + 0e0 AS u0, round(CASE WHEN ok THEN s3.v / s3.m ELSE -2e0 END, 3) + 0e0 AS v0, round(CASE WHEN ok THEN s3.w / s3.m ELSE 0e0 END, 3) + 0e0 AS w0 FROM (SELECT k, j, i, ok FROM q) LEFT JOIN s3 USING (k, j, i)""", recursive=True),
    "grid_volume": oracle("cells gates", f"""{_PLACED}, p AS (SELECT radar, k, j, i, vr, dbz, 9e6 AS m, (x - gx) ** 2 + (y - gy) ** 2 + (z - gz) ** 2 AS d FROM cells JOIN g ON gx BETWEEN x - 3e3 AND x + 3e3 AND gy BETWEEN y - 3e3 AND y + 3e3 AND gz BETWEEN z - 3e3 AND z + 3e3 WHERE (x - gx) ** 2 + (y - gy) ** 2 + (z - gz) ** 2 <= 9e6)
      SELECT radar, k, j, i, round(sum(round((m - d) / (m + d) * vr, 9)::DECIMAL(24,9))::DOUBLE / nullif(sum(round((m - d) / (m + d), 9)::DECIMAL(24,9)) FILTER (WHERE vr IS NOT NULL)::DOUBLE, 0), 5) + 0e0 AS vr, round(sum(round((m - d) / (m + d) * dbz, 9)::DECIMAL(24,9))::DOUBLE / nullif(sum(round((m - d) / (m + d), 9)::DECIMAL(24,9)) FILTER (WHERE dbz IS NOT NULL)::DOUBLE, 0), 5) + 0e0 AS dbz, count(vr) AS n FROM p GROUP BY ALL"""),
    "qc_chain": oracle("gates", f"""+g AS (SELECT * FROM gates), c AS (SELECT *, min(ray) OVER w AS rl, max(ray) OVER w AS rh, min(gate) OVER w AS gl, max(gate) OVER w AS gh FROM g WINDOW w AS (PARTITION BY radar, sweep)),
      m AS (SELECT c.radar, c.sweep, c.ray, c.gate, c.vr, c.dbz, [{", ".join(f"m{a}{b}.vr" for a in range(3) for b in range(3))}] AS l FROM c {_MEDIAN_JOIN}),
      s AS (SELECT radar, sweep, ray, gate, dbz, CASE WHEN vr IS NOT NULL AND len(list_filter(l, lambda x: x IS NOT NULL)) = 9 THEN list_sort(l)[5] END AS vr FROM m)
      SELECT radar, sweep, ray, gate, CASE WHEN abs(vr) <= 100 THEN vr END AS vr, CASE WHEN dbz BETWEEN -20 AND 80 THEN dbz END AS dbz FROM s"""),
    "cardinal_axes": oracle("gates", """+r AS (SELECT DISTINCT radar, sweep, ray FROM gates), o AS (SELECT *, least((ray - axis + 720) % 360, 360 - (ray - axis + 720) % 360)::DOUBLE AS off FROM r, (VALUES (0), (90), (180), (270)) v(axis)),
      n AS (SELECT radar, sweep, axis, ray, off FROM (SELECT *, row_number() OVER (PARTITION BY radar, sweep, axis ORDER BY off, ray) AS p FROM o) WHERE p = 1)
      SELECT radar, sweep, axis::INT AS axis, ray, off, off >= 45 AS missing, CASE axis WHEN 0 THEN 35.25::DOUBLE + 50 * (cos(radians(sweep * 0.5::DOUBLE + 0.25::DOUBLE)) * cos(radians(ray::DOUBLE))) / 111.32::DOUBLE > 35.25::DOUBLE WHEN 180 THEN 35.25::DOUBLE + 50 * (cos(radians(sweep * 0.5::DOUBLE + 0.25::DOUBLE)) * cos(radians(ray::DOUBLE))) / 111.32::DOUBLE < 35.25::DOUBLE WHEN 90 THEN sin(radians(ray::DOUBLE)) > 1e-12 ELSE sin(radians(ray::DOUBLE)) < -1e-12 END AS agrees FROM n"""),
    "line_reject": oracle("features", "+p AS (SELECT id % 97 AS line, fx, fy FROM features) SELECT line, count(*) AS points FROM p GROUP BY line HAVING max(fx) >= -35e3 AND min(fx) <= 35e3 AND max(fy) >= -3e4 AND min(fy) <= 3e4"),
    "vertical_stretch": oracle("features", "SELECT id, round(fx / 1e3, 6) + 0e0 AS x_km, round(fy / 1e3, 6) + 0e0 AS y_km, round(fz / 1e3 * 3, 6) + 0e0 AS z_km FROM features"),
}
