"""Queries on gridding, sampling, translation and motion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyshear.functions.geo import rounded as R  # noqa: N812
from skyshear.model import COLOURS
from skyshear.operators import grid
from skyshear.plans.views import oracle, view

NY = NX = 15
#: Cells of 5 km that a storm may move between volumes: 30 km.
REACH = 6
_GATES = "g AS (SELECT radar, sweep, (ray % 41 - 20) * 2400e0 AS gx, (gate % 37 - 18) * 2700e0 AS gy, vr FROM gates), c AS (SELECT DISTINCT j, i, x, y FROM cells)"


def _cressman(s, d):  # noqa: ANN001, ANN202
    """Each sweep of each radar on the columns of the grid."""
    cells = view(s, d, "cells").select("j", "i", "x", "y").distinct()
    g = view(s, d, "gates").select("radar", "sweep", ((F.col("ray") % 41 - 20) * 2400.0).alias("gx"), ((F.col("gate") % 37 - 18) * 2700.0).alias("gy"), "vr")
    return grid.cressman(cells, g, ["radar", "sweep", "j", "i"], "vr", 4000.0).select("radar", "sweep", "j", "i", R(F.col("value"), 5).alias("value"), "n")


def _points(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "features").select("id", (F.col("id") * 37 % 1300 / 100.0).alias("px"), (F.col("id") * 53 % 1300 / 100.0).alias("py"))


def _bilinear(s, d):  # noqa: ANN001, ANN202
    """Every point in every volume."""
    f = view(s, d, "field").select("t", "j", "i", F.col("v").alias("value"))
    p = _points(s, d).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return grid.bilinear(p, f, ("id", "t"), ("t",)).select("id", "t", R(F.col("value"), 5).alias("value"))


def _profile(s, d):  # noqa: ANN001, ANN202
    p = view(s, d, "profile").select((F.col("level") * 300.0).alias("z"), (-F.col("speed") * F.sin(F.radians("direction"))).alias("u"))
    at = view(s, d, "features").select("id", (F.col("id") * 97 % 17000).cast("double").alias("x0"))
    return grid.linear(p, at, "z", "u").select("id", R(F.col("value"), 5).alias("u"))


def _smooth(s, d):  # noqa: ANN001, ANN202
    c = view(s, d, "wind").select("k", "j", "i", F.when(F.col("valid"), F.col("u")).alias("u"))
    return grid.smooth(c, "u", 1.5, 6).select("k", "j", "i", R(F.col("smooth"), 5).alias("smooth"))


def _holes(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "wind").withColumn("valid", F.col("valid") & ((F.col("i") + 3 * F.col("j")) % 17 == 0))


def _weight(s, d):  # noqa: ANN001, ANN202
    return grid.blend_weight(_holes(s, d), 8000.0).select("k", "j", "i", R(F.col("weight")).alias("weight"))


def _blend(s, d):  # noqa: ANN001, ANN202
    """The direct wind where it is valid, else the background."""
    return _holes(s, d).select("k", "j", "i", F.when(F.col("valid"), F.col("u")).otherwise(F.lit(4.0) + F.col("k")).alias("u"))


def _colour(s, d):  # noqa: ANN001, ANN202
    c = view(s, d, "cells").filter("dbz1 IS NOT NULL")
    r, g, b = grid.lerp(COLOURS, F.col("dbz1"))
    alpha = F.greatest(F.lit(0.12), F.least(F.lit(1.0), (F.col("dbz1") + 5) / 50.0))
    return c.select("k", "j", "i", R(r, 5).alias("r"), R(g, 5).alias("g"), R(b, 5).alias("b"), R(alpha, 5).alias("alpha"))


def _field(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "field")


def _moved(s, d):  # noqa: ANN001, ANN202
    return grid.translate(_field(s, d), 2.25, -1.5, NY, NX).select("t", "j", "i", R(F.col("v"), 9).alias("v"))


def _back(s, d):  # noqa: ANN001, ANN202
    return grid.translate(_field(s, d), 2.25, -1.5, NY, NX, adjoint=True).select("t", "j", "i", R(F.col("v"), 9).alias("v"))


def _mask(s, d):  # noqa: ANN001, ANN202
    return grid.transported_mask(_field(s, d).select("t", "j", "i"), 0.5, 1.0, NY, NX)


def _difference(s, d):  # noqa: ANN001, ANN202
    """Field at t + 1 less the field at t moved by (0.5, 1), where the moved field is valid."""
    moved = grid.translate(_field(s, d), 0.5, 1.0, NY, NX).join(_mask(s, d), ["t", "j", "i"])
    later = _field(s, d).select((F.col("t") - 1).alias("t"), "j", "i", F.col("v").alias("later"))
    return moved.join(later, ["t", "j", "i"]).select("t", "j", "i", R(F.col("later") - F.col("v"), 7).alias("change"))


def _consistency(s, d):  # noqa: ANN001, ANN202
    """Differences between volumes with and without the motion taken out, on cells where both are defined."""
    still = _field(s, d).withColumnRenamed("v", "now")
    later = _field(s, d).select((F.col("t") - 1).alias("t"), "j", "i", F.col("v").alias("later"))
    moved = grid.translate(_field(s, d), 0.5, 1.0, NY, NX).join(_mask(s, d), ["t", "j", "i"])
    g = still.join(later, ["t", "j", "i"]).join(moved, ["t", "j", "i"]).groupBy("t").agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("later") - F.col("now")) ** 2)).alias("before"), F.sqrt(F.avg((F.col("later") - F.col("v")) ** 2)).alias("after"))
    return g.select("t", "n", R(F.col("before"), 4).alias("before"), R(F.col("after"), 4).alias("after"), R(1 - F.col("after") / F.col("before"), 4).alias("reduction"))


def _scores(s, d):  # noqa: ANN001, ANN202
    return grid.motion_scores(_field(s, d), REACH, 3.0, 25)


def _ncc(s, d):  # noqa: ANN001, ANN202
    return _scores(s, d).select("t", "dj", "di", R(F.col("score"), 5).alias("score"), "cells")


def _best(s, d):  # noqa: ANN001, ANN202
    rounded = _scores(s, d).withColumn("score", R(F.col("score"), 5))
    return grid.best_motion(rounded).select("t", "dj", "di", "peak", "second", R(F.col("oj"), 3).alias("oj"), R(F.col("oi"), 3).alias("oi"))


def _found(s, d):  # noqa: ANN001, ANN202
    found = grid.motion_found(_field(s, d), REACH, 3.0, 25)
    return found.select("t", "dj", "di", R(F.col("oj"), 3).alias("oj"), R(F.col("oi"), 3).alias("oi"), *[R(F.col(c), 5).alias(c) for c in ("peak", "second", "margin", "overlap", "finite")], "at_edge", "confidence")


def _cumulative(s, d):  # noqa: ANN001, ANN202
    """Displacement of each volume from the first one of its window."""
    step = s.range(1, 6).select(F.col("id").cast("int").alias("t"), (F.col("id") * 0.5 + 0.25).alias("dx"), (1.5 - F.col("id") * 0.25).alias("dy"))
    spans = s.range(3).select(F.col("id").cast("int").alias("start"))
    w = Window.partitionBy("start").orderBy("t")
    j = F.broadcast(spans).join(step, (F.col("t") > F.col("start")) & (F.col("t") < F.col("start") + 4))
    return j.select("start", "t", F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"))


def _sql_move(dx, dy, adjoint):  # noqa: ANN001, ANN202
    n = -1 if adjoint else 1
    rows = ", ".join(f"({n * a}, {n * b}, {wa * wb}::DOUBLE)" for a, wa in grid._steps(dy) for b, wb in grid._steps(dx))
    return f"(SELECT t, j + sj AS j, i + si AS i, sum(v * w) AS v, count(*) AS n FROM field, (VALUES {rows}) m(sj, si, w) WHERE j + sj BETWEEN 0 AND 14 AND i + si BETWEEN 0 AND 14 GROUP BY ALL)"


_LEVELS = ", ".join(f"({a[0]}, {b[0]}, {a[1]}, {b[1]}, {a[2]}, {b[2]}, {a[3]}, {b[3]})" for a, b in zip(COLOURS[:-1], COLOURS[1:], strict=True))
_NCC = """f AS (SELECT t, j, i, greatest(v - 3, 0) AS e FROM field), s AS (SELECT dj::INT AS dj, di::INT AS di FROM range(-6, 7) a(dj), range(-6, 7) b(di)),
  p AS (SELECT f.t, dj, di, f.e AS a, g.e AS b FROM f, s, f g WHERE g.t = f.t + 1 AND g.j = f.j + dj AND g.i = f.i + di AND (f.e > 0 OR g.e > 0)),
  sc AS (SELECT t, dj, di, round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 5) + 0e0 AS score, count(*) AS cells FROM p GROUP BY ALL HAVING count(*) >= 25)"""
QUERIES = {
    "cressman_grid": _cressman,
    "bilinear_sample": _bilinear,
    "vwp_background": _profile,
    "gaussian_smooth_masked": _smooth,
    "blend_weight": _weight,
    "increment_blend": _blend,
    "colour_lerp": _colour,
    "translate_bilinear": _moved,
    "translate_adjoint": _back,
    "transported_mask": _mask,
    "time_difference": _difference,
    "temporal_consistency": _consistency,
    "ncc_motion": _ncc,
    "motion_confidence": _found,
    "ncc_peak": _best,
    "cumulative_shift": _cumulative,
}
ORACLES = {
    "cressman_grid": oracle("cells gates", f"+{_GATES}, p AS (SELECT radar, sweep, j, i, vr, 16e6 AS r, (x - gx) ** 2 + (y - gy) ** 2 AS d FROM c, g WHERE vr IS NOT NULL AND (x - gx) ** 2 + (y - gy) ** 2 <= 16e6) SELECT radar, sweep, j, i, round(sum(round((r - d) / (r + d) * vr, 9)::DECIMAL(24,9))::DOUBLE / nullif(sum(round((r - d) / (r + d), 9)::DECIMAL(24,9))::DOUBLE, 0), 5) + 0e0 AS value, count(*) AS n FROM p GROUP BY ALL"),
    "bilinear_sample": oracle("features field", """+p AS (SELECT id, id * 37 % 1300 / 1e2 AS px, id * 53 % 1300 / 1e2 AS py, t::INT AS t FROM features, range(6) r(t)), f AS (SELECT t, j, i, v FROM field)
      SELECT id, p.t, round((round(((1 - abs(px - floor(px))) * (1 - abs(py - floor(py)))) * a.v, 12)::DECIMAL(27,12) + round(((1 - abs(px - (floor(px) + 1))) * (1 - abs(py - floor(py)))) * b.v, 12)::DECIMAL(27,12) + round(((1 - abs(px - floor(px))) * (1 - abs(py - (floor(py) + 1)))) * c.v, 12)::DECIMAL(27,12) + round(((1 - abs(px - (floor(px) + 1))) * (1 - abs(py - (floor(py) + 1)))) * e.v, 12)::DECIMAL(27,12)), 5)::DOUBLE + 0e0 AS value FROM p
      LEFT JOIN f a ON a.t = p.t AND a.i = floor(px) AND a.j = floor(py) LEFT JOIN f b ON b.t = p.t AND b.i = floor(px) + 1 AND b.j = floor(py) LEFT JOIN f c ON c.t = p.t AND c.i = floor(px) AND c.j = floor(py) + 1 LEFT JOIN f e ON e.t = p.t AND e.i = floor(px) + 1 AND e.j = floor(py) + 1"""),
    "vwp_background": oracle("profile features", """+p AS (SELECT level * 300e0 AS z, -speed * sin(radians(direction::DOUBLE)) AS u FROM profile), a AS (SELECT id, (id * 97 % 17000)::DOUBLE AS x FROM features),
      l AS (SELECT a.id, a.x, p.z AS z0, p.u AS u0 FROM a ASOF LEFT JOIN p ON a.x >= p.z), h AS (SELECT a.id, p.z AS z1, p.u AS u1 FROM a ASOF LEFT JOIN p ON a.x < p.z)
      SELECT id, round(CASE WHEN z0 IS NULL THEN u1 WHEN z1 IS NULL THEN u0 ELSE u0 + (u1 - u0) * (x - z0) / (z1 - z0) END, 5) + 0e0 AS u FROM l JOIN h USING (id)"""),
    "gaussian_smooth_masked": oracle("wind", "+c AS (SELECT k, j, i, u FROM wind WHERE valid) SELECT a.k, a.j, a.i, round(sum(u2 * w) / greatest(sum(w), 1e-6), 5) + 0e0 AS smooth FROM (SELECT k, j, i FROM wind) a LEFT JOIN (SELECT c.k, c.j + dj AS j, c.i + di AS i, u AS u2, exp(-(dj * dj) / 4.5::DOUBLE) * exp(-(di * di) / 4.5::DOUBLE) AS w FROM c, range(-6, 7) x(dj), range(-6, 7) y(di)) s ON s.k = a.k AND s.j = a.j AND s.i = a.i GROUP BY a.k, a.j, a.i"),
    "blend_weight": oracle("wind", "+v AS (SELECT k, x, y FROM wind WHERE valid AND (i + 3 * j) % 17 = 0) SELECT c.k, c.j, c.i, round(coalesce(exp(-min((c.x - v.x) ** 2 + (c.y - v.y) ** 2) / 128e6), 0), 6) + 0e0 AS weight FROM wind c LEFT JOIN v ON v.k = c.k AND (c.x - v.x) ** 2 + (c.y - v.y) ** 2 <= 48e3 ** 2 GROUP BY c.k, c.j, c.i"),
    "increment_blend": oracle("wind", "SELECT k, j, i, CASE WHEN valid AND (i + 3 * j) % 17 = 0 THEN u ELSE 4e0 + k END AS u FROM wind"),
    "colour_lerp": oracle("cells", f"+l(a, b, r0, r1, g0, g1, b0, b1) AS (VALUES {_LEVELS}), c AS (SELECT *, greatest(-5e0, least(65e0, dbz1)) AS q FROM cells WHERE dbz1 IS NOT NULL) SELECT k, j, i, round((r0 + (r1 - r0) * (q - a) / (b - a)) / 255, 5) + 0e0 AS r, round((g0 + (g1 - g0) * (q - a) / (b - a)) / 255, 5) + 0e0 AS g, round((b0 + (b1 - b0) * (q - a) / (b - a)) / 255, 5) + 0e0 AS b, round(greatest(0.12::DOUBLE, least(1e0, (dbz1 + 5) / 50)), 5) + 0e0 AS alpha FROM c JOIN l ON q >= l.a AND (q < l.b OR l.b = 65 AND q = 65)"),
    "translate_bilinear": oracle("field", f"SELECT t, j, i, round(v, 9) + 0e0 AS v FROM {_sql_move(2.25, -1.5, False)}"),
    "translate_adjoint": oracle("field", f"SELECT t, j, i, round(v, 9) + 0e0 AS v FROM {_sql_move(2.25, -1.5, True)}"),
    "transported_mask": oracle("field", f"SELECT t, j, i FROM {_sql_move(0.5, 1.0, False)} WHERE n = 2"),
    "time_difference": oracle("field", f"SELECT m.t, m.j, m.i, round(f.v - m.v, 7) + 0e0 AS change FROM {_sql_move(0.5, 1.0, False)} m JOIN field f ON f.t = m.t + 1 AND f.j = m.j AND f.i = m.i WHERE n = 2"),
    "temporal_consistency": oracle("field", f"+g AS (SELECT m.t, count(*) AS n, sqrt(avg((f.v - o.v) ** 2)) AS b, sqrt(avg((f.v - m.v) ** 2)) AS a FROM {_sql_move(0.5, 1.0, False)} m JOIN field f ON f.t = m.t + 1 AND f.j = m.j AND f.i = m.i JOIN field o ON o.t = m.t AND o.j = m.j AND o.i = m.i WHERE n = 2 GROUP BY m.t) SELECT t, n, round(b, 4) + 0e0 AS before, round(a, 4) + 0e0 AS after, round(1 - a / b, 4) + 0e0 AS reduction FROM g"),
    "motion_confidence": oracle("field", """+f AS (SELECT t, j, i, greatest(v - 3, 0) AS e FROM field WHERE v IS NOT NULL), s AS (SELECT dj::INT AS dj, di::INT AS di FROM range(-6, 7) a(dj), range(-6, 7) b(di)), z AS (SELECT t, count(*) AS n FROM f GROUP BY t),
      p AS (SELECT f.t, dj, di, f.e AS a, g.e AS b FROM f, s, f g WHERE g.t = f.t + 1 AND g.j = f.j + dj AND g.i = f.i + di),
      sc AS (SELECT t, dj, di, round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 9) AS score, count(*) AS n, count(*) FILTER (WHERE a > 0 OR b > 0) AS u, count(*) FILTER (WHERE a > 0 AND b > 0) AS o FROM p GROUP BY ALL HAVING u >= 25 AND score IS NOT NULL),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, dj, di) AS r FROM sc) WHERE r = 1),
      q AS (SELECT b.t, b.dj, b.di, b.score AS peak, b.o / b.u AS overlap, b.n / least(z.n, y.n) AS finite, abs(b.dj) = 6 OR abs(b.di) = 6 AS at_edge, max(c.score) FILTER (WHERE abs(c.dj - b.dj) > 1 OR abs(c.di - b.di) > 1) AS second, max(c.score) FILTER (WHERE c.dj = b.dj - 1 AND c.di = b.di) AS n, max(c.score) FILTER (WHERE c.dj = b.dj + 1 AND c.di = b.di) AS s,
        max(c.score) FILTER (WHERE c.dj = b.dj AND c.di = b.di - 1) AS w, max(c.score) FILTER (WHERE c.dj = b.dj AND c.di = b.di + 1) AS e FROM b JOIN sc c ON c.t = b.t JOIN z ON z.t = b.t JOIN z y ON y.t = b.t + 1 GROUP BY ALL)
      SELECT t, dj, di, round(CASE WHEN n - 2 * peak + s < 0 THEN greatest(-0.5, least(0.5, 0.5 * (n - s) / (n - 2 * peak + s))) ELSE 0 END, 3) + 0e0 AS oj, round(CASE WHEN w - 2 * peak + e < 0 THEN greatest(-0.5, least(0.5, 0.5 * (w - e) / (w - 2 * peak + e))) ELSE 0 END, 3) + 0e0 AS oi,
        round(peak, 5) + 0e0 AS peak, round(second, 5) + 0e0 AS second, round(peak - second, 5) + 0e0 AS margin, round(overlap, 5) + 0e0 AS overlap, round(finite, 5) + 0e0 AS finite, at_edge,
        CASE WHEN peak >= 0.8 AND overlap >= 0.45 AND coalesce(peak - second >= 0.02, false) AND NOT at_edge THEN 'high' WHEN peak >= 0.6 AND overlap >= 0.25 AND NOT at_edge THEN 'medium' ELSE 'low' END AS confidence FROM q"""),
    "ncc_motion": oracle("field", f"+{_NCC} SELECT * FROM sc"),
    "ncc_peak": oracle("field", f"""+{_NCC}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, dj, di) AS r FROM sc) WHERE r = 1),
      q AS (SELECT b.t, b.dj, b.di, b.score AS peak, max(s.score) FILTER (WHERE abs(s.dj - b.dj) > 1 OR abs(s.di - b.di) > 1) AS second, max(s.score) FILTER (WHERE s.dj = b.dj - 1 AND s.di = b.di) AS n, max(s.score) FILTER (WHERE s.dj = b.dj + 1 AND s.di = b.di) AS o, max(s.score) FILTER (WHERE s.di = b.di - 1 AND s.dj = b.dj) AS w, max(s.score) FILTER (WHERE s.di = b.di + 1 AND s.dj = b.dj) AS e FROM b JOIN sc s USING (t) GROUP BY ALL)
      SELECT t, dj, di, peak, second, round(CASE WHEN n - 2 * peak + o < 0 THEN greatest(-0.5, least(0.5, 0.5::DOUBLE * (n - o) / (n - 2 * peak + o))) ELSE 0 END, 3) + 0e0 AS oj, round(CASE WHEN w - 2 * peak + e < 0 THEN greatest(-0.5, least(0.5, 0.5::DOUBLE * (w - e) / (w - 2 * peak + e))) ELSE 0 END, 3) + 0e0 AS oi FROM q"""),
    "cumulative_shift": "WITH p AS (SELECT s::INT AS start, t::INT AS t, t * 0.5::DOUBLE + 0.25::DOUBLE AS dx, 1.5::DOUBLE - t * 0.25::DOUBLE AS dy FROM range(3) a(s), range(1, 6) b(t) WHERE t > s AND t < s + 4) SELECT start, t, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM p WINDOW w AS (PARTITION BY start ORDER BY t)",
}
