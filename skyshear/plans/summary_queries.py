"""Queries that summarise cells, gates and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyshear.functions.geo import rounded as R  # noqa: N812
from skyshear.model import ANGLE_EDGES, DX, DY, RANGE_EDGES
from skyshear.operators import aggregate, stencil, wind
from skyshear.operators.grid import near_join
from skyshear.plans.views import oracle, view
from skyshear.plans.wind_queries import _SYN, _VW

KEY = ["k", "j", "i"]
#: Volumes of the field view.
VOLUMES = 6


def _beams(s, d):  # noqa: ANN001, ANN202
    return wind.beams(view(s, d, "cells"))


def _residuals(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "wind").filter("valid").select("k", R(F.col("u") - F.col("v") + F.col("w")).alias("r"))


def _gate(s, d):  # noqa: ANN001, ANN202
    return aggregate.quality_gate(view(s, d, "wind").withColumn("res", F.col("u") * 1e-4), "w", "res")


def _stats(s, d):  # noqa: ANN001, ANN202
    x = F.col("dbz1")
    return view(s, d, "cells").groupBy("k").agg(F.count(x).alias("n"), R(F.avg(x), 5).alias("mean"), R(F.percentile(x, F.lit(0.5)), 5).alias("median"), F.min(x).alias("least"), F.max(x).alias("most"))


def _pairs(s, d):  # noqa: ANN001, ANN202
    f = view(s, d, "field")
    later = f.select((F.col("t") - 1).alias("t"), "j", "i", F.col("v").alias("later"))
    return f.join(later, ["t", "j", "i"])


def _circulation(s, d):  # noqa: ANN001, ANN202
    """Vorticity summed around each feature, and how much of its circle is observed."""
    z = stencil.divergence_vorticity(view(s, d, "wind"), DX, DY).filter("k = 2").select("x", "y", R(F.col("vorticity") * 1e4).alias("zeta"))
    near = near_join(view(s, d, "features").select("id", "fx", "fy"), z, ("fx", "fy"), ("x", "y"), 15_000.0)
    area = DX * DY / 1e8
    return near.groupBy("id").agg(R(F.sum(F.col("zeta") * area), 4).alias("circulation"), R(F.sum(F.greatest(F.col("zeta"), F.lit(0.0)) * area), 4).alias("cyclonic"), R(F.avg(F.col("zeta").isNotNull().cast("double"))).alias("coverage"))


def _storm(s, d):  # noqa: ANN001, ANN202
    """Mean wind of the box around each feature (half-open, as slices are) below 6 km."""
    box = (F.col("x") >= F.col("fx") - 20_000) & (F.col("x") < F.col("fx") + 20_000) & (F.col("y") >= F.col("fy") - 20_000) & (F.col("y") < F.col("fy") + 20_000)
    near = near_join(view(s, d, "features").select("id", "fx", "fy"), view(s, d, "wind").filter("z < 6000"), ("fx", "fy"), ("x", "y"), 30_000.0).filter(box)
    return near.groupBy("id").agg(R(F.avg("u"), 5).alias("u"), R(F.avg("v"), 5).alias("v"), F.count("u").alias("n"))


def _tangential(s, d):  # noqa: ANN001, ANN202
    """Share of cells around a feature whose wind, relative to its storm's, turns counterclockwise."""
    w, f = view(s, d, "wind").filter("k = 1"), view(s, d, "features").join(_storm(s, d).select("id", F.col("u").alias("su"), F.col("v").alias("sv")), "id")
    dx, dy = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    near = near_join(f, w, ("fx", "fy"), ("x", "y"), 15_000.0).filter((F.abs(dx) <= 10_000) & (F.abs(dy) <= 10_000))
    t = R((F.col("v") - F.col("sv")) * dx - (F.col("u") - F.col("su")) * dy, 3)
    g = near.filter((dx * dx + dy * dy > 300.0**2) & F.col("valid")).groupBy("id").agg(R(F.avg((t > 0).cast("double")), 5).alias("ratio"), F.count("*").alias("n"))
    return g.withColumn("rotates", F.col("ratio") >= 0.4)


def _updraft(s, d):  # noqa: ANN001, ANN202
    w = view(s, d, "wind").filter("valid").groupBy("j", "i").agg(R(F.avg("w"), 8).alias("mean_w"))
    return w.withColumn("class", F.when(F.col("mean_w") > 0.3, "updraft").when(F.col("mean_w") < -0.3, "downdraft").otherwise("mixed"))


def _height_rmse(s, d):  # noqa: ANN001, ANN202
    w = view(s, d, "wind").filter("valid")
    one = lambda a, b, n: w.select("k", F.lit(n).alias("component"), F.col(a).alias("a"), F.col(b).alias("b"))
    return aggregate.norms(one("u", "v", "u").unionByName(one("v", "w", "v")).unionByName(one("w", "u", "w")), "a", "b", "k", "component")


def _confidence(s, d):  # noqa: ANN001, ANN202
    """Motion confidence from correlation, overlap and distinctness, by rule."""
    f = view(s, d, "features").select("id", ((F.col("id") * 37 % 100) / 100.0).alias("corr"), ((F.col("id") * 53 % 100) / 100.0).alias("overlap"), ((F.col("id") * 7 % 10) / 100.0).alias("gap"), (F.col("id") % 9 == 0).alias("edge"))
    level = F.when((F.col("corr") >= 0.8) & (F.col("overlap") >= 0.45) & (F.col("gap") >= 0.02) & ~F.col("edge"), "high").when((F.col("corr") >= 0.6) & (F.col("overlap") >= 0.25) & ~F.col("edge"), "medium").otherwise("low")
    return f.groupBy(level.alias("confidence")).agg(F.count("*").alias("n"))


def _eligible(s, d):  # noqa: ANN001, ANN202
    """Cells that a rotation may stand in: valid, strong echo, not in the border strip of ceil(3 km / step) cells."""
    z = stencil.divergence_vorticity(view(s, d, "wind"), DX, DY)
    strip = (F.col("i").between(1, 19)) & (F.col("j").between(1, 19))
    return z.filter(F.col("valid") & F.col("vorticity").isNotNull() & (F.col("dbz") >= 30) & strip).groupBy("k").agg(F.count("*").alias("n"), F.max(R(F.col("vorticity") * 1e4)).alias("peak"))


def _fit(s, d):  # noqa: ANN001, ANN202
    return aggregate.harmonic_fit(view(s, d, "gates").select("radar", "sweep", F.col("ray").cast("double").alias("azimuth"), F.col("vr").alias("v")), "radar", "sweep")


def _fit_check(s, d):  # noqa: ANN001, ANN202
    """Fits in a band of heights against two profiles with gaps at their lower ends."""
    gates = view(s, d, "gates").select(F.col("radar").alias("station"), F.col("ray").cast("double").alias("azimuth"), (F.col("gate") * 50.0).alias("height_m"), F.col("vr").alias("v"))
    profile = view(s, d, "profile").select((F.col("level") % 2 + 1).alias("station"), (F.col("level") * 100.0).alias("height_m"), F.when(F.col("level") > 4, F.col("speed")).alias("speed"), "direction")
    return aggregate.fit_against_profile(gates, profile)


def _window_levels(s, d):  # noqa: ANN001, ANN202
    """Gates of four quarters of the horizon as levels, sweeps as times, for each radar."""
    g = view(s, d, "gates").select(F.col("sweep").alias("t"), "radar", F.floor(F.col("ray") / 90).cast("int").alias("k"), "ray", "gate")
    return aggregate.window_levels(g, 0, 5, 9000, by=("radar", "k"), cell=("ray", "gate"))


def _union(s, d):  # noqa: ANN001, ANN202
    """Of each volume and the next one: cells that either observes, and whether both do."""
    return aggregate.with_next(view(s, d, "field").filter("v IS NOT NULL"), VOLUMES).select("t", "j", "i", (F.col("now") & F.col("next")).alias("both"))


def _xor(s, d):  # noqa: ANN001, ANN202
    """Of each volume and the next one: cells above the limit in one of them alone."""
    return aggregate.with_next(view(s, d, "field").filter("v > 5"), VOLUMES).filter("now <> next").select("t", "j", "i")


def _rollup(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "gates").rollup("radar", "sweep").agg(F.count("*").alias("n"), F.count_if(F.abs("vr") > 20).alias("masked"))


def _vortex_summary(s, d):  # noqa: ANN001, ANN202
    w = view(s, d, "cells")
    return w.filter((F.col("z") >= 2000) & (F.col("z") <= 6000)).groupBy("j", "i").agg(F.max(F.greatest("dbz1", "dbz2")).alias("composite"))


_CASES = ", ".join(f"({n}, {lo}, {hi}, {str(n == len(ANGLE_EDGES) - 2).lower()})" for n, (lo, hi) in enumerate(zip(ANGLE_EDGES[:-1], ANGLE_EDGES[1:], strict=True)))
_RANGES = ", ".join(f"({n}, {lo}, {hi})" for n, (lo, hi) in enumerate(zip(RANGE_EDGES, (*RANGE_EDGES[1:], 1_000_000), strict=True)))
_NORMS = "count(*) AS n, round(sqrt(sum((a - b) ** 2)), 5) + 0e0 AS l2, round(sqrt(avg((a - b) ** 2)), 5) + 0e0 AS rmse, round(sqrt(sum((a - b) ** 2)) / nullif(sqrt(sum(b * b)), 0), 5) + 0e0 AS relative"
_STORM = "storm AS (SELECT id, round(avg(u), 5) + 0e0 AS u, round(avg(v), 5) + 0e0 AS v, count(u) AS n FROM features, wind WHERE x >= fx - 2e4 AND x < fx + 2e4 AND y >= fy - 2e4 AND y < fy + 2e4 AND z < 6000 GROUP BY id)"
QUERIES = {
    "coverage_by_height": lambda s, d: aggregate.coverage_by_height(_beams(s, d)),
    "bca_bins": lambda s, d: aggregate.angle_bins(_beams(s, d)),
    "range_bins": lambda s, d: aggregate.range_bins(_beams(s, d)),
    "residual_stats": lambda s, d: aggregate.residual_stats(_residuals(s, d), "r", "k"),
    "quality_gate": _gate,
    "field_stats": _stats,
    "residual_correlation": lambda s, d: view(s, d, "wind").filter("valid").agg(R(F.corr("u", "w"), 5).alias("correlation"), F.count("*").alias("n")),
    "composite_max": _vortex_summary,
    "window_masks": lambda s, d: aggregate.window_masks(view(s, d, "field")),
    "temporal_rmse": lambda s, d: aggregate.norms(_pairs(s, d), "later", "v", "t"),
    "height_rmse": _height_rmse,
    "circulation": _circulation,
    "storm_mean_wind": _storm,
    "tangential_ratio": _tangential,
    "updraft_class": _updraft,
    "confidence_counts": _confidence,
    "meso_eligible": _eligible,
    "vad_harmonic_fit": _fit,
    "vad_profile_check": _fit_check,
    "window_levels": _window_levels,
    "mask_union_intersection": _union,
    "mask_xor": _xor,
    "gate_rollup": _rollup,
}
ORACLES = {
    "coverage_by_height": oracle("cells", _SYN + "SELECT k, round(avg((vr1 IS NOT NULL)::INT), 6) + 0e0 AS radar1, round(avg((vr2 IS NOT NULL)::INT), 6) + 0e0 AS radar2, round(avg((vr1 IS NOT NULL AND vr2 IS NOT NULL)::INT), 6) + 0e0 AS dual, round(avg(ok::INT), 6) + 0e0 AS accepted, round(1 - count(*) FILTER (WHERE ok)::DOUBLE / nullif(count(*) FILTER (WHERE vr1 IS NOT NULL AND vr2 IS NOT NULL), 0), 6) + 0e0 AS rejected_of_dual, count(*) FILTER (WHERE vr1 IS NOT NULL AND vr2 IS NOT NULL) AS dual_count, count(*) FILTER (WHERE ok) AS accepted_count, count(*) AS cells FROM s GROUP BY k"),
    "bca_bins": oracle("cells", _SYN + f", e(bin, lo, hi, last) AS (VALUES {_CASES}), l AS (SELECT k, count(*) AS cells, count(*) FILTER (WHERE vr1 IS NOT NULL AND vr2 IS NOT NULL) AS dual FROM b GROUP BY k), c AS (SELECT k, bin, count(*) AS n FROM b JOIN e ON angle >= lo AND (angle < hi OR last AND angle <= hi) WHERE vr1 IS NOT NULL AND vr2 IS NOT NULL GROUP BY ALL) SELECT k, bin, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / nullif(dual, 0), 6) + 0e0 AS of_dual, round(coalesce(n, 0)::DOUBLE / cells, 6) + 0e0 AS of_level FROM l CROSS JOIN e LEFT JOIN c USING (k, bin)"),
    "range_bins": oracle("cells", _SYN + f", e(bin, lo, hi) AS (VALUES {_RANGES}), q AS (SELECT *, greatest(r1, r2) / 1e3 AS far, vr1 IS NOT NULL AND vr2 IS NOT NULL AS dual FROM b) SELECT bin, count(*) AS cells, count(*) FILTER (WHERE dual) AS dual, round(quantile_cont(angle, 0.5) FILTER (WHERE dual), 5) + 0e0 AS median_angle, round(quantile_cont(far, 0.5) FILTER (WHERE dual), 5) + 0e0 AS median_km FROM q JOIN e ON far >= lo AND far < hi GROUP BY bin"),
    "residual_stats": oracle("wind", "+r AS (SELECT k, round(u - v + w, 6) + 0e0 AS r FROM wind WHERE valid) SELECT k, count(*) AS n, round(avg(r), 5) + 0e0 AS mean, round(sqrt(avg(r * r)), 5) + 0e0 AS rms, round(quantile_cont(abs(r), 0.5), 5) + 0e0 AS median, round(quantile_cont(abs(r), 0.95), 5) + 0e0 AS p95, round(quantile_cont(abs(r), 0.99), 5) + 0e0 AS p99, max(abs(r)) AS largest FROM r GROUP BY k"),
    "quality_gate": oracle("wind", "+g AS (SELECT round(quantile_cont(abs(w), 0.99), 5) + 0e0 AS w_p99, round(quantile_cont(abs(u * 1e-4), 0.95), 5) + 0e0 AS residual_p95 FROM wind WHERE valid) SELECT *, w_p99 <= 15 AND residual_p95 <= 0.005::DOUBLE AS ok FROM g"),
    "field_stats": oracle("cells", "SELECT k, count(dbz1) AS n, round(avg(dbz1), 5) + 0e0 AS mean, round(quantile_cont(dbz1, 0.5), 5) + 0e0 AS median, min(dbz1) AS least, max(dbz1) AS most FROM cells GROUP BY k"),
    "residual_correlation": oracle("wind", "SELECT round(corr(u, w), 5) + 0e0 AS correlation, count(*) AS n FROM wind WHERE valid"),
    "composite_max": oracle("cells", "SELECT j, i, max(greatest(dbz1, dbz2)) AS composite FROM cells WHERE z BETWEEN 2000 AND 6000 GROUP BY j, i"),
    "window_masks": oracle("field", "+s AS (SELECT length, start FROM (VALUES (3), (4), (5)) a(length), range(6) b(start) WHERE start + length <= 6), c AS (SELECT length, start, j, i, count(v) AS n FROM s JOIN field ON t >= start AND t < start + length GROUP BY ALL) SELECT length, start::INT AS start, count(*) FILTER (WHERE n = length) AS everywhen, count(*) AS somewhen, round(count(*) FILTER (WHERE n = length)::DOUBLE / count(*), 6) + 0e0 AS share FROM c GROUP BY ALL"),
    "temporal_rmse": oracle("field", f"+p AS (SELECT f.t, g.v AS a, f.v AS b FROM field f JOIN field g ON g.t = f.t + 1 AND g.j = f.j AND g.i = f.i) SELECT t, {_NORMS} FROM p GROUP BY t"),
    "height_rmse": oracle("wind", f"+p AS (SELECT k, 'u' AS component, u AS a, v AS b FROM wind WHERE valid UNION ALL SELECT k, 'v', v, w FROM wind WHERE valid UNION ALL SELECT k, 'w', w, u FROM wind WHERE valid) SELECT k, component, {_NORMS} FROM p GROUP BY ALL"),
    "circulation": oracle("wind features", f"+{_VW}, q AS (SELECT x, y, round(CASE WHEN valid THEN ((v_ip - v_im) - (u_jp - u_jm)) END, 6) + 0e0 AS zeta FROM n WHERE k = 2) SELECT id, round(sum(zeta * 0.25::DOUBLE), 4) + 0e0 AS circulation, round(sum(greatest(zeta, 0) * 0.25::DOUBLE), 4) + 0e0 AS cyclonic, round(avg((zeta IS NOT NULL)::INT), 6) + 0e0 AS coverage FROM features JOIN q ON (x - fx) ** 2 + (y - fy) ** 2 <= 225e6 GROUP BY id"),
    "storm_mean_wind": oracle("wind features", f"+{_STORM} SELECT * FROM storm"),
    "tangential_ratio": oracle("wind features", f"+{_STORM}, t AS (SELECT f.id, round((w.v - s.v) * (x - fx) - (w.u - s.u) * (y - fy), 3) > 0 AS pos FROM features f JOIN storm s USING (id) JOIN wind w ON k = 1 AND abs(x - fx) <= 1e4 AND abs(y - fy) <= 1e4 WHERE valid AND (x - fx) ** 2 + (y - fy) ** 2 > 9e4) SELECT id, round(avg(pos::INT), 5) + 0e0 AS ratio, count(*) AS n, round(avg(pos::INT), 5) >= 0.4::DOUBLE AS rotates FROM t GROUP BY id"),
    "updraft_class": oracle("wind", "+m AS (SELECT j, i, round(avg(w), 8) + 0e0 AS mean_w FROM wind WHERE valid GROUP BY ALL) SELECT *, CASE WHEN mean_w > 0.3::DOUBLE THEN 'updraft' WHEN mean_w < -0.3::DOUBLE THEN 'downdraft' ELSE 'mixed' END AS class FROM m"),
    "confidence_counts": oracle("features", "+f AS (SELECT (id * 37 % 100) / 1e2 AS c, (id * 53 % 100) / 1e2 AS o, (id * 7 % 10) / 1e2 AS g, id % 9 = 0 AS e FROM features) SELECT CASE WHEN c >= 0.8::DOUBLE AND o >= 0.45::DOUBLE AND g >= 0.02::DOUBLE AND NOT e THEN 'high' WHEN c >= 0.6::DOUBLE AND o >= 0.25::DOUBLE AND NOT e THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM f GROUP BY 1"),
    "meso_eligible": oracle("wind", f"+{_VW}, q AS (SELECT n.k, n.i, n.j, dbz, round(CASE WHEN n.valid THEN ((v_ip - v_im) - (u_jp - u_jm)) END, 6) + 0e0 AS zeta FROM n JOIN wind USING (k, j, i)) SELECT k, count(*) AS n, max(zeta) AS peak FROM q WHERE zeta IS NOT NULL AND dbz >= 30 AND i BETWEEN 1 AND 19 AND j BETWEEN 1 AND 19 GROUP BY k"),
    "vad_profile_check": oracle("gates profile", """+pf AS (SELECT level % 2 + 1 AS station, level * 1e2 AS h, speed, direction FROM profile WHERE level > 4 AND speed > 0), lo AS (SELECT station, min(h) AS h, arg_min(speed, h) AS speed, arg_min(direction, h) AS direction FROM pf GROUP BY station),
      g AS (SELECT station, sin(radians(ray::DOUBLE)) AS s, cos(radians(ray::DOUBLE)) AS c, vr AS v FROM gates JOIN lo ON radar = station WHERE vr IS NOT NULL AND gate * 5e1 BETWEEN h - 150 AND h + 200),
      m AS (SELECT station, count(*) AS samples, count(*)::DOUBLE AS n, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(s) AS s, sum(c) AS c, sum(s * v) AS sv, sum(c * v) AS cv, sum(v) AS v FROM g GROUP BY ALL),
      d AS (SELECT *, ss * (cc * n - c * c) - sc * (sc * n - c * s) + s * (sc * c - cc * s) AS d FROM m),
      e AS (SELECT station, samples, round((sv * (cc * n - c * c) - sc * (cv * n - c * v) + s * (cv * c - cc * v)) / d, 5) + 0e0 AS east, round((ss * (cv * n - c * v) - sv * (sc * n - c * s) + s * (sc * v - cv * s)) / d, 5) + 0e0 AS north, round((ss * (cc * v - cv * c) - sc * (sc * v - cv * s) + sv * (sc * c - cc * s)) / d, 5) + 0e0 AS mean FROM d),
      o AS (SELECT station, samples, mean, round((degrees(atan2(east, north)) + 360) % 360, 4) + 0e0 AS toward, (direction + 180e0) % 360 AS profile_toward, round(-speed * (east * sin(radians(direction::DOUBLE)) + north * cos(radians(direction::DOUBLE))), 4) + 0e0 AS dot FROM e JOIN lo USING (station)),
      a AS (SELECT *, round(least(abs(toward - profile_toward), 360 - abs(toward - profile_toward)), 4) + 0e0 AS apart FROM o) SELECT *, dot > 0 AND apart < 15 AS agrees FROM a"""),
    "window_levels": oracle("gates", """+w AS (SELECT length, start FROM (VALUES (3), (4), (5)) a(length), range(6) b(start) WHERE start + length <= 6), c AS (SELECT length, start, radar, ray // 90 AS k, ray, gate, count(DISTINCT sweep) AS n FROM w JOIN gates ON sweep >= start AND sweep < start + length GROUP BY ALL)
      SELECT length, start::INT AS start, radar, k::INT AS k, count(*) AS "union", count(*) FILTER (WHERE n = length) AS intersection, round(count(*) FILTER (WHERE n = length)::DOUBLE / count(*), 6) + 0e0 AS of_union, round(count(*) FILTER (WHERE n = length) / 9e3, 6) + 0e0 AS of_level FROM c GROUP BY length, start, radar, k"""),
    "vad_harmonic_fit": oracle("gates", """+g AS (SELECT radar, sweep, sin(radians(ray::DOUBLE)) AS s, cos(radians(ray::DOUBLE)) AS c, vr AS v FROM gates WHERE vr IS NOT NULL),
      m AS (SELECT radar, sweep, count(*)::DOUBLE AS n, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(s) AS s, sum(c) AS c, sum(s * v) AS sv, sum(c * v) AS cv, sum(v) AS v FROM g GROUP BY ALL),
      d AS (SELECT *, ss * (cc * n - c * c) - sc * (sc * n - c * s) + s * (sc * c - cc * s) AS d FROM m)
      SELECT radar, sweep, round((sv * (cc * n - c * c) - sc * (cv * n - c * v) + s * (cv * c - cc * v)) / d, 5) + 0e0 AS east, round((ss * (cv * n - c * v) - sv * (sc * n - c * s) + s * (sc * v - cv * s)) / d, 5) + 0e0 AS north, round((ss * (cc * v - cv * c) - sc * (sc * v - cv * s) + sv * (sc * c - cc * s)) / d, 5) + 0e0 AS mean FROM d"""),
    "mask_union_intersection": oracle("field", "+a AS (SELECT t, j, i FROM field WHERE t < 5), b AS (SELECT t - 1 AS t, j, i FROM field WHERE t > 0), u AS (SELECT * FROM a UNION SELECT * FROM b), x AS (SELECT * FROM a INTERSECT SELECT * FROM b) SELECT u.t, u.j, u.i, x.j IS NOT NULL AS both FROM u LEFT JOIN x ON u.t = x.t AND u.j = x.j AND u.i = x.i"),
    "mask_xor": oracle("field", "+a AS (SELECT t, j, i FROM field WHERE t < 5 AND v > 5), b AS (SELECT t - 1 AS t, j, i FROM field WHERE t > 0 AND v > 5) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    "gate_rollup": oracle("gates", "SELECT radar, sweep, count(*) AS n, count(*) FILTER (WHERE abs(vr) > 20) AS masked FROM gates GROUP BY ROLLUP (radar, sweep)"),
}
