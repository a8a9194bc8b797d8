"""Queries on cleaning, attribution, display products and seeds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyshear.functions.geo import rounded as R  # noqa: N812
from skyshear.model import DX, DY, DZ
from skyshear.operators import grid, stencil, wind
from skyshear.plans.views import oracle, view
from skyshear.plans.wind_queries import _SYN, _VW

KEY = ["k", "j", "i"]


def check_options(max_minutes: float, angle: float, window: int, order: int, smallest: int) -> None:
    """Guards of a run's options: a positive tolerance, an angle between 0 and 90, an odd filter window above its order and within the grid."""
    if max_minutes <= 0:
        raise ValueError("the time tolerance must be positive")
    if not 0 < angle < 90:
        raise ValueError("the crossing angle must lie between 0 and 90 degrees")
    if window % 2 == 0 or window <= order or window > smallest:
        raise ValueError("the filter window must be odd, larger than its order and no larger than the grid")


def _clean(s, d):  # noqa: ANN001, ANN202
    """Composite reflectivity: the loader keeps -5 and above, the gridder what is above -5."""
    c = view(s, d, "cells")
    return c.select(*KEY, F.when(F.col("dbz1") >= -5, F.col("dbz1")).alias("loaded"), F.when(F.col("dbz1") > -5, F.col("dbz1")).alias("gridded"))


def _unobserved(s, d):  # noqa: ANN001, ANN202
    n = s.range(21 * 21 * 5).select(F.floor(F.col("id") / 441).cast("int").alias("k"), (F.floor(F.col("id") / 21) % 21).cast("int").alias("j"), (F.col("id") % 21).cast("int").alias("i"))
    seen = view(s, d, "wind").filter("valid").select(*KEY)
    return n.join(seen, KEY, "left_anti").groupBy("k").agg(F.count("*").alias("unobserved"))


def _discrepancy(s, d):  # noqa: ANN001, ANN202
    """The forward operator against the angle form of the same beam."""
    b = wind.beams(view(s, d, "cells")).filter("vr1 IS NOT NULL AND vr2 IS NOT NULL")
    az, el = F.atan2("bx1", "by1"), F.asin("bz1")
    other = F.cos(el) * F.sin(az) * F.col("vr1") + F.cos(el) * F.cos(az) * F.col("vr2") + F.sin(el) * 1.5
    gap = F.abs(wind.radial(F.col("vr1"), F.col("vr2"), F.lit(1.5), 1) - other)
    return b.agg(F.count("*").alias("n"), (F.max(gap) < 1e-9).alias("agrees"), R(F.max(gap)).alias("largest"))


def _attribution(s, d):  # noqa: ANN001, ANN202
    """Continuity residual in flux form and in expanded form, where both are defined."""
    m = stencil.mass_divergence(view(s, d, "wind"))
    dw = stencil.secant(F.when(F.col("valid"), F.col("w")), F.col("z"), "k")
    m = m.withColumn("expanded", F.col("du") + F.col("dv") + dw - F.col("w") / 1e4).filter("d_rho IS NOT NULL AND expanded IS NOT NULL")
    return m.agg(F.count("*").alias("n"), R(F.sqrt(F.avg(F.col("d_rho") ** 2)) * 1e3, 4).alias("flux_rms"), R(F.sqrt(F.avg((F.col("d_rho") - F.col("expanded")) ** 2)) * 1e3, 4).alias("gap_rms"))


def _vortex_mask(s, d):  # noqa: ANN001, ANN202
    z = stencil.divergence_vorticity(view(s, d, "wind"), DX, DY)
    on = F.coalesce(F.abs(R(F.col("vorticity") * 1e4)) > 1.5, F.lit(False)) & F.col("i").between(1, 19) & F.col("j").between(1, 19)
    return z.groupBy("k").agg(F.count_if(on).alias("rotating"))


def _levels(s, d):  # noqa: ANN001, ANN202
    """Isosurface levels: shares of a high percentile of the positive vorticity, none if it is weak."""
    z = stencil.divergence_vorticity(view(s, d, "wind"), DX, DY).select(R(F.col("vorticity") * 1e4).alias("zeta")).filter("zeta > 0.01")
    top = z.agg(F.percentile("zeta", F.lit(0.995)).alias("top"))
    return top.filter("top >= 0.1").select(F.explode(F.array(*[R(F.col("top") * x, 5) for x in (0.3, 0.5, 0.7)])).alias("level"))


def _scale(s, d):  # noqa: ANN001, ANN202
    """Colour scale of speeds, and how much vertical motion is stretched."""
    w = view(s, d, "wind").filter("valid")
    speed = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    g = w.agg(F.percentile(speed, F.lit(0.95)).alias("p"), F.max(speed).alias("h"), F.max(F.abs("w")).alias("w"))
    return g.select(R(F.greatest(F.lit(10.0), F.least(F.col("p"), F.lit(40.0))), 4).alias("speed_top"), R(F.greatest(F.lit(1.5), F.least(F.lit(8.0), 0.35 * F.col("h") / F.col("w"))), 4).alias("w_scale"))


def _arrows(s, d):  # noqa: ANN001, ANN202
    """Every third cell of the lowest level with enough wind."""
    speed = R(F.sqrt(F.col("u") ** 2 + F.col("v") ** 2), 4)
    return view(s, d, "wind").filter("valid AND k = 0 AND i % 3 = 0 AND j % 3 = 0").select("j", "i", speed.alias("speed")).filter("speed >= 0.5")


def _iso(s, d):  # noqa: ANN001, ANN202
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso"), F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("Z")).alias("stamp"))


def _newest(s, d):  # noqa: ANN001, ANN202
    e = s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return e.select("event_type", F.col("m.event_id").alias("newest"))


def _seeds(s, d):  # noqa: ANN001, ANN202
    """Rings of seeds around a centre: 5 radii, 8 angles with a hashed jitter, on valid cells only."""
    n = s.range(40).select((F.col("id") % 5).alias("ring"), F.floor(F.col("id") / 5).alias("angle"))
    jitter = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("ring").cast("string"), F.col("angle").cast("string"))), 1, 6), 16, 10).cast("double") / 16**6 - 0.5) * 0.16
    turn = F.col("angle") * (math.pi / 4) + jitter
    r = 3000.0 + 1500.0 * F.col("ring")
    p = n.withColumns({"sx": r * F.cos(turn), "sy": r * F.sin(turn)})
    at = lambda c: F.floor((F.col(c) + 52_500.0) / 5000.0).cast("int")
    valid = view(s, d, "wind").filter("valid AND k = 1").select("j", "i")
    return p.withColumn("i", at("sx")).withColumn("j", at("sy")).join(valid, ["j", "i"], "left_semi").select("ring", "angle", R(F.col("sx"), 3).alias("x"), R(F.col("sy"), 3).alias("y"))


def _storm_relative(s, d):  # noqa: ANN001, ANN202
    """Volumes of a window moved back to the first one's place, with what is lost at the borders."""
    shifts = s.range(6).select(F.col("id").cast("int").alias("t"), (-1.0 * F.col("id")).alias("dx"), (0.5 * F.col("id")).alias("dy"))
    moved = grid.translate_by(view(s, d, "field"), shifts, ["t"], 15, 15)
    return moved.groupBy("t").agg(F.count("*").alias("cells"), R(F.sum("v"), 5).alias("total"))


QUERIES = {
    "cr_clean": _clean,
    "unobserved_cells": _unobserved,
    "forward_discrepancy": _discrepancy,
    "residual_attribution": _attribution,
    "vortex_mask": _vortex_mask,
    "isosurface_levels": _levels,
    "display_scales": _scale,
    "thinned_arrows": _arrows,
    "timestamp_iso": _iso,
    "newest_result": _newest,
    "ring_seeds": _seeds,
    "storm_relative": _storm_relative,
}
_ZETA = "CASE WHEN valid THEN ((v_ip - v_im) - (u_jp - u_jm)) END"
ORACLES = {
    "cr_clean": oracle("cells", "SELECT k, j, i, CASE WHEN dbz1 >= -5 THEN dbz1 END AS loaded, CASE WHEN dbz1 > -5 THEN dbz1 END AS gridded FROM cells"),
    "unobserved_cells": oracle("wind", "+g AS (SELECT k::INT AS k, j::INT AS j, i::INT AS i FROM range(5) a(k), range(21) b(j), range(21) c(i)) SELECT k, count(*) AS unobserved FROM g WHERE NOT EXISTS (SELECT 1 FROM wind w WHERE w.valid AND w.k = g.k AND w.j = g.j AND w.i = g.i) GROUP BY k"),
    "forward_discrepancy": oracle("cells", _SYN + ", e AS (SELECT abs(bx1 * vr1 + by1 * vr2 + bz1 * 1.5::DOUBLE - (cos(asin(bz1)) * sin(atan2(bx1, by1)) * vr1 + cos(asin(bz1)) * cos(atan2(bx1, by1)) * vr2 + sin(asin(bz1)) * 1.5::DOUBLE)) AS gap FROM b WHERE vr1 IS NOT NULL AND vr2 IS NOT NULL) SELECT count(*) AS n, max(gap) < 1e-9 AS agrees, round(max(gap), 6) + 0e0 AS largest FROM e"),
    "residual_attribution": oracle("wind", f"""+{_VW}, q AS (SELECT *, rho * w AS rw, exp(-(z + 500) / 1e4) * w_kp AS rp, exp(-(z - 500) / 1e4) * w_km AS rm,
        (coalesce(u_ip, u) - coalesce(u_im, u)) / nullif(5e3 * ((u_ip IS NOT NULL)::INT + (u_im IS NOT NULL)::INT), 0) + (coalesce(v_jp, v) - coalesce(v_jm, v)) / nullif(5e3 * ((v_jp IS NOT NULL)::INT + (v_jm IS NOT NULL)::INT), 0) AS h, nullif({DZ} * ((w_kp IS NOT NULL)::INT + (w_km IS NOT NULL)::INT), 0) AS dz FROM n WHERE valid),
      e AS (SELECT h + (coalesce(rp, rw) - coalesce(rm, rw)) / dz / rho AS a, h + (coalesce(w_kp, w) - coalesce(w_km, w)) / dz - w / 1e4 AS b FROM q)
      SELECT count(*) AS n, round(sqrt(avg(a * a)) * 1e3, 4) + 0e0 AS flux_rms, round(sqrt(avg((a - b) ** 2)) * 1e3, 4) + 0e0 AS gap_rms FROM e WHERE a IS NOT NULL AND b IS NOT NULL"""),
    "vortex_mask": oracle("wind", f"+{_VW} SELECT k, count(*) FILTER (WHERE abs(round({_ZETA}, 6)) > 1.5::DOUBLE AND i BETWEEN 1 AND 19 AND j BETWEEN 1 AND 19) AS rotating FROM n GROUP BY k"),
    "isosurface_levels": oracle("wind", f"+{_VW}, q AS (SELECT round({_ZETA}, 6) + 0e0 AS zeta FROM n), t AS (SELECT quantile_cont(zeta, 0.995) AS top FROM q WHERE zeta > 0.01::DOUBLE) SELECT round(top * x, 5) + 0e0 AS level FROM t, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) v(x) WHERE top >= 0.1::DOUBLE"),
    "display_scales": oracle("wind", "+g AS (SELECT quantile_cont(sqrt(u * u + v * v), 0.95) AS p, max(sqrt(u * u + v * v)) AS h, max(abs(w)) AS w FROM wind WHERE valid) SELECT round(greatest(10e0, least(p, 40e0)), 4) + 0e0 AS speed_top, round(greatest(1.5::DOUBLE, least(8e0, 0.35::DOUBLE * h / w)), 4) + 0e0 AS w_scale FROM g"),
    "thinned_arrows": oracle("wind", "+g AS (SELECT j, i, round(sqrt(u * u + v * v), 4) + 0e0 AS speed FROM wind WHERE valid AND k = 0 AND i % 3 = 0 AND j % 3 = 0) SELECT * FROM g WHERE speed >= 0.5::DOUBLE"),
    "timestamp_iso": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, strftime(ts, '%Y%m%d%H%M%S') || 'Z' AS stamp FROM events",
    "newest_result": "SELECT event_type, event_id AS newest FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "ring_seeds": oracle("wind", """+n AS (SELECT ring, angle, angle * (pi() / 4) + (CAST('0x' || md5(ring || ':' || angle)[1:6] AS BIGINT) / 16777216e0 - 0.5::DOUBLE) * 0.16::DOUBLE AS turn, 3e3 + 15e2 * ring AS r FROM range(5) a(ring), range(8) b(angle)),
      p AS (SELECT ring, angle, r * cos(turn) AS x, r * sin(turn) AS y FROM n) SELECT ring, angle, round(p.x, 3) + 0e0 AS x, round(p.y, 3) + 0e0 AS y FROM p WHERE EXISTS (SELECT 1 FROM wind w WHERE w.valid AND w.k = 1 AND w.i = floor((p.x + 525e2) / 5e3) AND w.j = floor((p.y + 525e2) / 5e3))"""),
    "storm_relative": oracle("field", """+m AS (SELECT t::INT AS t, (t // 2 + s)::INT AS sj, -t::INT AS si, CASE WHEN t % 2 = 0 THEN 1e0 ELSE 0.5::DOUBLE END AS w FROM range(6) a(t), range(2) b(s) WHERE t % 2 = 1 OR s = 0), p AS (SELECT t, j + sj AS j, i + si AS i, sum(v * w) AS v FROM field JOIN m USING (t) GROUP BY ALL)
      SELECT t, count(*) AS cells, round(sum(v), 5) + 0e0 AS total FROM p WHERE j BETWEEN 0 AND 14 AND i BETWEEN 0 AND 14 GROUP BY t"""),
}
