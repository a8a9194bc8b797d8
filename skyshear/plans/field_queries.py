"""Queries on operators over fields: adjoints, sampling, composites, profiles, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.model import DX, DY, DZ
from skyshear.operators import grid, lines, stencil, wind
from skyshear.plans.grid_queries import _sql_move
from skyshear.plans.views import oracle, view
from skyshear.plans.wind_queries import _FULL, _SYN, _VW, _full

R = geo.rounded
KEY = ["k", "j", "i"]
SHIFT = (0.5, 1.0, 15, 15)


def _time_adjoint(s, d):  # noqa: ANN001, ANN202
    return grid.time_adjoint(view(s, d, "field").filter("t < 5"), *SHIFT).select("t", "j", "i", R(F.col("v"), 7).alias("v"))


def _mass_adjoint(s, d):  # noqa: ANN001, ANN202
    full = _full(s, view(s, d, "wind").select(*KEY, "u")).select(*KEY, (500.0 + 500.0 * F.col("k")).alias("z"), F.coalesce("u", F.lit(0.0)).alias("value"))
    out = stencil.mass_adjoint(full, {"i": DX, "j": DY, "k": DZ}, {"i": 21, "j": 21, "k": 5})
    return out.select(*KEY, *[R(F.col(c) * 1e4, 7).alias(c) for c in ("au", "av", "aw")])


def _elevations(s, d):  # noqa: ANN001, ANN202
    g = view(s, d, "gates").withColumn("elevation", F.col("sweep") * 1.5 + 0.5)
    return g.groupBy("radar").agg(F.count_distinct("elevation").alias("elevations"), F.min("vr").alias("least"), F.max("vr").alias("most"))


def _weighted(s, d):  # noqa: ANN001, ANN202
    c = wind.beams(view(s, d, "cells")).withColumns({"u": F.col("vr1"), "v": F.col("vr2"), "w": F.lit(1.5)})
    out = wind.weighted_forward(c, tuple(F.coalesce(F.abs(f"dbz{n}"), F.lit(0.0)) for n in (1, 2)))
    return out.select(*KEY, R(F.col("h1"), 5).alias("h1"), R(F.col("h2"), 5).alias("h2"))


def _terrain(s, d):  # noqa: ANN001, ANN202
    """Heights at places in tiles, of which some are missing: 0 there and where a corner is."""
    p = view(s, d, "features").select("id", (F.col("id") % 8).cast("int").alias("t"), (F.col("id") * 37 % 1300 / 100.0).alias("px"), (F.col("id") * 53 % 1300 / 100.0).alias("py"))
    tiles = view(s, d, "field").select("t", "j", "i", F.col("v").alias("value"))
    return grid.bilinear(p, tiles, ("id", "t"), ("t",)).select("id", F.col("t").alias("tile"), R(F.coalesce("value", F.lit(0.0)), 5).alias("height"))


def _trilinear(s, d):  # noqa: ANN001, ANN202
    p = view(s, d, "features").select("id", ((F.col("fx") + 5e4) / 5e3).alias("px"), ((F.col("fy") + 5e4) / 5e3).alias("py"), ((F.col("fz") - 5e2) / 5e2).alias("pz"))
    out = grid.trilinear(p, view(s, d, "wind"), (5, 21, 21), ("u", "v", "w"))
    return out.select("id", *[R(F.col(c), 4).alias(c) for c in "uvw"])


def _lines(s, d):  # noqa: ANN001, ANN202
    """Lines through every feature."""
    seeds = view(s, d, "features").select(F.col("id").alias("seed"), F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fz").alias("z"))
    cells = view(s, d, "wind").filter("valid").select(*KEY, "u", "v", "w")
    return lines.streamlines(seeds, cells, (-5e4, -5e4, 5e2), (DX, DY, DZ), length=500.0, most=60)


def _top_rotations(s, d):  # noqa: ANN001, ANN202
    """The two strongest local maxima of vorticity that a rotation may stand in."""
    z = stencil.divergence_vorticity(view(s, d, "wind"), DX, DY)
    ok = F.col("valid") & (F.col("dbz") >= 30) & F.col("i").between(1, 19) & F.col("j").between(1, 19)
    full = _full(s, z.select(*KEY, F.when(ok, R(F.col("vorticity") * 1e4)).alias("zeta")))
    return stencil.local_maxima(full.select(*KEY, "zeta"), "zeta", {"k": 1, "j": 3, "i": 3}).orderBy(F.col("zeta").desc(), *KEY).limit(2)


def _keep_lines(s, d):  # noqa: ANN001, ANN202
    """Lines that, between their first and last point within 15 km of the centre, have 15 points and span half a kilometre of height."""
    p = view(s, d, "features").select((F.col("id") % 3).alias("line"), F.col("id").alias("seq"), "fx", "fy", "fz")
    near = F.col("fx") ** 2 + F.col("fy") ** 2 <= 15_000.0**2
    ends = p.filter(near).groupBy("line").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    g = p.join(F.broadcast(ends), "line").filter(F.col("seq").between(F.col("a"), F.col("b"))).groupBy("line")  # a row a line
    return g.agg(F.count("*").alias("points"), R(F.max("fz") - F.min("fz"), 3).alias("span")).filter("points >= 15 AND span >= 500")


def _composite(s, d):  # noqa: ANN001, ANN202
    f = view(s, d, "field").select((F.col("t") % 2).alias("station"), (F.col("t") * 150).cast("long").alias("ts"), "j", "i", F.col("v") * 10.0 - 30.0)
    f = f.toDF("station", "ts", "j", "i", "v")
    at = s.range(14 * 14 * 3).select((F.array(F.lit(200), F.lit(420), F.lit(5000))[(F.col("id") % 3).cast("int")]).cast("long").alias("t1"), (F.floor(F.col("id") / 3) % 14 + 0.25).alias("px"), (F.floor(F.col("id") / 42) + 0.5).alias("py"))
    return grid.composite(f, at).select("t1", "px", "py", R(F.col("v"), 5).alias("v"), "stations")


def _profile_mode(s, d):  # noqa: ANN001, ANN202
    """Of several modes of a profile the one with the least mean error; up to 30 levels of 300 m, valid where speed and error are sound."""
    p = view(s, d, "profile").select((F.col("level") % 3).alias("mode"), F.col("level"), "speed", "direction", ((F.col("level") * 7) % 13).cast("double").alias("rms"))
    best = p.groupBy("mode").agg(F.avg("rms").alias("e")).agg(F.min(F.struct("e", "mode")).alias("m")).select(F.col("m.mode").alias("mode"))
    one = p.filter("level <= 30").join(F.broadcast(best), "mode")  # one row
    return one.select("mode", "level", (F.col("level") * 300).alias("height_m"), "speed", "direction", ((F.col("speed") > 0) & (F.col("rms") < 10)).alias("valid"))


def _rmse_valid(s, d):  # noqa: ANN001, ANN202
    """Misfit of one wind to what each radar sees, over samples with weight, value and a solved cell."""
    c = wind.beams(view(s, d, "cells")).withColumn("solved", F.col("k") < 4)
    e = {n: F.col(f"vr{n}") - wind.radial(F.lit(3.0), F.lit(-2.0), F.lit(0.5), n) for n in (1, 2)}
    ok = {n: (F.col(f"dbz{n}") > 0) & F.col(f"vr{n}").isNotNull() & (F.col(f"vr{n}") > -9000) & F.col("solved") for n in (1, 2)}
    return c.agg(*[F.count_if(ok[n]).alias(f"n{n}") for n in (1, 2)], *[R(F.sqrt(F.avg(F.when(ok[n], e[n] * e[n]))), 5).alias(f"rmse{n}") for n in (1, 2)])


def _counts(s, d):  # noqa: ANN001, ANN202
    """What a volume's masks hold, by level."""
    b = wind.beams(view(s, d, "cells"))
    v1, v2 = F.col("vr1").isNotNull(), F.col("vr2").isNotNull()
    ok = v1 & v2 & (F.col("angle") >= 20)
    return b.groupBy("k").agg(F.count_if(v1).alias("radar1"), F.count_if(v2).alias("radar2"), (F.count("vr1") + F.count("vr2")).alias("samples"), F.count_if(v1 | v2).alias("either"), F.count_if(v1 & v2).alias("dual"), F.count_if(ok).alias("effective"), F.count_if(ok & (F.greatest("dbz1", "dbz2") >= 30)).alias("strong"))


QUERIES = {
    "time_adjoint": _time_adjoint,
    "mass_adjoint": _mass_adjoint,
    "elevation_counts": _elevations,
    "weighted_forward": _weighted,
    "terrain_sample": _terrain,
    "trilinear_wind": _trilinear,
    "wind_streamlines": _lines,
    "top_rotations": _top_rotations,
    "streamline_keep": _keep_lines,
    "reflectivity_composite": _composite,
    "profile_mode": _profile_mode,
    "residual_rmse_valid": _rmse_valid,
    "volume_counts": _counts,
}


def _scatter(axis: str, size: int, step: float, value: str) -> str:
    """SQL of the transpose of a difference along an axis, as a table of k, j, i, g."""
    keys = ", ".join(c if c != axis else f"t AS {axis}" for c in "kji")
    rest = ", ".join(c for c in "kji" if c != axis)
    gap = f"((least({axis} + 1, {size - 1}) - greatest({axis} - 1, 0)) * {step}::DOUBLE)"
    return f"(SELECT {keys}, sum(g) AS g FROM (SELECT {rest}, least({axis} + 1, {size - 1}) AS t, {value} / {gap} AS g FROM f UNION ALL SELECT {rest}, greatest({axis} - 1, 0), -({value}) / {gap} FROM f) GROUP BY ALL)"


_RHO = lambda k: f"exp(-(500 + 500 * {k}) / 1e4)"
_ERR = lambda n: f"(vr{n} - (bx{n} * 3 - by{n} * 2 + bz{n} * 0.5::DOUBLE))"
_OK = lambda n: f"dbz{n} > 0 AND vr{n} > -9000 AND k < 4"
ORACLES = {
    "time_adjoint": oracle("field", f"+p AS (SELECT t + 1 AS t, j, i, v FROM field WHERE t < 5 UNION ALL SELECT t, j, i, -v FROM {_sql_move(0.5, 1.0, True)} WHERE t < 5) SELECT t::INT AS t, j, i, round(sum(v), 7) + 0e0 AS v FROM p GROUP BY ALL"),
    "mass_adjoint": oracle("wind", f"+{_FULL} SELECT k, j, i, round(a.g * 1e4, 7) + 0e0 AS au, round(b.g * 1e4, 7) + 0e0 AS av, round(c.g * {_RHO('k')} * 1e4, 7) + 0e0 AS aw FROM {_scatter('i', 21, DX, 'u')} a JOIN {_scatter('j', 21, DY, 'u')} b USING (k, j, i) JOIN {_scatter('k', 5, DZ, 'u / ' + _RHO('k'))} c USING (k, j, i)"),
    "elevation_counts": oracle("gates", "SELECT radar, count(DISTINCT sweep * 1.5::DOUBLE + 0.5::DOUBLE) AS elevations, min(vr) AS least, max(vr) AS most FROM gates GROUP BY radar"),
    "weighted_forward": oracle("cells", _SYN + "SELECT k, j, i, " + ", ".join(f"round(sqrt(coalesce(abs(dbz{n}), 0)) * CASE WHEN vr{n} IS NULL THEN 0 ELSE bx{n} * coalesce(vr1, 0) + by{n} * coalesce(vr2, 0) + bz{n} * 1.5::DOUBLE END, 5) + 0e0 AS h{n}" for n in (1, 2)) + " FROM b"),
    "terrain_sample": oracle("features field", """+p AS (SELECT id, (id % 8)::INT AS t, id * 37 % 1300 / 1e2 AS px, id * 53 % 1300 / 1e2 AS py FROM features),
      c AS (SELECT id, p.t, count(v) AS n, sum(round((1 - abs(px - (floor(px) + a))) * (1 - abs(py - (floor(py) + b))) * v, 12)::DECIMAL(27,12)) AS h FROM p, range(2) x(a), range(2) y(b) LEFT JOIN field f ON f.t = p.t AND f.i = floor(px) + a AND f.j = floor(py) + b GROUP BY ALL)
      SELECT id, t AS tile, round(CASE WHEN n = 4 THEN h ELSE 0 END, 5)::DOUBLE + 0e0 AS height FROM c"""),
    "trilinear_wind": oracle("wind features", """+p AS (SELECT id, (fx + 5e4) / 5e3 AS px, (fy + 5e4) / 5e3 AS py, (fz - 5e2) / 5e2 AS pz FROM features),
      c AS (SELECT id, floor(px) BETWEEN 0 AND 19 AND floor(py) BETWEEN 0 AND 19 AND floor(pz) BETWEEN 0 AND 3 AS ok, u, v, w, (1 - abs(px - (floor(px) + a))) * (1 - abs(py - (floor(py) + b))) * (1 - abs(pz - (floor(pz) + e))) AS g FROM p, range(2) x(a), range(2) y(b), range(2) q(e) LEFT JOIN wind ON i = floor(px) + a AND j = floor(py) + b AND k = floor(pz) + e)
      SELECT id, """ + ", ".join(f"round(sum(CASE WHEN ok THEN g * coalesce({c}, 0) ELSE 0 END), 4) + 0e0 AS {c}" for c in "uvw") + " FROM c GROUP BY id"),
    "top_rotations": oracle("wind", f"+{_VW}, q AS (SELECT n.k, n.j, n.i, round(CASE WHEN n.valid THEN ((v_ip - v_im) - (u_jp - u_jm)) END, 6) + 0e0 AS zeta FROM n JOIN wind USING (k, j, i) WHERE dbz >= 30 AND n.i BETWEEN 1 AND 19 AND n.j BETWEEN 1 AND 19), z AS (SELECT * FROM q WHERE zeta IS NOT NULL) SELECT * FROM z c WHERE NOT EXISTS (SELECT 1 FROM z o WHERE abs(o.k - c.k) <= 1 AND abs(o.j - c.j) <= 3 AND abs(o.i - c.i) <= 3 AND o.zeta > c.zeta) ORDER BY zeta DESC, k, j, i LIMIT 2"),
    "streamline_keep": oracle("features", "+p AS (SELECT id % 3 AS line, id AS seq, fz, fx ** 2 + fy ** 2 <= 225e6 AS near FROM features), e AS (SELECT line, min(seq) FILTER (WHERE near) AS a, max(seq) FILTER (WHERE near) AS b FROM p GROUP BY line) SELECT line, count(*) AS points, round(max(fz) - min(fz), 3) + 0e0 AS span FROM p JOIN e USING (line) WHERE seq BETWEEN a AND b GROUP BY line HAVING count(*) >= 15 AND round(max(fz) - min(fz), 3) >= 500"),
    "reflectivity_composite": oracle("field", """+q AS (SELECT t % 2 AS station, t * 150 AS ts, j, i, CASE WHEN v * 10 - 30 >= -20 THEN v * 10 - 30 END AS v FROM field), m AS (SELECT DISTINCT station, ts FROM q),
      n AS (SELECT station, t1, ts FROM (SELECT station, t1, ts, row_number() OVER (PARTITION BY station, t1 ORDER BY abs(ts - t1), ts) AS r FROM m, (VALUES (200), (420), (5000)) w(t1) WHERE abs(ts - t1) <= 180) WHERE r = 1),
      c AS (SELECT n.t1, n.station, x AS i0, y AS j0, count(v) AS found, sum(round(CASE WHEN a = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * 0.5::DOUBLE * v, 12)::DECIMAL(27,12)) AS s FROM n, range(14) p(x), range(14) r(y), range(2) d(a), range(2) e(b) LEFT JOIN q ON q.station = n.station AND q.ts = n.ts AND q.i = x + a AND q.j = y + b GROUP BY ALL)
      SELECT t1::BIGINT AS t1, i0 + 0.25::DOUBLE AS px, j0 + 0.5::DOUBLE AS py, round(max(s), 5)::DOUBLE + 0e0 AS v, count(*) AS stations FROM c WHERE found = 4 GROUP BY ALL"""),
    "profile_mode": oracle("profile", "+p AS (SELECT level % 3 AS mode, level, speed, direction, (level * 7 % 13)::DOUBLE AS rms FROM profile), m AS (SELECT mode, avg(rms) AS e FROM p GROUP BY mode ORDER BY e, mode LIMIT 1) SELECT mode, level, level * 300 AS height_m, speed, direction, speed > 0 AND rms < 10 AS valid FROM p JOIN m USING (mode) WHERE level <= 30"),
    "residual_rmse_valid": oracle("cells", _SYN + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {_OK(n)}) AS n{n}, round(sqrt(avg({_ERR(n)} ** 2) FILTER (WHERE {_OK(n)})), 5) + 0e0 AS rmse{n}" for n in (1, 2)) + " FROM b"),
    "volume_counts": oracle("cells", _SYN + ", q AS (SELECT *, vr1 IS NOT NULL AS a, vr2 IS NOT NULL AS e, greatest(dbz1, dbz2) AS top FROM b) SELECT k, count(*) FILTER (WHERE a) AS radar1, count(*) FILTER (WHERE e) AS radar2, count(vr1) + count(vr2) AS samples, count(*) FILTER (WHERE a OR e) AS either, count(*) FILTER (WHERE a AND e) AS dual, count(*) FILTER (WHERE a AND e AND angle >= 20) AS effective, count(*) FILTER (WHERE a AND e AND angle >= 20 AND top >= 30) AS strong FROM q GROUP BY k"),
}
