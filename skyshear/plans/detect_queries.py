"""Queries on detection, tensors and iterative kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyshear.functions.geo import rounded as R  # noqa: N812
from skyshear.model import DX, DY, DZ, MESO
from skyshear.operators import boxes, grid, kernels, polar, stencil, tensor, variational, wind
from skyshear.operators.graph import components
from skyshear.plans.views import oracle, view
from skyshear.plans.wind_queries import _BEAMS, _VW

ZETA_LEAST = 2.0  # of u and v differences over 10 km, in 1e-4 / s


def _zeta(s, d):  # noqa: ANN001, ANN202
    z = stencil.divergence_vorticity(view(s, d, "wind"), DX, DY)
    return z.select("k", "j", "i", "x", "y", "z", "dbz", R(F.col("vorticity") * 1e4).alias("zeta")).filter("zeta IS NOT NULL")


def _nms(s, d):  # noqa: ANN001, ANN202
    cells = _zeta(s, d).select(F.lit(0).alias("case"), "i", "j", "k", "zeta")
    return kernels.rotations(cells, least=ZETA_LEAST, apart=2, layers=MESO["layers"], most=MESO["most"])


def _levels(s, d):  # noqa: ANN001, ANN202
    """Levels of each column whose 3 x 3 surroundings reach half the least vorticity."""
    z = _zeta(s, d).filter(F.col("zeta") >= 0.5 * ZETA_LEAST).select("k", "j", "i")
    box = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = z.withColumn("s", box).select("k", (F.col("j") + F.col("s.a")).alias("j"), (F.col("i") + F.col("s.b")).alias("i")).distinct()
    return near.filter(F.col("i").between(0, 20) & F.col("j").between(0, 20)).groupBy("j", "i").agg(F.count("*").alias("levels"))


def _match(s, d):  # noqa: ANN001, ANN202
    """Each strong cell's nearest feature by horizontal distance, and whether it is near enough in both directions."""
    f = view(s, d, "features").select("id", "fx", "fy", "fz")
    peaks = _zeta(s, d).filter("zeta >= 2.5").select("k", "j", "i", "x", "y", "z")
    best = grid.nearest(peaks, f, ["k", "j", "i"], ("x", "y"), ("fx", "fy"), 15_000.0, "id")
    near, dz = F.sqrt("d2"), F.abs(F.col("z") - F.col("fz"))
    return best.select("k", "j", "i", "id", R(near, 4).alias("distance"), ((near <= 15_000) & (dz <= 3000)).alias("matched"))


def _nearest_cell(s, d):  # noqa: ANN001, ANN202
    """The grid cell of each feature, the lower index on ties, clipped to the domain."""
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(20), F.ceil((F.col(c) + 50_000.0) / 5000.0 - 0.5).cast("int")))
    return view(s, d, "features").select("id", at("fx").alias("i"), at("fy").alias("j"), F.greatest(F.lit(0), F.least(F.lit(4), F.ceil((F.col("fz") - 500.0) / 500.0 - 0.5).cast("int"))).alias("k"))


def _neighbourhood(s, d):  # noqa: ANN001, ANN202
    """What surrounds each feature: cells within 5 km and one level."""
    f, c = _nearest_cell(s, d).withColumnRenamed("k", "fk").select("id", "fk").join(view(s, d, "features"), "id"), view(s, d, "cells")
    near = grid.near_join(f, c, ("fx", "fy"), ("x", "y"), 5000.0).filter(F.abs(F.col("k") - F.col("fk")) <= 1)
    return near.groupBy("id").agg(F.count("*").alias("cells"), F.count("vr1").alias("seen1"), F.count("vr2").alias("seen2"), F.max("dbz1").alias("dbz"))


def _polar(s, d):  # noqa: ANN001, ANN202
    """Gates of radar 1 around each feature: same sweep, 1.5 degrees and 2 gates at most."""
    off = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(g).alias("g")) for a in (-1, 0, 1) for g in range(-2, 3)]))
    f = view(s, d, "features").withColumn("o", off)
    f = f.select("id", F.pmod(F.col("id") * 7 + F.col("o.a"), F.lit(360)).cast("int").alias("ray"), (F.col("id") * 3 % 100 + F.col("o.g")).cast("int").alias("gate"), (F.col("id") % 6).cast("int").alias("sweep"))
    near = f.join(view(s, d, "gates").filter("radar = 1"), ["sweep", "ray", "gate"])
    return near.groupBy("id").agg(F.count("*").alias("gates"), F.count_if(F.abs("vr") <= 20).alias("passed"))


def _support(s, d):  # noqa: ANN001, ANN202
    """What both radars measured around each feature, and why its cell has a wind or none."""
    f = view(s, d, "features").select("id", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fz").alias("z"))
    gates = view(s, d, "gates").select("radar", "sweep", (F.col("sweep") * 1.5 + 0.5).alias("elevation"), F.col("ray").cast("double").alias("azimuth"), (F.col("gate") * 1000.0 + 500.0).alias("range_m"), F.when(F.abs("vr") <= 20, F.col("vr")).alias("value"))
    at = lambda c, step, first: F.floor((F.col(c) - first) / step + 0.5).cast("int")
    cell = f.select("id", at("z", DZ, 500.0).alias("k"), (at("y", DY, 0.0) + 10).alias("j"), (at("x", DX, 0.0) + 10).alias("i"))
    cells = wind.beams(view(s, d, "cells")).select("k", "j", "i", "vr1", "vr2", "angle", "dbz1")
    seen = cell.join(cells, ["k", "j", "i"], "left")
    reason = polar.why(F.col("vr1").isNotNull(), F.col("vr2").isNotNull(), F.coalesce(F.col("angle") >= 20, F.lit(False)), F.coalesce(F.col("dbz1") > 10, F.lit(False)))
    return polar.support(f, gates).join(seen, "id").withColumn("reason", reason).drop("k", "j", "i", "vr1", "vr2", "angle", "dbz1")


def _cuboid(s, d):  # noqa: ANN001, ANN202
    cells = view(s, d, "wind").select(F.lit(0).alias("case"), "k", "j", "i", F.col("u").isNotNull().alias("valid"))
    return boxes.largest(cells)


def _rectangle(s, d):  # noqa: ANN001, ANN202
    cells = view(s, d, "wind").select(F.col("k").alias("case"), F.lit(0).alias("k"), "j", "i", F.col("valid").alias("valid"))
    return boxes.largest(cells).select("case", "cells")


def _components(s, d):  # noqa: ANN001, ANN202
    """Face-connected regions of strong cells, named by their least cell; small ones dropped."""
    c = view(s, d, "cells").filter("dbz1 >= 54").select((F.col("k") * 441 + F.col("j") * 21 + F.col("i")).cast("long").alias("id"), "k", "j", "i")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(e).alias("e")) for a, b, e in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]))
    ahead = c.withColumn("s", steps).select(F.col("id").alias("a"), (F.col("k") + F.col("s.a")).alias("k"), (F.col("j") + F.col("s.b")).alias("j"), (F.col("i") + F.col("s.e")).alias("i"))
    links = ahead.join(c.withColumnRenamed("id", "b"), ["k", "j", "i"]).select("a", "b")
    named = c.join(components(links), "id", "left").select(F.coalesce("component", "id").alias("component"))
    return named.groupBy("component").agg(F.count("*").alias("cells")).filter("cells >= 3")


def _box(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "wind").filter("valid AND dbz > 55").agg(*[f(c).alias(f"{c}_{n}") for c in "kji" for f, n in ((F.min, "low"), (F.max, "high"))])


def _best_level(s, d):  # noqa: ANN001, ANN202
    """The level, of the lower two thirds, with the largest absolute vorticity."""
    g = _zeta(s, d).filter("k < 3").groupBy("k").agg(F.max(F.abs("zeta")).alias("peak"))
    return g.orderBy(F.col("peak").desc(), "k").limit(1)


def _clip(s, d):  # noqa: ANN001, ANN202
    """Polylines cut into runs inside a box, of two points or more."""
    p = view(s, d, "features").select((F.col("id") % 7).alias("line"), F.col("id").alias("seq"), "fx", "fy")
    inside = (F.abs("fx") <= 35_000) & (F.abs("fy") <= 30_000)
    run = F.row_number().over(Window.partitionBy("line").orderBy("seq"))
    hit = p.withColumn("n", run).filter(inside)
    hit = hit.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("line").orderBy("seq")))
    return hit.groupBy("line", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("points")).filter("points >= 2").drop("run")


def _trim(s, d):  # noqa: ANN001, ANN202
    """Lines from their first to their last point within 15 km of the centre, what lies between included."""
    p = view(s, d, "features").select((F.col("id") % 3).alias("line"), F.col("id").alias("seq"), "fx", "fy")
    near = F.col("fx") ** 2 + F.col("fy") ** 2 <= 15_000.0**2
    w = Window.partitionBy("line")
    q = p.withColumn("a", F.min(F.when(near, F.col("seq"))).over(w)).withColumn("b", F.max(F.when(near, F.col("seq"))).over(w))
    return q.filter(F.col("seq").between(F.col("a"), F.col("b"))).groupBy("line").agg(F.count("*").alias("points"), F.min("seq").alias("first"), F.max("seq").alias("last"))


# --- tensors -------------------------------------------------------------------------------------
def _gram(s, d):  # noqa: ANN001, ANN202
    """Gram matrix of the tensor's columns."""
    return kernels.gram(view(s, d, "tensor"), "col", "row", "value").select("p", "q", R(F.col("g"), 5).alias("g"))


def _product(s, d):  # noqa: ANN001, ANN202
    """Mode product with a fixed 64 x 4 matrix."""
    t = view(s, d, "tensor")
    m = s.range(256).select((F.col("id") % 64).cast("int").alias("col"), (F.col("id") / 64).cast("int").alias("out")).withColumn("m", ((F.col("col") * 7 + F.col("out") * 3) % 11 - 5).cast("double"))
    return t.join(F.broadcast(m), "col").groupBy("row", "out").agg(R(F.sum(F.col("value") * F.col("m")), 5).alias("value"))


def _error(s, d):  # noqa: ANN001, ANN202
    """Relative error of label means as an approximation of the tensor, by column."""
    t = view(s, d, "tensor")
    m = t.groupBy("label", "col").agg(F.avg("value").alias("mean"))
    j = t.join(F.broadcast(m), ["label", "col"])
    return j.groupBy("col").agg(R(F.sqrt(F.sum((F.col("value") - F.col("mean")) ** 2)) / F.sqrt(F.sum(F.col("value") ** 2)), 5).alias("error"))


def _ranks(s, d):  # noqa: ANN001, ANN202
    """Ranks of five named rules for each tensor shape, and the numbers of parameters."""
    shape = view(s, d, "features").select("id", (F.col("id") % 40 + 2).alias("nx"), (F.col("id") % 30 + 3).alias("ny"), (F.col("id") % 12 + 1).alias("nz"), (F.col("id") % 4 + 2).alias("nt"))
    part = lambda n, share: F.least(F.col(n), F.greatest(F.when(F.col(n) == 1, 1).otherwise(2), F.ceil(share * F.col(n))))
    rules = {"aggressive_temporal": (0.125, 0.25, 1), "compact_temporal": (0.25, 0.5, 2), "moderate_temporal": (0.5, 0.75, 3), "compact_rt_full": (0.25, 0.5, 0), "moderate_rt_full": (0.5, 0.75, 0)}
    each = [F.struct(F.lit(n).alias("rule"), part("nx", a).alias("rx"), part("ny", a).alias("ry"), part("nz", b).alias("rz"), (F.least(F.col("nt"), F.lit(t)) if t else F.col("nt")).alias("rt")) for n, (a, b, t) in rules.items()]
    r = shape.withColumn("r", F.explode(F.array(*each))).select("id", "nx", "ny", "nz", "nt", "r.*")
    size = F.col("rx") * F.col("ry") * F.col("rz") * F.col("rt") * 3 + F.col("nx") * F.col("rx") + F.col("ny") * F.col("ry") + F.col("nz") * F.col("rz") + F.col("nt") * F.col("rt") + 9
    return r.select("id", "rule", "rx", "ry", "rz", "rt", size.cast("long").alias("parameters"))


def _blocks(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "tensor").select((F.col("label") % 3).alias("case"), (F.col("row") % 10).cast("int").alias("i0"), (F.col("col") % 8).alias("i1"), (F.col("col") / 8).cast("int").alias("i2"), "value").groupBy("case", "i0", "i1", "i2").agg(F.avg("value").alias("value"))


def _masked(s, d):  # noqa: ANN001, ANN202
    hidden = F.when((F.col("i0") + 2 * F.col("i1") + 3 * F.col("i2")) % 10 != 0, F.col("value"))
    return kernels.tucker(_blocks(s, d).withColumn("value", hidden), (4, 4, 4), rounds=6)


def _spectrum(s, d):  # noqa: ANN001, ANN202
    return kernels.spectrum(view(s, d, "tensor").select("col", "row", "value"), "col", "row", "value")


def _time_modes(s, d):  # noqa: ANN001, ANN202
    """Singular values of the volumes as rows: how much of the field stays the same in time."""
    f = view(s, d, "field").select("t", (F.col("j") * 15 + F.col("i")).alias("cell"), "v")
    return kernels.spectrum(f, "t", "cell", "v")


def _vortex_lines(s, d):  # noqa: ANN001, ANN202
    seeds = s.range(12).select(F.col("id").alias("seed"), (F.col("id") * 0.7 + 1).alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 0.1).alias("z"))
    return kernels.streamlines(seeds, lambda p: (-p[1], p[0], 0.1), (0, 0, 0), (1, 1, 1), length=0.5, most=40)


def _variational(s, d):  # noqa: ANN001, ANN202
    """The closed loop: a rotating wind seen by both radars, solved back."""
    from skyshear.plans.wind_queries import _vortex_cells

    c = _vortex_cells(s, d).withColumns({"case": F.lit(0), "u0": F.lit(0.0), "v0": F.lit(0.0)})
    return variational.solve(c.select("case", "k", "j", "i", "z", *[f"b{a}{n}" for n in (1, 2) for a in "xyz"], "vr1", "vr2", "u0", "v0"), weights=(100.0, 1e-6, 1.0, 1e-2), steps=(DX, DY, DZ), most=3000).select("case", "k", "j", "i", "u", "v", "w", "iterations", "residual")


_ZETA = f"{_VW}, q AS (SELECT n.k, n.j, n.i, n.x, n.y, n.z, dbz, round(CASE WHEN n.valid THEN ((v_ip - v_im) - (u_jp - u_jm)) END, 6) + 0e0 AS zeta FROM n JOIN wind USING (k, j, i)), zz AS (SELECT * FROM q WHERE zeta IS NOT NULL)"
_CELL = "least({1}, greatest(0, ceil({0} - 0.5)))::INT"
#: Winds by time, level, row, column and component, for either engine; some places have none.
_WINDS = """SELECT CAST(l_suppkey % 4 AS INT) AS t, CAST(l_partkey % 3 AS INT) AS k, CAST(l_orderkey % 8 AS INT) AS j, CAST(l_orderkey % 7 AS INT) AS i, l_quantity - 255e-1 AS u, round(l_discount * 1e2) AS v, round(l_tax * 1e2) AS w
    FROM lineitem WHERE (l_suppkey % 4 + l_orderkey % 8 + l_orderkey % 7) % 9 <> 2"""
_MODES = ("m", "k", "j", "i", "c")  # times are a mode here, not cases


def _winds(s, d):  # noqa: ANN001, ANN202
    rows = s.sql(_WINDS.replace("lineitem", "{lineitem}"), lineitem=s.read.parquet(f"{d}/lineitem.parquet")).groupBy("t", "k", "j", "i").agg(*[F.round(F.avg(c), 4).alias(c) for c in "uvw"])
    return rows.select(F.col("t").alias("m"), "k", "j", "i", F.posexplode(F.array("u", "v", "w")).alias("c", "value"))


def _wind_gram(s, d):  # noqa: ANN001, ANN202
    return tensor.gram(_winds(s, d), "j", _MODES).select("p", "q", R(F.col("g"), 3).alias("g"))


def _wind_fit(s, d):  # noqa: ANN001, ANN202
    """All components, levels and times together, with what is missing filled once."""
    return tensor.fit(_winds(s, d), _MODES, (2, 2, 4, 4, 3), 1).select("cells", R(F.col("error"), 4).alias("error"), "parameters")


QUERIES = {
    "wind_gram": _wind_gram,
    "wind_tucker": _wind_fit,
    "meso_nms": _nms,
    "vertical_continuity": _levels,
    "m_product_match": _match,
    "feature_nearest_cell": _nearest_cell,
    "feature_neighbourhood": _neighbourhood,
    "feature_polar_support": _polar,
    "polar_reasons": _support,
    "largest_cuboid": _cuboid,
    "largest_rectangle": _rectangle,
    "components_label": _components,
    "mask_bounding_box": _box,
    "best_plot_level": _best_level,
    "polyline_clip": _clip,
    "streamline_trim": _trim,
    "mode_gram": _gram,
    "mode_product": _product,
    "relative_error": _error,
    "rank_rules": _ranks,
    "st_hosvd": lambda s, d: kernels.tucker(_blocks(s, d), (4, 4, 4)),
    "masked_st_hosvd": _masked,
    "mode_spectrum": _spectrum,
    "spectral_ranks": lambda s, d: kernels.spectral_ranks(_spectrum(s, d)),
    "time_mode_spectrum": _time_modes,
    "streamline_rk4": _vortex_lines,
    "threedvar_cg": _variational,
}
def _boxes(mask: str) -> str:
    """SQL of all boxes of the 5 x 21 x 21 grid with their valid cells, from sums over everything below a corner."""
    at = " ".join(f"JOIN p p{n} ON p{n}.k = {k} - 1 AND p{n}.j = {j} - 1 AND p{n}.i = {i} - 1" for n, (k, j, i) in enumerate((k, j, i) for k in ("k0", "k1") for j in ("j0", "j1") for i in ("i0", "i1")))
    count = " ".join(f"{'+' if n.bit_count() % 2 else '-'} p{n}.v" for n in range(8))
    return f"""+m AS ({mask}), g AS (SELECT a.k::INT AS k, b.j::INT AS j, c.i::INT AS i, (m.k IS NOT NULL)::INT AS v FROM range(-1, 5) a(k), range(-1, 21) b(j), range(-1, 21) c(i) LEFT JOIN m ON m.k = a.k AND m.j = b.j AND m.i = c.i),
      s1 AS (SELECT k, j, i, sum(v) OVER (PARTITION BY k, j ORDER BY i) AS v FROM g), s2 AS (SELECT k, j, i, sum(v) OVER (PARTITION BY k, i ORDER BY j) AS v FROM s1), p AS (SELECT k, j, i, sum(v) OVER (PARTITION BY j, i ORDER BY k) AS v FROM s2),
      b AS (SELECT k0::INT AS k0, k1::INT AS k1, j0::INT AS j0, j1::INT AS j1, i0::INT AS i0, i1::INT AS i1, ((k1 - k0) * (j1 - j0) * (i1 - i0))::INT AS cells FROM range(5) x0(k0), range(1, 6) x1(k1), range(21) y0(j0), range(1, 22) y1(j1), range(21) z0(i0), range(1, 22) z1(i1) WHERE k1 > k0 AND j1 > j0 AND i1 > i0),
      full_box AS (SELECT b.* FROM b {at} WHERE {count.lstrip('+ ')} = cells)"""


ORACLES = {
    "wind_gram": f"WITH r AS ({_WINDS}), g AS (SELECT t, k, j, i, round(avg(u), 4) AS u, round(avg(v), 4) AS v, round(avg(w), 4) AS w FROM r GROUP BY ALL) SELECT a.j AS p, b.j AS q, round(sum(a.u * b.u + a.v * b.v + a.w * b.w), 3) + 0e0 AS g FROM g a JOIN g b ON a.t = b.t AND a.k = b.k AND a.i = b.i AND a.j <= b.j GROUP BY ALL",
    "largest_cuboid": oracle("wind", _boxes("SELECT k, j, i FROM wind WHERE u IS NOT NULL") + " SELECT 0 AS case, cells, k0, k1, j0, j1, i0, i1 FROM full_box ORDER BY cells DESC, k0, k1, j1, i1, i0 DESC LIMIT 1"),
    "largest_rectangle": oracle("wind", _boxes("SELECT k, j, i FROM wind WHERE valid") + " SELECT k0 AS case, max(cells) AS cells FROM full_box WHERE k1 = k0 + 1 GROUP BY k0"),
    "meso_nms": oracle("wind", f"""+{_ZETA}, lv AS (SELECT DISTINCT k, j + a AS j, i + b AS i FROM zz, range(-1, 2) x(a), range(-1, 2) y(b) WHERE zeta >= {0.5 * ZETA_LEAST}), dp AS (SELECT j, i, count(*) AS levels FROM lv GROUP BY ALL),
      r AS (SELECT 0 AS turn, [NULL::STRUCT(i INT, j INT, k INT, zeta DOUBLE)] AS picks UNION ALL
        SELECT turn + 1, list_append(picks, (SELECT struct_pack(i := z.i, j := z.j, k := z.k, zeta := z.zeta) FROM zz z WHERE z.zeta >= {ZETA_LEAST} AND NOT list_bool_or(list_transform(picks, lambda p: coalesce(abs(p.i - z.i) <= 2 AND abs(p.j - z.j) <= 2, false))) ORDER BY z.zeta DESC, z.i, z.j, z.k LIMIT 1)) FROM r WHERE turn < 5),
      p AS (SELECT unnest(picks) AS p, generate_subscripts(picks, 1) AS o FROM r WHERE turn = 5), g AS (SELECT p.i AS i, p.j AS j, p.k AS k, p.zeta AS zeta, o FROM p WHERE p IS NOT NULL)
      SELECT 0 AS case, row_number() OVER (ORDER BY o)::INT AS rank, g.i, g.j, g.k, zeta, levels::INT AS levels FROM g JOIN dp ON dp.i = g.i AND dp.j = g.j WHERE levels >= 3""", recursive=True),
    "vertical_continuity": oracle("wind", f"+{_ZETA}, lv AS (SELECT DISTINCT k, j + a AS j, i + b AS i FROM zz, range(-1, 2) x(a), range(-1, 2) y(b) WHERE zeta >= {0.5 * ZETA_LEAST}) SELECT j::INT AS j, i::INT AS i, count(*) AS levels FROM lv WHERE i BETWEEN 0 AND 20 AND j BETWEEN 0 AND 20 GROUP BY ALL"),
    "m_product_match": oracle("wind features", f"+{_ZETA}, p AS (SELECT k, j, i, z, id, fz, sqrt((x - fx) ** 2 + (y - fy) ** 2) AS d, row_number() OVER (PARTITION BY k, j, i ORDER BY (x - fx) ** 2 + (y - fy) ** 2, id) AS r FROM zz, features WHERE zeta >= 2.5::DOUBLE) SELECT k, j, i, id, round(d, 4) + 0e0 AS distance, d <= 15000 AND abs(z - fz) <= 3000 AS matched FROM p WHERE r = 1"),
    "feature_nearest_cell": oracle("features", f"SELECT id, {_CELL.format('(fx + 5e4) / 5e3', 20)} AS i, {_CELL.format('(fy + 5e4) / 5e3', 20)} AS j, {_CELL.format('(fz - 5e2) / 5e2', 4)} AS k FROM features"),
    "feature_neighbourhood": oracle("cells features", f"+f AS (SELECT *, {_CELL.format('(fz - 5e2) / 5e2', 4)} AS fk FROM features) SELECT id, count(*) AS cells, count(vr1) AS seen1, count(vr2) AS seen2, max(dbz1) AS dbz FROM f JOIN cells ON (x - fx) ** 2 + (y - fy) ** 2 <= 25e6 AND abs(k - fk) <= 1 GROUP BY id"),
    "feature_polar_support": oracle("features gates", "+f AS (SELECT id, id * 7 % 360 AS az, id * 3 % 100 AS g, id % 6 AS sw FROM features) SELECT id, count(*) AS gates, count(*) FILTER (WHERE abs(vr) <= 20) AS passed FROM f JOIN gates ON radar = 1 AND sweep = sw AND least(abs(ray - az), 360 - abs(ray - az)) <= 1 AND abs(gate - g) <= 2 GROUP BY id"),
    "polar_reasons": oracle("features gates cells", f"+{_BEAMS}" + f""", rad(radar, rx, ry) AS (VALUES (1, -5e4, 0e0), (2, 5e4, -3e4)), rel AS (SELECT id, radar, fx - rx AS e, fy - ry AS n, fz AS u FROM features, rad),
      pol AS (SELECT id, radar, round(CASE WHEN atan2(e, n) < 0 THEN degrees(atan2(e, n)) + 360 ELSE degrees(atan2(e, n)) END, 6) AS az, round(degrees(atan2(u, sqrt(e * e + n * n))), 6) AS el, round(sqrt(e * e + n * n + u * u), 6) AS rg FROM rel),
      tilt AS (SELECT radar, sweep, sweep * 1.5::DOUBLE + 0.5::DOUBLE AS elevation, max(gate) * 1e3 + 500 AS far FROM gates GROUP BY radar, sweep), rim AS (SELECT radar, max(far) AS far FROM tilt GROUP BY radar),
      pick AS (SELECT *, row_number() OVER (PARTITION BY id, radar ORDER BY round(abs(elevation - el), 6), sweep) AS pos FROM pol JOIN tilt USING (radar)),
      met AS (SELECT id, pick.radar, pick.sweep, elevation, round(abs(elevation - el), 6) AS off, rg <= rim.far + 2000 AS near, count(gate) AS samples, count(vr) FILTER (WHERE abs(vr) <= 20) AS valid FROM pick JOIN rim USING (radar) LEFT JOIN gates x
        ON x.radar = pick.radar AND x.sweep = pick.sweep AND round(least(abs(ray - az), 360 - abs(ray - az)), 6) <= 1.5 AND round(abs(gate * 1e3 + 500 - rg), 6) <= 2000 WHERE pos = 1 GROUP BY ALL),
      wide AS (SELECT id, {", ".join(f"max({c}) FILTER (WHERE radar = {n}) AS {m}{n}" for n in (1, 2) for c, m in (("sweep", "sweep"), ("elevation", "elevation"), ("off", "offset"), ("samples", "samples"), ("valid", "valid"), ("near", "in_range")))} FROM met GROUP BY id),
      cel AS (SELECT id, vr1 IS NOT NULL AS v1, vr2 IS NOT NULL AS v2, coalesce(angle >= 20, false) AS ao, coalesce(dbz1 > 10, false) AS dn FROM features LEFT JOIN b ON k = floor((fz - 500) / 500 + 0.5) AND j = floor(fy / 5e3 + 0.5) + 10 AND i = floor(fx / 5e3 + 0.5) + 10)
      SELECT wide.*, CASE WHEN NOT v1 AND NOT v2 THEN CASE WHEN NOT in_range1 AND NOT in_range2 THEN 'out of both ranges' WHEN NOT in_range1 THEN 'out of range of radar 1' WHEN NOT in_range2 THEN 'out of range of radar 2' WHEN valid1 = 0 AND valid2 = 0 THEN 'no valid gate nearby' ELSE 'gates nearby but no value' END
        WHEN NOT v2 THEN CASE WHEN NOT in_range2 THEN 'radar 2 out of range' WHEN valid2 = 0 THEN 'radar 2 has no valid gate nearby' ELSE 'radar 2 has gates nearby but no value' END WHEN NOT v1 THEN CASE WHEN NOT in_range1 THEN 'radar 1 out of range' WHEN valid1 = 0 THEN 'radar 1 has no valid gate nearby' ELSE 'radar 1 has gates nearby but no value' END WHEN NOT ao THEN 'angle' WHEN NOT dn THEN 'downstream' ELSE 'accepted' END AS reason FROM wide JOIN cel USING (id)"""),
    "mask_bounding_box": oracle("wind", "SELECT " + ", ".join(f"min({c}) AS {c}_low, max({c}) AS {c}_high" for c in "kji") + " FROM wind WHERE valid AND dbz > 55"),
    "best_plot_level": oracle("wind", f"+{_ZETA} SELECT k, max(abs(zeta)) AS peak FROM zz WHERE k < 3 GROUP BY k ORDER BY peak DESC, k LIMIT 1"),
    "polyline_clip": oracle("features", "+p AS (SELECT id % 7 AS line, id AS seq, abs(fx) <= 35e3 AND abs(fy) <= 3e4 AS ok FROM features), g AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY line ORDER BY seq) AS run FROM p) SELECT line, min(seq) AS first, max(seq) AS last, count(*) AS points FROM g WHERE ok GROUP BY line, run HAVING count(*) >= 2"),
    "streamline_trim": oracle("features", "+p AS (SELECT id % 3 AS line, id AS seq, fx ** 2 + fy ** 2 <= 225e6 AS near FROM features), e AS (SELECT line, min(seq) FILTER (WHERE near) AS a, max(seq) FILTER (WHERE near) AS b FROM p GROUP BY line) SELECT line, count(*) AS points, min(seq) AS first, max(seq) AS last FROM p JOIN e USING (line) WHERE seq BETWEEN a AND b GROUP BY line"),
    "components_label": oracle("cells", """+c AS (SELECT (k * 441 + j * 21 + i)::BIGINT AS id, k, j, i FROM cells WHERE dbz1 >= 54), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.k - b.k) + abs(a.j - b.j) + abs(a.i - b.i) = 1),
      r AS (SELECT id, id AS seen FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT component, count(*) AS cells FROM (SELECT id, min(seen) AS component FROM r GROUP BY id) GROUP BY component HAVING count(*) >= 3""", recursive=True),
    "mode_gram": oracle("tensor", "SELECT a.col AS p, b.col AS q, round(sum(a.value * b.value), 5) + 0e0 AS g FROM tensor a JOIN tensor b ON a.row = b.row GROUP BY ALL"),
    "mode_product": oracle("tensor", "SELECT row, o::INT AS out, round(sum(value * ((col * 7 + o * 3) % 11 - 5)), 5) + 0e0 AS value FROM tensor, range(4) m(o) GROUP BY ALL"),
    "relative_error": oracle("tensor", "+m AS (SELECT label, col, avg(value) AS mean FROM tensor GROUP BY ALL) SELECT col, round(sqrt(sum((value - mean) ** 2)) / sqrt(sum(value ** 2)), 5) + 0e0 AS error FROM tensor JOIN m USING (label, col) GROUP BY col"),
    "rank_rules": oracle("features", """+s AS (SELECT id, id % 40 + 2 AS nx, id % 30 + 3 AS ny, id % 12 + 1 AS nz, id % 4 + 2 AS nt FROM features), u(rule, a, b, t) AS (VALUES ('aggressive_temporal', 125, 250, 1), ('compact_temporal', 250, 500, 2), ('moderate_temporal', 500, 750, 3), ('compact_rt_full', 250, 500, 99), ('moderate_rt_full', 500, 750, 99)),
      r AS (SELECT id, rule, nx, ny, nz, nt, least(nx, greatest(2, (nx * a + 999) // 1000)) AS rx, least(ny, greatest(2, (ny * a + 999) // 1000)) AS ry, least(nz, greatest(CASE WHEN nz = 1 THEN 1 ELSE 2 END, (nz * b + 999) // 1000)) AS rz, least(nt, t) AS rt FROM s, u)
      SELECT id, rule, rx, ry, rz, rt, (rx * ry * rz * rt * 3 + nx * rx + ny * ry + nz * rz + nt * rt + 9)::BIGINT AS parameters FROM r"""),
}
