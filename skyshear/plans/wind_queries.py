"""Queries on geometry, synthesis, stencils and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.model import DX, DY, DZ, RADARS
from skyshear.operators import scan, stencil, wind
from skyshear.plans.views import oracle, view
from skyshear.sources.store import stored

KEY = ["k", "j", "i"]
R = geo.rounded


def _out(df, *columns, **computed):  # noqa: ANN001, ANN003, ANN202
    return df.select(*columns, *[c.alias(n) for n, c in computed.items()])


def _cells(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "cells")


def _wind(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "wind")


# --- SQL that restates the geometry, for comparison ---------------------------------------------
def _beam_sql(n: int) -> str:
    x, y, z = RADARS[n - 1]
    return f"sqrt((x - ({x}::DOUBLE)) ** 2 + (y - ({y}::DOUBLE)) ** 2 + (z - ({z}::DOUBLE)) ** 2)"


_B = f"""+g AS (SELECT *, {_beam_sql(1)} AS r1, {_beam_sql(2)} AS r2 FROM cells),
 b0 AS (SELECT *, (x + 5e4) / nullif(r1, 0) AS bx1, y / nullif(r1, 0) AS by1, z / nullif(r1, 0) AS bz1, (x - 5e4) / nullif(r2, 0) AS bx2, (y + 3e4) / nullif(r2, 0) AS by2, z / nullif(r2, 0) AS bz2 FROM g),
 b AS (SELECT *, round(degrees(acos(least(1e0, abs((bx1 * bx2 + by1 * by2) / nullif(sqrt((bx1 * bx1 + by1 * by1) * (bx2 * bx2 + by2 * by2)), 0))))), 6) + 0e0 AS angle FROM b0),
 s AS (SELECT *, coalesce(vr1 IS NOT NULL AND vr2 IS NOT NULL AND angle >= 20 AND r1 > 0 AND r2 > 0, false) AS ok, nullif(bx1 * by2 - bx2 * by1, 0) AS det FROM b)"""
_BEAMS = _B.removeprefix("+").split(",\n s AS")[0]


def _vortex_cells(s, d):  # noqa: ANN001, ANN202
    """Solid rotation on a 17 x 17 x 5 grid, seen by both radars, with their beams; no table is read."""
    n = s.range(17 * 17 * 5).select((F.col("id") % 17).cast("int").alias("i"), (F.floor(F.col("id") / 17) % 17).cast("int").alias("j"), F.floor(F.col("id") / 289).cast("int").alias("k"))
    cells = n.select(*KEY, ((F.col("i") - 8) * 5000.0).alias("x"), ((F.col("j") - 8) * 5000.0).alias("y"), (500.0 + 500.0 * F.col("k")).alias("z"))
    true_u, true_v = 8.0 - 2e-4 * F.col("y"), 3.0 + 2e-4 * F.col("x")
    # written once, so what stands on the beams doesn't repeat their formulas
    return stored(wind.beams(cells).withColumns({f"vr{n}": F.col(f"bx{n}") * true_u + F.col(f"by{n}") * true_v for n in (1, 2)}), "vortex")


def _vortex(s, d):  # noqa: ANN001, ANN202
    out = wind.solved(_vortex_cells(s, d)).filter("valid")
    return _out(out, *KEY, u=R(F.col("u"), 4), v=R(F.col("v"), 4), angle=F.col("angle"), close=(F.abs(F.col("u") - (8.0 - 2e-4 * F.col("y"))) < 1e-4) & (F.abs(F.col("v") - (3.0 + 2e-4 * F.col("x"))) < 1e-4))


def _integral(s, d):  # noqa: ANN001, ANN202
    c = _wind(s, d).withColumn("div", F.when(F.col("valid"), R(F.col("u") * 1e-4))).withColumn("is_top", F.col("k") == 4)
    return _out(stencil.downward_integral(c, DZ, F.lit(0.5)), *KEY, w=R(F.col("w")))


def _physics(s, d):  # noqa: ANN001, ANN202
    done = stencil.stencil_complete(_wind(s, d), F.col("valid"), {"i": 21, "j": 21, "k": 5})
    return _out(done, *KEY, complete=F.col("complete"))


def _d_rho(s, d):  # noqa: ANN001, ANN202
    return _out(stencil.mass_divergence(_wind(s, d)), *KEY, d_rho=R(F.col("d_rho") * 1e3))


def _d_rho_adjoint(s, d):  # noqa: ANN001, ANN202
    """The transpose of d/dx + d/dy on the full grid, applied to u with missing cells as zero."""
    full = _full(s, _wind(s, d)).select(*KEY, F.coalesce("u", F.lit(0.0)).alias("value"))
    gx = stencil.scatter_transpose(full, "i", DX, 21).withColumnRenamed("value", "gx")
    gy = stencil.scatter_transpose(full, "j", DY, 21).withColumnRenamed("value", "gy")
    return _out(gx.join(gy, KEY), *KEY, au=R(F.col("gx") * 1e4), av=R(F.col("gy") * 1e4))


def _full(s, cells):  # noqa: ANN001, ANN202
    n = s.range(21 * 21 * 5).select(F.floor(F.col("id") / 441).cast("int").alias("k"), (F.floor(F.col("id") / 21) % 21).cast("int").alias("j"), (F.col("id") % 21).cast("int").alias("i"))
    return F.broadcast(n).join(cells.hint("shuffle_hash"), KEY, "left")


def _legacy(s, d):  # noqa: ANN001, ANN202
    full = _full(s, _wind(s, d))
    g = lambda c, a, h, n: stencil.gradient(F.col(c), a, h, n)
    out = full.withColumns({"ux": g("u", "i", DX, 21), "vy": g("v", "j", DY, 21), "vx": g("v", "i", DX, 21), "uy": g("u", "j", DY, 21), "wz": g("w", "k", DZ, 5)})
    return _out(out, *KEY, divergence=R((F.col("ux") + F.col("vy")) * 1e4), vorticity=R((F.col("vx") - F.col("uy")) * 1e4), continuity=R((F.col("ux") + F.col("vy") + F.col("wz") - F.coalesce("w", F.lit(0.0)) / 1e4) * 1e4))


def _helicity(s, d):  # noqa: ANN001, ANN202
    ok = _wind(s, d).withColumns({c: F.when(F.col("valid"), F.col(c)) for c in "uvw"})
    names = {f"{c}{a}": stencil.central(F.col(c), b, h) for c, a, b, h in (("w", "y", "j", DY), ("v", "z", "k", DZ), ("u", "z", "k", DZ), ("w", "x", "i", DX), ("v", "x", "i", DX), ("u", "y", "j", DY))}
    out = ok.withColumns(names)
    h = F.col("u") * (F.col("wy") - F.col("vz")) + F.col("v") * (F.col("uz") - F.col("wx")) + F.col("w") * (F.col("vx") - F.col("uy"))
    return _out(out, *KEY, helicity=R(F.coalesce(h, F.lit(0.0)) * 1e2))


def _vorticity(s, d):  # noqa: ANN001, ANN202
    out = stencil.divergence_vorticity(_wind(s, d), DX, DY)
    return _out(out, *KEY, divergence=R(F.col("divergence") * 1e4), vorticity=R(F.col("vorticity") * 1e4))


def _maxima(s, d):  # noqa: ANN001, ANN202
    return stencil.local_maxima(_full(s, _cells(s, d)).select(*KEY, "dbz1"), "dbz1", {"k": 1, "j": 3, "i": 3})


def _runs(s, d):  # noqa: ANN001, ANN202
    return stencil.longest_run(_wind(s, d), F.col("valid"), ["j", "i"], "k")


def _depth(s, d):  # noqa: ANN001, ANN202
    """Deepest run of levels whose peak is a quarter of the field's or more, by row of cells."""
    levels = _cells(s, d).groupBy("j", "k").agg(F.max("dbz1").alias("peak"))
    ref = levels.groupBy("j").agg(F.max("peak").alias("ref"))
    runs = stencil.longest_run(levels.join(ref, "j"), F.col("peak") >= 0.25 * F.col("ref"), ["j"], "k")
    return runs.select("j", (F.col("longest") * DZ).alias("depth_m"))


def _forward(s, d):  # noqa: ANN001, ANN202
    out = wind.forward(wind.beams(_cells(s, d)).withColumns({"u": F.col("vr1"), "v": F.col("vr2"), "w": F.lit(1.5)}))
    return _out(out, *KEY, h1=R(F.col("h1")), h2=R(F.col("h2")))


def _adjoint(s, d):  # noqa: ANN001, ANN202
    return _out(wind.adjoint(wind.beams(_cells(s, d))), *KEY, au=R(F.col("au")), av=R(F.col("av")), aw=R(F.col("aw")))


def _weighted(s, d):  # noqa: ANN001, ANN202
    w = (F.coalesce(F.abs("dbz1"), F.lit(0.0)), F.coalesce(F.abs("dbz2"), F.lit(0.0)))
    return _out(wind.adjoint(wind.beams(_cells(s, d)), w), *KEY, au=R(F.col("au")), av=R(F.col("av")), aw=R(F.col("aw")))


def _rmse(s, d):  # noqa: ANN001, ANN202
    c = wind.beams(_cells(s, d)).filter("vr1 IS NOT NULL AND vr2 IS NOT NULL")
    u, v, w, fall = F.lit(3.0), F.lit(-2.0), F.lit(0.5), F.lit(-1.2)
    e = {n: F.col(f"vr{n}") - wind.radial(u, v, w, n, fall) for n in (1, 2)}
    return c.agg(F.count("*").alias("n"), *[R(F.sqrt(F.avg(e[n] * e[n]))).alias(f"rmse{n}") for n in (1, 2)])


def _geometry(s, d):  # noqa: ANN001, ANN202
    b = wind.beams(_cells(s, d))
    low, high = geo.horizontal_sigmas(*[F.col(f"{c}{n}") for n in (1, 2) for c in ("bx", "by")])
    dot = F.abs(F.col("bx1") * F.col("bx2") + F.col("by1") * F.col("by2") + F.col("bz1") * F.col("bz2"))
    b = b.withColumns({"lo": low, "hi": high, "dot": F.least(dot, F.lit(1.0))})
    return _out(b, *KEY, sigma_min=R(F.col("lo")), sigma_max=R(F.col("hi")), inverse_condition=R(F.col("lo") / geo.nonzero(F.col("hi"))), sigma3_low=R(F.sqrt(1 - F.col("dot")), 5), sigma3_high=R(F.sqrt(1 + F.col("dot"))))


def _null_direction(s, d):  # noqa: ANN001, ANN202
    b = wind.beams(_cells(s, d))
    c = geo.cross(*[tuple(F.col(f"b{a}{n}") for a in "xyz") for n in (1, 2)])
    norm = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
    b = b.withColumns({"cx": c[0], "cy": c[1], "cz": c[2], "norm": norm})
    one = lambda c: R(F.when(F.col("norm") > 1e-12, F.col(c) / F.col("norm")), 5)
    return _out(b, *KEY, nx=one("cx"), ny=one("cy"), nz=one("cz"), unique=F.col("norm") > 1e-12)


def _enu(s, d):  # noqa: ANN001, ANN202
    f = view(s, d, "features")
    e, n, u = geo.wgs84_to_enu(35.0 + F.col("fy") / 1e5, 118.0 + F.col("fx") / 1e5, F.col("fz"), 35.25, 118.421, 224.0)
    lon, lat = geo.enu_to_lonlat(F.col("fx") / 1e3, F.col("fy") / 1e3, 35.25, 118.421)
    x, y = geo.feature_to_xy(35.0 + F.col("fy") / 1e5, 118.0 + F.col("fx") / 1e5, 35.25, 118.421)
    return _out(f, "id", east=R(e), north=R(n), up=R(u), lon=R(lon), lat=R(lat), x_km=R(x), y_km=R(y))


_ENU_SQL = """+p AS (SELECT id, fx, fy, radians(35e0 + fy / 1e5) AS la, radians(118e0 + fx / 1e5) AS lo, fz / 1e3 AS h, radians(35.25::DOUBLE) AS la0, radians(118.421::DOUBLE) AS lo0, 0.224::DOUBLE AS h0, (2 - 1e0 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS e2 FROM features),
 n AS (SELECT *, 6378.137::DOUBLE / sqrt(1 - e2 * sin(la) * sin(la)) AS n, 6378.137::DOUBLE / sqrt(1 - e2 * sin(la0) * sin(la0)) AS n0 FROM p),
 d AS (SELECT *, (n + h) * cos(la) * cos(lo) - (n0 + h0) * cos(la0) * cos(lo0) AS dx, (n + h) * cos(la) * sin(lo) - (n0 + h0) * cos(la0) * sin(lo0) AS dy, (n * (1 - e2) + h) * sin(la) - (n0 * (1 - e2) + h0) * sin(la0) AS dz FROM n)
 SELECT id, round(dy * cos(lo0) - dx * sin(lo0), 6) + 0e0 AS east, round(dz * cos(la0) - dx * sin(la0) * cos(lo0) - dy * sin(la0) * sin(lo0), 6) + 0e0 AS north, round(dx * cos(la0) * cos(lo0) + dy * cos(la0) * sin(lo0) + dz * sin(la0), 6) + 0e0 AS up,
  round(118.421::DOUBLE + fx / 1e3 / (111.32::DOUBLE * cos(la0)), 6) + 0e0 AS lon, round(35.25::DOUBLE + fy / 1e3 / 111.32::DOUBLE, 6) + 0e0 AS lat,
  round((118e0 + fx / 1e5 - 118.421::DOUBLE) * 111 * cos(la), 6) + 0e0 AS x_km, round((35e0 + fy / 1e5 - 35.25::DOUBLE) * 111, 6) + 0e0 AS y_km FROM d"""


def _azimuth(s, d):  # noqa: ANN001, ANN202
    c = _cells(s, d).withColumns({"e": F.col("x") + 50_000.0, "n": F.col("y"), "h": F.sqrt((F.col("x") + 50_000.0) ** 2 + F.col("y") ** 2)})
    return _out(c, *KEY, azimuth=R(geo.azimuth(F.col("e"), F.col("n"))), elevation=R(F.degrees(F.atan2("z", "h"))), range_m=R(F.sqrt(F.col("h") * F.col("h") + F.col("z") * F.col("z"))))


def _cosines(s, d):  # noqa: ANN001, ANN202
    g = view(s, d, "gates").select("radar", "sweep", "ray").distinct()
    e, n, u = geo.cosines(F.col("ray").cast("double"), F.col("sweep") * 1.5 + 0.5)
    return _out(g, "radar", "sweep", "ray", east=R(e), north=R(n), up=R(u), off=R(geo.wrapped(F.col("ray").cast("double"), F.col("sweep") * 61.0)))


# --- quality control -----------------------------------------------------------------------------
def _extremes(s, d, *limits):  # noqa: ANN001, ANN002, ANN202
    return scan.without_extremes(view(s, d, "gates"), *limits).select("radar", "sweep", "ray", "gate", "vr", "dbz")


def _median(s, d):  # noqa: ANN001, ANN202
    """All rays and gates of all sweeps; some gates have no value."""
    g = view(s, d, "gates")
    return stencil.median3(g.withColumn("vr", F.when((F.col("ray") * 7 + F.col("gate")) % 23 != 5, F.col("vr"))))


def provenance(cells):  # noqa: ANN001, ANN201
    """What each cell's observations are good for: eight flags that needn't exclude each other."""
    v1, v2 = F.col("vr1").isNotNull(), F.col("vr2").isNotNull()
    angle_ok = F.col("angle") >= 20.0
    downstream = F.coalesce(F.col("dbz1"), F.lit(0.0)) > 10.0
    both = v1 & v2
    return cells.withColumns({"no_radar": ~v1 & ~v2, "radar1_only": v1 & ~v2, "radar2_only": ~v1 & v2, "dual_coverage": both, "rejected_by_angle": both & ~angle_ok, "accepted_by_angle": both & angle_ok, "rejected_downstream": both & angle_ok & ~downstream, "accepted": both & angle_ok & downstream})


FLAGS = ("no_radar", "radar1_only", "radar2_only", "dual_coverage", "rejected_by_angle", "accepted_by_angle", "rejected_downstream", "accepted")


def _provenance(s, d):  # noqa: ANN001, ANN202
    return provenance(wind.beams(_cells(s, d))).groupBy("k").agg(*[F.count_if(f).alias(f) for f in FLAGS])


def _reason(s, d):  # noqa: ANN001, ANN202
    """Why a feature's cell has no wind: the first rule that applies."""
    c = provenance(wind.beams(_cells(s, d))).withColumns({"near1": F.col("r1") <= 60_000, "near2": F.col("r2") <= 60_000})
    reason = (
        F.when(F.col("no_radar") & ~F.col("near1") & ~F.col("near2"), "out of both ranges")
        .when(F.col("no_radar") & ~F.col("near1"), "out of range of radar 1")
        .when(F.col("no_radar") & ~F.col("near2"), "out of range of radar 2")
        .when(F.col("no_radar"), "no observation")
        .when(F.col("radar1_only"), F.when(~F.col("near2"), "radar 2 out of range").otherwise("radar 2 has no value"))
        .when(F.col("radar2_only"), F.when(~F.col("near1"), "radar 1 out of range").otherwise("radar 1 has no value"))
        .when(F.col("rejected_by_angle"), "angle")
        .when(F.col("rejected_downstream"), "downstream")
        .otherwise("accepted")
    )
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def _count(s, d):  # noqa: ANN001, ANN202
    return _cells(s, d).select(*KEY, (F.col("vr1").isNotNull().cast("int") + F.col("vr2").isNotNull().cast("int")).alias("radar_count"), F.greatest("dbz1", "dbz2").alias("dbz"))


def _masks(s, d):  # noqa: ANN001, ANN202
    """Wind is masked where no radar sees, diagnostics where the dual mask is off (without an angle it falls back on the count)."""
    b = wind.beams(_cells(s, d)).withColumn("radar_count", F.col("vr1").isNotNull().cast("int") + F.col("vr2").isNotNull().cast("int"))
    c = b.withColumn("dual", F.coalesce((F.col("radar_count") == 2) & (F.col("angle") >= 20), F.col("radar_count") == 2))
    return c.select(*KEY, (F.col("radar_count") == 0).alias("wind_masked"), (~F.col("dual")).alias("diagnostics_masked"))


def _holdout(s, d):  # noqa: ANN001, ANN202
    return view(s, d, "field").groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.pmod(F.col("i") + 2 * F.col("j") + 5 * F.col("t"), F.lit(10)) == 0).alias("held"))


def _dealias(s, d):  # noqa: ANN001, ANN202
    from skyshear.operators.kernels import dealias

    return dealias(view(s, d, "gates"), nyquist=12.0)


#: A sweep of 18 rays and 12 gates whose velocity is known: its SQL, for either engine; rays 3 to 5 have no gates near the radar.
_KNOWN = "9e0 * sin(radians(ray * 20e0)) + gate - 6e0 + 5e-1 * sweep"
_COMPACT = "SELECT DISTINCT radar, sweep, ray % 18 AS ray, gate % 12 AS gate FROM gates"


def _dealias_regions(s, d):  # noqa: ANN001, ANN202
    """A known velocity on the gates that are there, folded into 8 m/s and unfolded by regions."""
    from skyshear.operators.unfold import by_regions

    known = s.sql(f"SELECT *, {_KNOWN} AS v FROM ({_COMPACT.replace('gates', '{gates}')})", gates=view(s, d, "gates"))
    hidden = F.col("ray").between(3, 5) & (F.col("gate") < 7)
    folded = F.col("v") - 16.0 * F.floor((F.col("v") + 8.0) / 16.0)
    g = known.select("radar", "sweep", "ray", "gate", F.when(~hidden, folded).alias("vr"))
    return by_regions(g, 8.0, skip=2).select("radar", "sweep", "ray", "gate", R(F.col("unfolded"), 5).alias("unfolded"))


QUERIES = {
    "dealias_regions": _dealias_regions,
    "dual_doppler_vortex": _vortex,
    "dual_doppler_cells": lambda s, d: _out(wind.synthesise(_cells(s, d)).filter("valid"), *KEY, u=R(F.col("u"), 4), v=R(F.col("v"), 4), angle=F.col("angle")),
    "crossing_angle": lambda s, d: _out(wind.beams(_cells(s, d)), *KEY, angle=F.col("angle")),
    "beam_vectors": lambda s, d: _out(wind.beams(_cells(s, d)), *KEY, **{f"b{a}{n}": R(F.col(f"b{a}{n}")) for n in (1, 2) for a in "xyz"}),
    "beam_cosines": _cosines,
    "az_el_range": _azimuth,
    "horizontal_sigma": _geometry,
    "null_direction": _null_direction,
    "wgs84_enu": _enu,
    "forward_h": _forward,
    "adjoint_h": _adjoint,
    "weighted_h": _weighted,
    "radial_residual_rmse": _rmse,
    "continuity_integral": _integral,
    "dual_doppler_feedback": lambda s, d: _out(wind.retrieve(_cells(s, d), DZ, 3), *KEY, u=R(F.col("u"), 3), v=R(F.col("v"), 3), w=R(F.col("w"), 3)),
    "divergence_vorticity": _vorticity,
    "d_rho": _d_rho,
    "d_rho_adjoint": _d_rho_adjoint,
    "physics_mask": _physics,
    "legacy_continuity": _legacy,
    "helicity": _helicity,
    "local_maxima_3x7x7": _maxima,
    "longest_run": _runs,
    "column_depth": _depth,
    "filter_extremes": lambda s, d: _extremes(s, d, 20.0, (-5.0, 50.0)),
    "filter_extremes_default": _extremes,
    "despeckle_median3": _median,
    "mask_provenance": _provenance,
    "failure_reason": _reason,
    "radar_count": _count,
    "output_masks": _masks,
    "holdout_lattice": _holdout,
    "dealias": _dealias,
}
_rnd = lambda e, n, p=6: f"round({e}, {p}) + 0e0 AS {n}"


def _near(table: str, columns: str, axes: str = "ij k", steps: tuple[int, ...] = (-1, 1)) -> tuple[str, str]:
    """Columns of neighbours as ``<column>_<axis>m`` and ``..p``, and the joins that fetch them."""
    cols, joins = [], []
    for a in axes.replace(" ", ""):
        for st in steps:
            n = f"n_{a}{'m' if st < 0 else 'p'}"
            on = " AND ".join(f"{n}.{x} = c.{x}{f' + ({st})' if x == a else ''}" for x in KEY)
            joins.append(f"LEFT JOIN {table} {n} ON {on}")
            cols += [f"{n}.{c} AS {c}_{n[2:]}" for c in columns.split()]
    return ", ".join(cols), " ".join(joins)


_C1, _J1 = _near("vw", "u v w", "ijk")
_VW = f"vw AS (SELECT k, j, i, x, y, z, exp(-z / 1e4) AS rho, valid, CASE WHEN valid THEN u END AS u, CASE WHEN valid THEN v END AS v, CASE WHEN valid THEN w END AS w FROM wind), n AS (SELECT c.*, {_C1} FROM vw c {_J1})"
_FULL = "f AS (SELECT c.k, c.j, c.i, coalesce(u, 0) AS u, coalesce(v, 0) AS v, coalesce(w, 0) AS w FROM (SELECT k::INT AS k, j::INT AS j, i::INT AS i FROM range(5) a(k), range(21) b(j), range(21) c(i)) c LEFT JOIN wind USING (k, j, i))"
_CF, _JF = _near("f", "u v w", "ijk")


def _grad(c: str, a: str, h: float, n: int) -> str:
    return f"CASE WHEN {a} = 0 THEN ({c}_{a}p - {c}) / {h} WHEN {a} = {n - 1} THEN ({c} - {c}_{a}m) / {h} ELSE ({c}_{a}p - {c}_{a}m) / {2 * h} END"


def _sec(c: str, a: str, x: str, h: float) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (coalesce({c}_{a}p, {c}) - coalesce({c}_{a}m, {c})) / nullif(({h}::DOUBLE) * (({c}_{a}p IS NOT NULL)::INT + ({c}_{a}m IS NOT NULL)::INT), 0) END"


_SYN = _B + " "
_MEDIAN_JOIN = " ".join(
    f"LEFT JOIN g m{a}{b} ON m{a}{b}.radar = c.radar AND m{a}{b}.sweep = c.sweep AND m{a}{b}.ray = greatest(c.rl, least(c.rh, c.ray + ({x}))) AND m{a}{b}.gate = greatest(c.gl, least(c.gh, c.gate + ({y})))"
    for a, x in enumerate((-1, 0, 1))
    for b, y in enumerate((-1, 0, 1))
)
_FLAG_SQL = """p AS (SELECT *, vr1 IS NOT NULL AS v1, vr2 IS NOT NULL AS v2, angle >= 20 AS ao, coalesce(dbz1, 0) > 10 AS dn FROM b)"""
_ADJ = lambda w: f"SELECT k, j, i, {', '.join(_rnd(f'b{a}1 * coalesce(vr1, 0) * {w[0]} + b{a}2 * coalesce(vr2, 0) * {w[1]}', f'a{c}') for a, c in zip('xyz', 'uvw', strict=True))} FROM b"
ORACLES = {
    "dealias_regions": oracle("gates", f"+c AS ({_COMPACT}) SELECT radar, sweep, ray, gate, CASE WHEN NOT (ray BETWEEN 3 AND 5 AND gate < 7) THEN round({_KNOWN}, 5) + 0e0 END AS unfolded FROM c"),
    "dual_doppler_vortex": f"""WITH cells AS (SELECT k::INT AS k, j::INT AS j, i::INT AS i, (i - 8) * 5e3 AS x, (j - 8) * 5e3 AS y, 5e2 + 5e2 * k AS z, NULL AS vr1, NULL AS vr2 FROM range(5) a(k), range(17) b(j), range(17) c(i)), {_BEAMS},
      o AS (SELECT *, 8 - 2e-4 * y AS tu, 3 + 2e-4 * x AS tv, bx1 * by2 - bx2 * by1 AS det FROM b), q AS (SELECT *, bx1 * tu + by1 * tv AS a, bx2 * tu + by2 * tv AS e FROM o)
      SELECT k, j, i, round((by2 * a - by1 * e) / nullif(det, 0), 4) + 0e0 AS u, round((bx1 * e - bx2 * a) / nullif(det, 0), 4) + 0e0 AS v, angle, true AS close FROM q WHERE angle >= 20""",
    "dual_doppler_cells": oracle("cells", _SYN + "SELECT k, j, i, round((by2 * vr1 - by1 * vr2) / det, 4) + 0e0 AS u, round((bx1 * vr2 - bx2 * vr1) / det, 4) + 0e0 AS v, angle FROM s WHERE ok"),
    "crossing_angle": oracle("cells", _SYN + "SELECT k, j, i, angle FROM b"),
    "beam_vectors": oracle("cells", _SYN + "SELECT k, j, i, " + ", ".join(_rnd(f"b{a}{n}", f"b{a}{n}") for n in (1, 2) for a in "xyz") + " FROM b"),
    "beam_cosines": oracle("gates", """+g AS (SELECT DISTINCT radar, sweep, ray, radians(ray::DOUBLE) AS az, radians(sweep * 1.5::DOUBLE + 0.5::DOUBLE) AS el FROM gates)
      SELECT radar, sweep, ray, round(cos(el) * sin(az), 6) + 0e0 AS east, round(cos(el) * cos(az), 6) + 0e0 AS north, round(sin(el), 6) + 0e0 AS up, least((ray - sweep * 61 + 720) % 360, 360 - (ray - sweep * 61 + 720) % 360)::DOUBLE AS off FROM g"""),
    "az_el_range": oracle("cells", "SELECT k, j, i, round(CASE WHEN atan2(x + 5e4, y) < 0 THEN degrees(atan2(x + 5e4, y)) + 360 ELSE degrees(atan2(x + 5e4, y)) END, 6) + 0e0 AS azimuth, round(degrees(atan2(z, sqrt((x + 5e4) ** 2 + y ** 2))), 6) + 0e0 AS elevation, round(sqrt((x + 5e4) ** 2 + y ** 2 + z ** 2), 6) + 0e0 AS range_m FROM cells"),
    "horizontal_sigma": oracle("cells", _SYN + """, e AS (SELECT *, bx1 * bx1 + bx2 * bx2 AS a, bx1 * by1 + bx2 * by2 AS o, by1 * by1 + by2 * by2 AS d, least(1e0, abs(bx1 * bx2 + by1 * by2 + bz1 * bz2)) AS dot FROM b),
      q AS (SELECT *, sqrt(greatest(0e0, (a + d - sqrt((a - d) ** 2 + 4 * o * o)) / 2)) AS lo, sqrt(greatest(0e0, (a + d + sqrt((a - d) ** 2 + 4 * o * o)) / 2)) AS hi FROM e)
      SELECT k, j, i, round(lo, 6) + 0e0 AS sigma_min, round(hi, 6) + 0e0 AS sigma_max, round(lo / nullif(hi, 0), 6) + 0e0 AS inverse_condition, round(sqrt(1 - dot), 5) + 0e0 AS sigma3_low, round(sqrt(1 + dot), 6) + 0e0 AS sigma3_high FROM q"""),
    "null_direction": oracle("cells", _SYN + """, c AS (SELECT k, j, i, by1 * bz2 - bz1 * by2 AS cx, bz1 * bx2 - bx1 * bz2 AS cy, bx1 * by2 - by1 * bx2 AS cz FROM b), m AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS m FROM c)
      SELECT k, j, i, round(cx / CASE WHEN m > 1e-12 THEN m END, 5) + 0e0 AS nx, round(cy / CASE WHEN m > 1e-12 THEN m END, 5) + 0e0 AS ny, round(cz / CASE WHEN m > 1e-12 THEN m END, 5) + 0e0 AS nz, m > 1e-12 AS unique FROM m"""),
    "wgs84_enu": oracle("features", _ENU_SQL),
    "forward_h": oracle("cells", _SYN + "SELECT k, j, i, " + ", ".join(_rnd(f"CASE WHEN vr{n} IS NULL THEN 0 ELSE bx{n} * coalesce(vr1, 0) + by{n} * coalesce(vr2, 0) + bz{n} * 1.5::DOUBLE END", f"h{n}") for n in (1, 2)) + " FROM b"),
    "adjoint_h": oracle("cells", _SYN + _ADJ(("1", "1"))),
    "weighted_h": oracle("cells", _SYN + _ADJ(("sqrt(coalesce(abs(dbz1), 0))", "sqrt(coalesce(abs(dbz2), 0))"))),
    "radial_residual_rmse": oracle("cells", _SYN + "SELECT count(*) AS n, " + ", ".join(_rnd(f"sqrt(avg((vr{n} - (bx{n} * 3 - by{n} * 2 + bz{n} * (0.5::DOUBLE - 1.2::DOUBLE))) ** 2))", f"rmse{n}") for n in (1, 2)) + " FROM b WHERE vr1 IS NOT NULL AND vr2 IS NOT NULL"),
    "continuity_integral": oracle("wind", """+c AS (SELECT k, j, i, valid, CASE WHEN valid THEN round(u * 1e-4, 6) + 0e0 END AS div FROM wind),
      r AS (SELECT k, j, i, valid, CASE WHEN valid AND k = 4 THEN 0.5::DOUBLE ELSE 0e0 END AS w FROM c WHERE k = 4 OR NOT EXISTS (SELECT 1 FROM c a WHERE a.j = c.j AND a.i = c.i AND a.k = c.k + 1)
        UNION ALL SELECT c.k, c.j, c.i, c.valid, CASE WHEN c.valid AND r.valid THEN r.w + c.div * 500 ELSE 0e0 END FROM r JOIN c ON c.j = r.j AND c.i = r.i AND c.k = r.k - 1)
      SELECT k, j, i, round(w, 6) + 0e0 AS w FROM r""", recursive=True),
    "divergence_vorticity": oracle("wind", f"+{_VW} SELECT k, j, i, round(CASE WHEN valid THEN ((u_ip - u_im) + (v_jp - v_jm)) END, 6) + 0e0 AS divergence, round(CASE WHEN valid THEN ((v_ip - v_im) - (u_jp - u_jm)) END, 6) + 0e0 AS vorticity FROM n"),
    "d_rho": oracle("wind", f"+{_VW}, q AS (SELECT *, rho * w AS rw, exp(-(z + 500) / 1e4) * w_kp AS rw_kp, exp(-(z - 500) / 1e4) * w_km AS rw_km FROM n) SELECT k, j, i, round(({_sec('u', 'i', 'x', DX)} + {_sec('v', 'j', 'y', DY)} + {_sec('rw', 'k', 'z', DZ)} / rho) * 1e3, 6) + 0e0 AS d_rho FROM q"),
    "d_rho_adjoint": oracle("wind", f"+{_FULL}, gx AS (SELECT k, j, t AS i, sum(g) AS g FROM (SELECT k, j, least(i + 1, 20) AS t, u / ((least(i + 1, 20) - greatest(i - 1, 0)) * 5e3) AS g FROM f UNION ALL SELECT k, j, greatest(i - 1, 0), -u / ((least(i + 1, 20) - greatest(i - 1, 0)) * 5e3) FROM f) GROUP BY ALL),"
      " gy AS (SELECT k, t AS j, i, sum(g) AS g FROM (SELECT k, i, least(j + 1, 20) AS t, u / ((least(j + 1, 20) - greatest(j - 1, 0)) * 5e3) AS g FROM f UNION ALL SELECT k, i, greatest(j - 1, 0), -u / ((least(j + 1, 20) - greatest(j - 1, 0)) * 5e3) FROM f) GROUP BY ALL)"
      " SELECT k, j, i, round(gx.g * 1e4, 6) + 0e0 AS au, round(gy.g * 1e4, 6) + 0e0 AS av FROM gx JOIN gy USING (k, j, i)"),
    "physics_mask": oracle("wind", f"+{_VW} SELECT k, j, i, valid AND (u_ip IS NOT NULL OR i = 20) AND (u_im IS NOT NULL OR i = 0) AND (u_jp IS NOT NULL OR j = 20) AND (u_jm IS NOT NULL OR j = 0) AND (u_kp IS NOT NULL OR k = 4) AND (u_km IS NOT NULL OR k = 0) AS complete FROM n"),
    "legacy_continuity": oracle("wind", f"+{_FULL}, c0 AS (SELECT c.*, {_CF} FROM f c {_JF}), c AS (SELECT k, j, i, w, {_grad('u', 'i', DX, 21)} AS ux, {_grad('v', 'j', DY, 21)} AS vy, {_grad('v', 'i', DX, 21)} AS vx, {_grad('u', 'j', DY, 21)} AS uy, {_grad('w', 'k', DZ, 5)} AS wz FROM c0)"
      " SELECT k, j, i, round((ux + vy) * 1e4, 6) + 0e0 AS divergence, round((vx - uy) * 1e4, 6) + 0e0 AS vorticity, round((ux + vy + wz - w / 1e4) * 1e4, 6) + 0e0 AS continuity FROM c"),
    "helicity": oracle("wind", f"+{_VW} SELECT k, j, i, round(coalesce(u * ((w_jp - w_jm) / 1e4 - (v_kp - v_km) / 1e3) + v * ((u_kp - u_km) / 1e3 - (w_ip - w_im) / 1e4) + w * ((v_ip - v_im) / 1e4 - (u_jp - u_jm) / 1e4), 0) * 1e2, 6) + 0e0 AS helicity FROM n"),
    "local_maxima_3x7x7": oracle("cells", "+c AS (SELECT k, j, i, dbz1 FROM cells WHERE dbz1 IS NOT NULL) SELECT k, j, i, dbz1 FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE abs(o.k - c.k) <= 1 AND abs(o.j - c.j) <= 3 AND abs(o.i - c.i) <= 3 AND o.dbz1 > c.dbz1)"),
    "longest_run": oracle("wind", "+r AS (SELECT j, i, k, k - row_number() OVER (PARTITION BY j, i ORDER BY k) AS g FROM wind WHERE valid), n AS (SELECT j, i, g, count(*) AS n FROM r GROUP BY ALL) SELECT j, i, max(n) AS longest FROM n GROUP BY j, i"),
    "column_depth": oracle("cells", "+l AS (SELECT j, k, max(dbz1) AS peak FROM cells GROUP BY ALL), q AS (SELECT j, k FROM l JOIN (SELECT j, max(peak) AS ref FROM l GROUP BY j) USING (j) WHERE peak >= 0.25::DOUBLE * ref), r AS (SELECT j, k - row_number() OVER (PARTITION BY j ORDER BY k) AS g FROM q) SELECT j, max(n) * 500e0 AS depth_m FROM (SELECT j, g, count(*) AS n FROM r GROUP BY ALL) GROUP BY j"),
    "filter_extremes_default": oracle("gates", "SELECT radar, sweep, ray, gate, CASE WHEN abs(vr) <= 100 THEN vr END AS vr, CASE WHEN dbz BETWEEN -20 AND 80 THEN dbz END AS dbz FROM gates"),
    "filter_extremes": oracle("gates", "SELECT radar, sweep, ray, gate, CASE WHEN abs(vr) <= 20 THEN vr END AS vr, CASE WHEN dbz BETWEEN -5 AND 50 THEN dbz END AS dbz FROM gates"),
    "despeckle_median3": oracle("gates", f"""+g AS (SELECT radar, sweep, ray, gate, CASE WHEN (ray * 7 + gate) % 23 <> 5 THEN vr END AS vr FROM gates),
      c AS (SELECT *, min(ray) OVER w AS rl, max(ray) OVER w AS rh, min(gate) OVER w AS gl, max(gate) OVER w AS gh FROM g WINDOW w AS (PARTITION BY radar, sweep)),
      m AS (SELECT c.radar, c.sweep, c.ray, c.gate, [{", ".join(f"m{a}{b}.vr" for a in range(3) for b in range(3))}] AS l FROM c {_MEDIAN_JOIN})
      SELECT radar, sweep, ray, gate, CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) = 9 THEN list_sort(l)[5] END AS median FROM m"""),
    "mask_provenance": oracle("cells", _SYN + f", {_FLAG_SQL} SELECT k, count(*) FILTER (WHERE NOT v1 AND NOT v2) AS no_radar, count(*) FILTER (WHERE v1 AND NOT v2) AS radar1_only, count(*) FILTER (WHERE v2 AND NOT v1) AS radar2_only, count(*) FILTER (WHERE v1 AND v2) AS dual_coverage, count(*) FILTER (WHERE v1 AND v2 AND NOT ao) AS rejected_by_angle, count(*) FILTER (WHERE v1 AND v2 AND ao) AS accepted_by_angle, count(*) FILTER (WHERE v1 AND v2 AND ao AND NOT dn) AS rejected_downstream, count(*) FILTER (WHERE v1 AND v2 AND ao AND dn) AS accepted FROM p GROUP BY k"),
    "failure_reason": oracle("cells", _SYN + f""", {_FLAG_SQL}, q AS (SELECT CASE WHEN NOT v1 AND NOT v2 THEN CASE WHEN r1 > 6e4 AND r2 > 6e4 THEN 'out of both ranges' WHEN r1 > 6e4 THEN 'out of range of radar 1' WHEN r2 > 6e4 THEN 'out of range of radar 2' ELSE 'no observation' END
      WHEN NOT v2 THEN CASE WHEN r2 > 6e4 THEN 'radar 2 out of range' ELSE 'radar 2 has no value' END WHEN NOT v1 THEN CASE WHEN r1 > 6e4 THEN 'radar 1 out of range' ELSE 'radar 1 has no value' END WHEN NOT ao THEN 'angle' WHEN NOT dn THEN 'downstream' ELSE 'accepted' END AS reason FROM p) SELECT reason, count(*) AS n FROM q GROUP BY reason"""),
    "radar_count": oracle("cells", "SELECT k, j, i, (vr1 IS NOT NULL)::INT + (vr2 IS NOT NULL)::INT AS radar_count, greatest(dbz1, dbz2) AS dbz FROM cells"),
    "output_masks": oracle("cells", _SYN + "SELECT k, j, i, vr1 IS NULL AND vr2 IS NULL AS wind_masked, CASE WHEN angle IS NULL THEN vr1 IS NULL OR vr2 IS NULL ELSE vr1 IS NULL OR vr2 IS NULL OR angle < 20 END AS diagnostics_masked FROM b"),
    "holdout_lattice": oracle("field", "SELECT t, count(*) AS n, count(*) FILTER (WHERE (i + 2 * j + 5 * t) % 10 = 0) AS held FROM field GROUP BY t"),
}
