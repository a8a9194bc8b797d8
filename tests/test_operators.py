"""Closed loops, exact adjoints and rules that hold for any input."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.operators import boxes, grid, kernels, match, qc, retrieval, stencil, study, unfold, variational, wind
from skyshear.plans import detect_queries, registry, wind_queries
from skyshear.sources import products, volumes
from tests.conftest import SF


def test_projection_signs(spark):
    rows = [(12, 0, 0, 90, 0, 12), (12, 0, 0, 270, 0, -12), (0, 7, 0, 0, 0, 7), (0, 0, 3, 137, 90, 3), (3, -4, 2, 35, 20, -0.778007604541623)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "u double, v double, w double, az double, el double, expected double")
    e, n, u = geo.cosines(F.col("az"), F.col("el"))
    for r in df.select((e * F.col("u") + n * F.col("v") + u * F.col("w")).alias("got"), "expected").collect():
        assert r.got == pytest.approx(r.expected, abs=1e-12)


def test_vortex_is_recovered(spark):
    out = wind_queries.QUERIES["dual_doppler_vortex"](spark, "").collect()
    assert len(out) > 300 and all(r.close and r.angle >= 20 for r in out)


def test_crossing_angle_is_symmetric(spark):
    b = spark.range(5).select(F.array(*[F.lit(float(x)) for x in (0, 90, 180, 170, 25)])[F.col("id").cast("int")].alias("az"))
    e, n, _ = geo.cosines(F.col("az"), F.lit(0.0))
    got = [r[0] for r in b.select(geo.crossing_angle(F.lit(0.0), F.lit(1.0), e, n)).collect()]
    assert got == pytest.approx([0, 90, 0, 10, 25], abs=1e-5)


def cells(spark, fn, n=(4, 5, 6), skip=()):
    rows = [(k, j, i, 1000.0 * i, 1000.0 * j, 500.0 * k, *fn(1000.0 * i, 1000.0 * j, 500.0 * k)) for k in range(n[0]) for j in range(n[1]) for i in range(n[2]) if (k, j, i) not in skip]
    return spark.createDataFrame([(*r[:6], *map(float, r[6:]), True) for r in rows], "k int, j int, i int, x double, y double, z double, u double, v double, w double, valid boolean")


def test_vorticity_of_a_linear_field(spark):
    out = stencil.divergence_vorticity(cells(spark, lambda x, y, z: (-2 * y, 3 * x, 0)), 1000.0, 1000.0).filter("vorticity IS NOT NULL").collect()
    assert len(out) == 4 * 3 * 4 and all(r.vorticity == pytest.approx(5) and r.divergence == pytest.approx(0) for r in out)


def test_a_hole_takes_its_neighbours_and_no_more(spark):
    whole, holed = (stencil.stencil_complete(cells(spark, lambda x, y, z: (0, 0, 0), (5, 5, 5), s), F.col("valid"), {"k": 5, "j": 5, "i": 5}).filter("complete").count() for s in ((), ((2, 2, 2),)))
    assert whole == 125 and holed == 125 - 7


def test_uniform_flow_has_no_mass_divergence(spark):
    out = stencil.mass_divergence(cells(spark, lambda x, y, z: (3, -4, 0))).collect()
    assert all(r.d_rho == pytest.approx(0, abs=1e-12) for r in out)


def test_difference_and_scatter_are_adjoint(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 3, 7, 7))
    rows = [(k, j, i, float(a[k, j, i]), float(b[k, j, i])) for k in range(3) for j in range(7) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, j int, i int, a double, b double")
    forward = {(r.k, r.j, r.i): r.d for r in df.withColumn("d", stencil.secant(F.col("a"), F.col("i") * 2.0, "i")).collect()}
    back = {(r.k, r.j, r.i): r.value for r in stencil.scatter_transpose(df.withColumn("value", F.col("b")), "i", 2.0, 7).collect()}
    left = sum(forward[c] * b[c] for c in forward)
    right = sum(a[c] * v for c, v in back.items())
    assert left == pytest.approx(right, rel=1e-12)


def test_forward_and_adjoint_agree(spark):
    c = wind.beams(wind_queries._vortex_cells(spark, "")).withColumns({"u": F.sin("x"), "v": F.cos("y"), "w": F.sin("z")})
    h = wind.adjoint(wind.forward(c))
    left, right = h.agg(F.sum(F.col("h1") * F.col("vr1") + F.col("h2") * F.col("vr2")), F.sum(F.col("au") * F.col("u") + F.col("av") * F.col("v") + F.col("aw") * F.col("w"))).first()
    assert left == pytest.approx(right, rel=1e-10)


def test_translation_weights_and_adjoint(spark):
    one = spark.createDataFrame([(5, 6, 1.0)], "j int, i int, v double")
    moved = {(r.j, r.i): r.v for r in grid.translate(one, 0.5, 0.25, 11, 13).collect()}
    assert moved == pytest.approx({(5, 6): 0.375, (5, 7): 0.375, (6, 6): 0.125, (6, 7): 0.125})
    assert [(r.j, r.i) for r in grid.translate(one, 2, -3, 11, 13).collect()] == [(2, 8)]
    rng = np.random.default_rng(2)
    f, g = rng.normal(size=(2, 6, 7))
    df = lambda a: spark.createDataFrame([(j, i, float(a[j, i])) for j in range(6) for i in range(7)], "j int, i int, v double")
    left = sum(r.v * g[r.j, r.i] for r in grid.translate(df(f), 1.3, -0.4, 6, 7).collect())
    right = sum(r.v * f[r.j, r.i] for r in grid.translate(df(g), 1.3, -0.4, 6, 7, adjoint=True).collect())
    assert left == pytest.approx(right, rel=1e-12)


def test_moving_blob_is_found(spark):
    blob = lambda t, dj, di: [(t, j, i, 30 * math.exp(-((j - 12 - dj) ** 2 + (i - 13 - di) ** 2) / 18)) for j in range(25) for i in range(27)]
    df = spark.createDataFrame([*blob(0, 0, 0), *blob(1, 2.35, -1.65)], "t int, j int, i int, v double")
    best = grid.best_motion(grid.motion_scores(df, 4, 5.0, 10)).first()
    assert best.dj + best.oj == pytest.approx(2.35, abs=0.4) and best.di + best.oi == pytest.approx(-1.65, abs=0.4) and best.peak > 0.98


def test_first_claim_wins_and_others_stay_alone(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "t long")
    got = match.match_times(t(0, 60, 600).toDF("t1"), t(90, 780).toDF("t2"), 120).collect()
    assert sorted(tuple(r) for r in got) == [(0, 90, 90)]


def test_tolerance_is_closed(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "t long")
    assert match.match_times(t(0).toDF("t1"), t(120).toDF("t2"), 120).count() == 1
    assert match.match_times(t(0).toDF("t1"), t(121).toDF("t2"), 120).count() == 0


def test_variational_closed_loop(spark):
    """Where the beams cross well the wind comes back; the observed components come back everywhere."""
    out = detect_queries.QUERIES["threedvar_cg"](spark, "")
    c = wind.beams(wind_queries._vortex_cells(spark, "")).join(out, ["k", "j", "i"])
    truth = F.greatest(F.abs(F.col("u") - (8 - 2e-4 * F.col("y"))), F.abs(F.col("v") - (3 + 2e-4 * F.col("x"))))
    miss = F.abs(F.col("vr1") - wind.radial(F.col("u"), F.col("v"), F.col("w"), 1))
    got = c.agg(F.max(F.when(F.col("angle") >= 30, truth)).alias("wind"), F.max(miss).alias("seen"), F.max("residual").alias("residual")).first()
    print(got)
    assert got.wind < 1.0 and got.seen < 0.5


def test_cuboid_and_rectangle(spark):
    rng = np.random.default_rng(5)
    masks = [rng.random((3, 5, 6)) < share for share in (0.5, 0.7, 0.85)]
    masks[0][:, 1:3, 1:5] = True
    rows = [(n, *map(int, c), bool(m[c])) for n, m in enumerate(masks) for c in np.ndindex(*m.shape)]

    def brute(m):
        ranges = [[(a, b) for a in range(n) for b in range(a + 1, n + 1)] for n in m.shape]
        full = [((b - a) * (d - c) * (f - e), a, b, c, d, e, f) for a, b in ranges[0] for c, d in ranges[1] for e, f in ranges[2] if m[a:b, c:d, e:f].all()]
        return min(full, key=lambda x: (-x[0], x[1], x[2], x[4], x[6], -x[5]))

    got = {r.case: tuple(r)[1:] for r in boxes.largest(spark.createDataFrame(rows, "case int, k int, j int, i int, valid boolean")).collect()}
    assert got == {n: brute(m) for n, m in enumerate(masks)} and got[0][0] >= 24


def test_low_rank_tensor_is_exact(spark):
    rng = np.random.default_rng(3)
    x = kernels.rebuilt(rng.normal(size=(2, 2, 1)), [rng.normal(size=(n, r)) for n, r in ((7, 2), (6, 2), (5, 1))])
    df = spark.createDataFrame([(0, *map(int, c), float(x[c])) for c in np.ndindex(*x.shape)], "case int, i0 int, i1 int, i2 int, value double")
    assert kernels.tucker(df, (2, 2, 1)).first().error < 1e-5


def test_rotations_ignore_distractors(spark):
    rows = [(0, i, j, k, 0.0) for i in range(9) for j in range(9) for k in range(5)]
    rows = [(c, i, j, k, 0.006 if (i, j) == (4, 4) else 0.02 if (i, j, k) == (0, 8, 0) else z) for c, i, j, k, z in rows]
    got = kernels.rotations(spark.createDataFrame(rows, "case int, i int, j int, k int, zeta double"), least=0.005, apart=3, layers=3, most=5).collect()
    assert [(r.i, r.j) for r in got] == [(4, 4)]


def test_rates_of_a_stream(spark, tmp_path):
    from skyshear.streaming import pairing

    s = spark.createDataFrame([(1, "2026-01-01 00:01:00"), (1, "2026-01-01 00:12:00"), (2, "2026-01-01 00:12:00")], "station int, t string").select("station", F.to_timestamp("t").alias("ts"))
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = pairing.scan_rate(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.start.strftime("%H:%M"), r.station): r.n for r in spark.table("rates").collect()}
    assert got[("00:00", 1)] == 2 and got[("00:00", 2)] == 1 and got[("23:40", 1)] == 1 and ("23:40", 2) not in got and len(got) == 7


def test_time_operator_and_its_adjoint(spark):
    rng = np.random.default_rng(16)
    u, r = rng.normal(size=(4, 6, 7)), rng.normal(size=(3, 6, 7))
    df = lambda a: spark.createDataFrame([(t, j, i, float(a[t, j, i])) for t, j, i in np.ndindex(*a.shape)], "t int, j int, i int, v double")
    left = sum(x.v * r[x.t, x.j, x.i] for x in grid.time_difference(df(u), 1.3, -0.4, 6, 7).collect())
    right = sum(x.v * u[x.t, x.j, x.i] for x in grid.time_adjoint(df(r), 1.3, -0.4, 6, 7).collect())
    assert left == pytest.approx(right, rel=1e-12)


def test_mass_divergence_and_its_adjoint(spark):
    rng = np.random.default_rng(17)
    n = (4, 5, 6)
    u, g = rng.normal(size=(3, *n)), rng.normal(size=n)
    rows = [(k, j, i, 1000.0 * i, 2000.0 * j, 500.0 * k, *(float(u[c, k, j, i]) for c in range(3)), True, float(g[k, j, i])) for k, j, i in np.ndindex(*n)]
    df = spark.createDataFrame(rows, "k int, j int, i int, x double, y double, z double, u double, v double, w double, valid boolean, value double")
    left = sum(r.d_rho * g[r.k, r.j, r.i] for r in stencil.mass_divergence(df).collect())
    back = stencil.mass_adjoint(df.select("k", "j", "i", "z", "value"), {"i": 1000.0, "j": 2000.0, "k": 500.0}, {"i": 6, "j": 5, "k": 4}).collect()
    right = sum(r.au * u[0, r.k, r.j, r.i] + r.av * u[1, r.k, r.j, r.i] + r.aw * u[2, r.k, r.j, r.i] for r in back)
    assert len(back) == 120 and left == pytest.approx(right, rel=1e-10)


def test_bad_weights_raise(spark):
    c = wind.beams(wind_queries._vortex_cells(spark, "")).withColumns({"u": F.lit(1.0), "v": F.lit(1.0), "w": F.lit(0.0)})
    for bad in (F.lit(-1.0), F.lit(float("nan")), F.lit(None).cast("double")):
        with pytest.raises(Exception, match="finite"):
            wind.weighted_forward(c, (F.lit(1.0), bad)).agg(F.sum("h2")).collect()


def test_no_product_in_time_is_an_error(spark):
    products_ = spark.createDataFrame([(1, 0, 0, 0, 1.0)], "station int, ts long, j int, i int, v double")
    with pytest.raises(ValueError, match="tolerance"):
        grid.composite(products_, spark.createDataFrame([(5000, 0.0, 0.0)], "t1 long, px double, py double"))


def test_streamlines_through_a_cube(spark):
    """A wind along x crosses the cube and ends outside."""
    cube = np.zeros((3, 6, 4, 4))
    cube[0] = 2.0
    seeds = spark.createDataFrame([(0, 2.5, 1.5, 1.5)], "seed long, x double, y double, z double")
    rows = kernels.streamlines(seeds, cube, (0, 0, 0), (1, 1, 1), length=0.25, most=200).collect()
    assert {(r.y, r.z) for r in rows} == {(1.5, 1.5)} and min(r.x for r in rows) < 0.3 and 4.7 < max(r.x for r in rows) < 5.0 and [r.seq for r in rows] == list(range(len(rows)))


def test_cases_of_one_table_dont_mix(spark):
    """Every stencil gives each case of a table what it gives the case alone."""
    rng = np.random.default_rng(15)
    rows = [(c, k, j, i, 1000.0 * i, 1000.0 * j, 500.0 * k, *map(float, rng.normal(size=3)), bool(rng.random() < 0.9), k == 3) for c in range(2) for k in range(4) for j in range(4) for i in range(5)]
    both = spark.createDataFrame(rows, "case int, k int, j int, i int, x double, y double, z double, u double, v double, w double, valid boolean, is_top boolean")
    steps = {
        "vorticity": lambda d: stencil.divergence_vorticity(d, 1000.0, 1000.0),
        "d_rho": stencil.mass_divergence,
        "complete": lambda d: stencil.stencil_complete(d, F.col("valid"), {"k": 4, "j": 4, "i": 5}),
        "w": lambda d: stencil.downward_integral(d.withColumn("div", F.when(F.col("valid"), F.col("u"))).drop("w"), 500.0, F.lit(0.5)),
        "u": lambda d: stencil.local_maxima(d, "u", {"k": 1, "j": 1, "i": 1}),
        "value": lambda d: stencil.scatter_transpose(d.withColumn("value", F.col("u")), "i", 1000.0, 5),
    }
    for name, step in steps.items():
        got = {(r["case"], r.k, r.j, r.i): r[name] for r in step(both).collect()}
        want = {(c, r.k, r.j, r.i): r[name] for c in range(2) for r in step(both.filter(F.col("case") == c).drop("case")).collect()}
        assert got == pytest.approx(want), name


def test_streams_pair(spark, tmp_path):
    from skyshear.streaming import pairing

    s = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (2, "2026-01-01 00:01:30"), (2, "2026-01-01 00:09:00")], "station int, t string").select("station", F.to_timestamp("t").alias("ts"))
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = pairing.pair_streams(stream.filter("station = 1"), stream.filter("station = 2")).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("pairs").count() == 1


def test_sources(spark, tmp_path):
    from skyshear.sources import products

    folder = tmp_path / "Z9317" / "PPI"
    folder.mkdir(parents=True)
    (folder / "Z9317_20260511070900Z_PPI_01_026.bin").write_bytes(b"x")
    got = products.list_products(spark, str(tmp_path)).first()
    assert (got.station, got.code, got.layer) == ("Z9317", "026", "01")
    dem = np.array([[10, 20], [30, -32768]], dtype=">i2")
    (tmp_path / "N35E118.hgt").write_bytes(dem.tobytes())
    rows = {(r.row, r.col): r.elev_m for r in products.read_dem(spark, str(tmp_path), 2).collect()}
    assert rows == {(0, 0): 10, (0, 1): 20, (1, 0): 30, (1, 1): None}
    w = spark.createDataFrame([("a", 1.0, -9999.0, 2.0, None)], "case_id string, u double, v double, w double, vorticity double")
    products.write_wind(w, str(tmp_path / "out"))
    back = products.read_wind(spark, str(tmp_path / "out")).first()
    assert back.v is None and back.u == 1.0 and back.dual_doppler_mask is False
    assert products.as_json(spark.createDataFrame([(float("nan"),)], "a double")).first().json == '{"a":null}'
    assert products.missing_columns(w, ("u", "q")) == ["q"]
    todo = products.still_to_do(spark.createDataFrame([("a", "c1"), ("b", "c1")], "case string, config string"), spark.createDataFrame([("a", "c1", True), ("b", "c1", False)], "case string, config string, finished boolean"), ["case", "config"])
    assert [r.case for r in todo.collect()] == ["b"]


@pytest.mark.parametrize("options", [(0, 20, 5, 3, 20), (2, 0, 5, 3, 20), (2, 90, 5, 3, 20), (2, 20, 4, 3, 20), (2, 20, 3, 3, 20), (2, 20, 25, 3, 20)])
def test_options_are_guarded(options):
    from skyshear.plans.misc_queries import check_options

    check_options(2, 20, 5, 3, 20)
    with pytest.raises(ValueError, match="must"):
        check_options(*options)


@pytest.mark.parametrize("name", ["circulation", "storm_mean_wind", "tangential_ratio", "dem_tiles", "feature_polar_support"])
def test_features_of_any_id_have_rows(spark, tmp_path, name):
    far = 37 * 29 * 1800  # features so far apart stand in one place, in coordinates and in azimuth and gate
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i + n, "s", 1, 1.0) for i in range(1, 11) for n in (0, far)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = [r.asDict() for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    of = lambda n: sorted(str({**r, "id": r["id"] - n}) for r in rows if 0 < r["id"] - n < 11)
    assert of(0) and of(0) == of(far)


def test_tensor_queries_take_all_rows_and_columns(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(60, 64)).astype("float32")
    rows = {}
    for first in (0, 200):
        d = str(tmp_path / str(first))
        spark.createDataFrame([(first + i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        rows[first] = [sorted(map(repr, registry.QUERIES[name](spark, d).collect())) for name in ("st_hosvd", "masked_st_hosvd")]
    assert all(rows[0]) and rows[0] == rows[200]
    got = sorted((r.n, r.singular) for r in registry.QUERIES["mode_spectrum"](spark, d).collect())
    want = np.zeros(64)
    want[:60] = np.linalg.svd(x.astype(float), compute_uv=False)
    assert [n for n, _ in got] == list(range(1, 65)) and [v for _, v in got] == pytest.approx(want, abs=1e-3)
    share = (want**2).cumsum() / (want**2).sum()
    assert registry.QUERIES["spectral_ranks"](spark, d).first().rank_99 == int((share < 0.99).sum()) + 1


def test_nearest_times_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    a, b = ([int(v) for v in np.unique(rng.integers(0, 40_000, 300))] for _ in range(2))
    left, right = (spark.createDataFrame([(v,) for v in x], f"{n} long") for n, x in (("t1", a), ("t2", b)))
    for tolerance in (1, 7, 120):
        want = {x: min((abs(x - y), y) for y in b) for x in a}
        got = {r.t1: (r.diff, r.t2) for r in match.nearest_times(left, right, tolerance).collect()}
        assert got == {x: m for x, m in want.items() if m[0] <= tolerance}


def test_nearest_feature_at_any_distance(spark):
    rng = np.random.default_rng(9)
    p, q = rng.uniform(0, 1000, (40, 2)), np.vstack([rng.uniform(0, 30, (20, 2)), [[5000.0, 5000.0]]])
    left = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(p)], "n int, x double, y double")
    right = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(q)], "id int, fx double, fy double")
    got = {r.n: r.id for r in grid.nearest(left, right, ["n"], ("x", "y"), ("fx", "fy"), 10.0, "id").collect()}
    assert got == {n: int(np.argmin(((q - v) ** 2).sum(axis=1))) for n, v in enumerate(p)}
    assert grid.nearest(left, right.limit(0), ["n"], ("x", "y"), ("fx", "fy"), 10.0, "id").count() == 0


def test_folded_velocities_come_back(spark):
    """A smooth wind folded into 12 m/s on either side, with gates missing."""
    rng = np.random.default_rng(10)
    true = lambda ray, gate: 8 * math.sin(math.radians(ray)) + 0.35 * gate
    rows = []
    for ray in range(0, 360, 6):
        for gate in range(60):
            v = true(ray, gate)
            rows.append((1, 0, ray, gate, None if rng.random() < 0.1 else (v + 12) % 24 - 12, v))
    got = kernels.dealias(spark.createDataFrame(rows, "radar int, sweep int, ray int, gate int, vr double, v double").drop("v"), 12.0)
    out = {(r.ray, r.gate): r.unfolded for r in got.collect()}
    off = [out[r[2], r[3]] - r[5] for r in rows if r[4] is not None]
    assert all(out[r[2], r[3]] is None for r in rows if r[4] is None)
    assert max(abs(x - 24 * round(x / 24)) for x in off) < 1e-5 and len({round(x / 24) for x in off}) == 1


def folded_sweeps(seed=1):
    """Sweeps whose rays 5 to 10 have no gates near the radar, so that only other rays lead to what they hold."""
    rng = np.random.default_rng(seed)
    rows = []
    for case in range(2):
        for sweep in range(2):
            for ray in range(36):
                for gate in range(40):
                    v = 9 * math.sin(math.radians(10 * ray)) + 0.6 * gate - 3.0 * sweep + 5.0 * case
                    near = 5 <= ray <= 10 and gate < 22
                    if rng.random() > 0.2:
                        rows.append((case, 1, sweep, ray, gate, None if near else (v + 8) % 16 - 8, v))
    return rows


def test_regions_unfold_what_no_ray_leads_to(spark):
    g = spark.createDataFrame(folded_sweeps(), "case int, radar int, sweep int, ray int, gate int, vr double, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(tuple(r) for r in unfold.by_regions(g.repartition(int(parts)), 8.0).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == g.count()
    offsets = {}
    for case, _, sweep, _, _, vr, v, out in results[0]:
        assert (vr is None) == (out is None)
        if vr is not None:
            assert abs((out - v) / 16 - round((out - v) / 16)) < 1e-9
            offsets.setdefault((case, sweep), set()).add(round((out - v) / 16))
    assert len(offsets) == 4 and all(len(x) == 1 for x in offsets.values())  # exact up to one shift a sweep
    rays = {(r.sweep, round((r.unfolded - r.v) / 16)) for r in kernels.dealias(g.filter("case = 0").drop("v"), 8.0).join(g.filter("case = 0"), ["radar", "sweep", "ray", "gate"]).filter("unfolded IS NOT NULL").collect()}
    assert len(rays) > 2  # ray by ray the same sweeps fall apart


def test_fold_numbers_join_the_strongest_edge_first():
    rows = [(1, 1, 100, 0.0, False), (2, 2, 50, 0.0, False), (3, 3, 10, 0.0, False), (4, 4, 5, 0.0, False), (1, 2, 20, 20 * -15.0, False), (2, 3, 8, 8 * 16.0, False), (1, 3, 1, 7.0, False), (3, 4, 2, 0.1, True)]
    out = unfold.fold_numbers(pd.DataFrame(rows, columns=["a", "b", "count", "jump", "joined"]), 8.0)
    assert dict(zip(out["run"], out["fold"], strict=True)) == {1: 0, 2: 1, 3: 0, 4: 0}
    empty = unfold.fold_numbers(pd.DataFrame(rows[:1], columns=["a", "b", "count", "jump", "joined"]), 8.0)
    assert list(empty["fold"]) == [0]


def test_qc_keeps_cases_apart(spark):
    rows = [(c, 1, 0, ray, gate, float(c * 10 + gate % 3), 30.0) for c in range(2) for ray in range(6) for gate in range(6)]
    g = spark.createDataFrame(rows, "case int, radar int, sweep int, ray int, gate int, vr double, dbz double")
    both = sorted(tuple(r) for r in qc.control(g, "V", 9.0).select("case", *qc.GATE, "vr", "dbz").collect())
    alone = sorted((c, *tuple(r)) for c in range(2) for r in qc.control(g.filter(F.col("case") == c).drop("case"), "V", 9.0).select(*qc.GATE, "vr", "dbz").collect())
    assert both == alone and len(both) == 72


def test_qc_skips_corrected_velocity(spark):
    rows = [(1, 0, ray, gate, 20.0 if gate >= 5 else -20.0, 90.0 if gate == 3 else 30.0) for ray in range(8) for gate in range(10)]
    g = spark.createDataFrame(rows, "radar int, sweep int, ray int, gate int, vr double, dbz double")
    kept = {r.vr for r in qc.control(g, "Vc", 12.0).collect()}
    assert kept == {-20.0, 20.0}
    unfolded = {r.vr for r in qc.control(g, "V", 22.0).collect()}
    assert max(unfolded) - min(unfolded) == 4
    assert qc.control(g, "Vc").filter("dbz IS NULL").count() == 8


def synthetic_cells(spark, u, v, seen=lambda k, j, i: True):
    cells = spark.createDataFrame([(k, j, i, (i - 8) * 5000.0, (j - 8) * 5000.0, 500.0 + 500.0 * k, seen(k, j, i)) for k in range(4) for j in range(17) for i in range(17)], "k int, j int, i int, x double, y double, z double, seen boolean")
    b = wind.beams(cells)
    return b.select("k", "j", "i", "x", "y", "z", *[F.when(F.col("seen"), F.col(f"bx{n}") * u + F.col(f"by{n}") * v).alias(f"vr{n}") for n in (1, 2)])


def test_first_guess_and_retrieval_of_a_uniform_wind(spark):
    cells = synthetic_cells(spark, 7.0, -3.0, lambda k, j, i: (i + j) % 5 != 0)
    background = spark.range(4).select(F.col("id").cast("int").alias("k"), F.lit(7.0).alias("ub"), F.lit(-3.0).alias("vb"))
    guess = retrieval.initial_wind(cells, background).collect()
    assert len(guess) == 4 * 17 * 17 and max(abs(r.u0 - 7) + abs(r.v0 + 3) + abs(r.w0) for r in guess) < 1e-6
    out = retrieval.retrieve(cells, background, most=60).collect()
    assert max(abs(r.u - 7) + abs(r.v + 3) for r in out) < 0.05 and max(abs(r.w) for r in out) < 0.05
    assert sum(r.wind_masked for r in out) == sum((r.i + r.j) % 5 == 0 for r in out) and all(r.diagnostics_masked for r in out if r.wind_masked)


def test_feedback_keeps_a_wind_without_divergence(spark):
    """Solid rotation has none, so feeding the vertical speed back changes nothing."""
    c = wind_queries._vortex_cells(spark, "")
    out = wind.retrieve(c.drop(*[f"{a}{n}" for a in ("bx", "by", "bz", "r") for n in (1, 2)], "angle"), 500.0, 3).filter("valid")
    got = out.agg(F.max(F.abs(F.col("u") - (8 - 2e-4 * F.col("y")))).alias("u"), F.max(F.abs("w")).alias("w"), F.count("*").alias("n")).first()
    assert got.n > 300 and got.u < 1e-4 and got.w < 1e-5


def test_gridding_in_space_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    g = rng.uniform(-6000, 6000, (400, 3))
    gates = spark.createDataFrame([(1 + n % 2, *map(float, p), None if n % 7 == 0 else float(n), float(-n)) for n, p in enumerate(g)], "radar int, gx double, gy double, gz double, vr double, dbz double")
    places = [(0, j, i, 2000.0 * i, 2000.0 * j, 0.0) for j in range(-2, 3) for i in range(-2, 3)]
    cells = spark.createDataFrame(places, "k int, j int, i int, x double, y double, z double")
    got = {(r.radar, r.j, r.i): (r.vr, r.dbz, r.n) for r in retrieval.grid_volume(cells, gates, 3000.0).collect()}
    for radar in (1, 2):
        for _, j, i, x, y, z in places:
            d2 = ((g - (x, y, z)) ** 2).sum(axis=1)
            near = [n for n in range(400) if 1 + n % 2 == radar and d2[n] <= 9e6]
            if not near:
                assert (radar, j, i) not in got
                continue
            w = {n: (9e6 - d2[n]) / (9e6 + d2[n]) for n in near}
            some = [n for n in near if n % 7]
            vr, dbz, count = got[radar, j, i]
            assert count == len(some) and dbz == pytest.approx(-sum(w[n] * n for n in near) / sum(w.values()))
            assert vr == pytest.approx(sum(w[n] * n for n in some) / sum(w[n] for n in some)) if some else vr is None


def test_spectrum_against_an_array(spark):
    x = np.random.default_rng(12).normal(size=(5, 30)) * np.arange(1, 6)[:, None]
    df = spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in np.ndindex(*x.shape)], "r int, c int, v double").repartition(3)
    rows = kernels.spectrum(df, "r", "c", "v").orderBy("n").collect()
    s = np.linalg.svd(x, compute_uv=False)
    p = s**2 / (s**2).sum()
    assert [r.singular for r in rows] == pytest.approx(s, abs=1e-3) and [r.share for r in rows] == pytest.approx(p, abs=1e-5)
    assert rows[0].effective_rank == pytest.approx(math.exp(-(p * np.log(p)).sum()), abs=1e-3)
    ranks = kernels.spectral_ranks(kernels.spectrum(df, "r", "c", "v")).first()
    assert tuple(ranks) == tuple(int(np.searchsorted(p.cumsum(), q - 1e-9)) + 1 for q in (0.90, 0.95, 0.99))


def test_masked_fit_fills_what_is_hidden(spark):
    rng = np.random.default_rng(13)
    x = kernels.rebuilt(np.ones((1, 1, 1)), [rng.uniform(1, 2, size=(n, 1)) for n in (6, 7, 5)])
    df = spark.createDataFrame([(0, *map(int, c), None if rng.random() < 0.1 else float(x[c])) for c in np.ndindex(*x.shape)], "case int, i0 int, i1 int, i2 int, value double")
    assert kernels.tucker(df, (1, 1, 1), rounds=40).first().error < 1e-3


def test_streamlines_follow_a_circle(spark):
    seeds = spark.createDataFrame([(0, 2.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0)], "seed long, x double, y double, z double")
    rows = kernels.streamlines(seeds, lambda p: (-p[1], p[0], 0.0), (0, 0, 0), (1, 1, 1), length=0.1, most=30).collect()
    assert len(rows) == 2 * 60 and all(math.hypot(r.x, r.y) == pytest.approx(2 if r.seed == 0 else 5, abs=1e-4) for r in rows)
    assert all(r.speed == pytest.approx(2 if r.seed == 0 else 5, abs=1e-4) for r in rows)


def test_trilinear_is_exact_for_linear_fields():
    n = np.indices((4, 5, 6)).astype(float)
    u = np.stack([2 * n[0] - n[1] + 3 * n[2], n[0] + n[1]])
    p = np.array([1.25, 2.5, 3.75])
    assert kernels.trilinear(u, p) == pytest.approx([2 * 1.25 - 2.5 + 3 * 3.75, 3.75])
    assert (kernels.trilinear(u, np.array([3.5, 1, 1])) == 0).all() and (kernels.trilinear(u, np.array([-0.1, 1, 1])) == 0).all()


def test_rank_study_of_an_exact_field(spark):
    """A standing wave of rank 1 is kept whole by every rule in its own frame."""
    rows = [(t, j, i, (1.0 + t) * math.sin(0.4 * j + 0.2) * math.cos(0.3 * i)) for t in range(6) for j in range(9) for i in range(10)]
    out = study.rank_study(spark.createDataFrame(rows, "t int, j int, i int, v double"), (0.0, 0.0), 6, 9, 10).collect()
    assert len(out) == 9 * 2 * 2 * 5 and max(r.error for r in out) < 1e-4 and all(r.speed_kept == pytest.approx(1, abs=1e-4) for r in out)
    assert {r.rule for r in out if r.compression > 1} == set(study.RULES)


def test_vortex_kept_by_hand(spark):
    """An estimate with nine tenths of a rotation keeps nine tenths of its measures, in its place."""
    rows = []
    for k in range(5):
        for j in range(9):
            for i in range(9):
                x, y = 1000.0 * (i - 4), 1000.0 * (j - 4)
                g = math.exp(-(x * x + y * y) / 8e6) * (1.0 if k < 3 else 0.05)
                rows.append((k, j, i, x, y, 500.0 * k, True, -y * g, x * g, -0.9 * y * g, 0.9 * x * g))
    r = study.vortex_kept(spark.createDataFrame(rows, "k int, j int, i int, x double, y double, z double, valid boolean, u double, v double, eu double, ev double"), 1000.0, 1000.0, 500.0).first()
    assert r.zeta_kept == pytest.approx(0.9) and r.circulation_kept == pytest.approx(0.9) and r.cyclonic_kept == pytest.approx(0.9)
    assert r.shift == 0 and (r.depth, r.depth_est) == (1500.0, 1500.0) and r.coverage == 1


def test_readers_of_sweeps_and_lines(spark, tmp_path):
    import struct

    (tmp_path / "v").mkdir()
    for layer, elevation in ((1, 1.5), (2, 0.5)):
        with (tmp_path / "v" / f"Z9317_20260101000000Z_PPI_0{layer}_026.npz").open("wb") as f:
            np.savez(f, azimuth=np.arange(4.0) * 90, V=np.array([[1.0, np.nan, 3.0]] * 4), elevation=elevation)
    (tmp_path / "v" / "Z9317_20260101000000Z_PPI_03_026.npz").write_bytes(b"broken")
    sweeps = volumes.read_sweeps(spark, str(tmp_path / "v"))
    assert sweeps.filter("corrupt IS NOT NULL").count() == 1
    rows = volumes.volume(sweeps).collect()
    assert len(rows) == 24 and {(r.sweep, r.elevation, r.station) for r in rows} == {(0, 0.5, "Z9317"), (1, 1.5, "Z9317")}
    assert sum(r.value is None for r in rows) == 8 and {r.azimuth for r in rows} == {0.0, 90.0, 180.0, 270.0}

    def line(number, parts):
        points = [p for part in parts for p in part]
        body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(points)) + b"".join(struct.pack("<i", sum(map(len, parts[:n]))) for n in range(len(parts))) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">ii", number, len(body) // 2) + body

    (tmp_path / "rivers.shp").write_bytes(b"\0" * 100 + line(1, [[(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 7)]]) + line(2, [[(50, 50), (51, 51)]]))
    points = volumes.read_lines(spark, str(tmp_path))
    assert sorted((r.line, r.seq, r.lon) for r in points.collect()) == [(1, 0, 5.0), (1, 1, 6.0), (1, 2, 7.0), (2, 0, 50.0), (2, 1, 51.0)]
    assert {r.line for r in volumes.lines_in(points, (0.0, 10.0, 0.0, 10.0)).collect()} == {1}


def test_sinks_and_sets(spark, tmp_path):
    cells = spark.createDataFrame([(f"case{c}", 0, 0, i, float(i), 0.0, 0.0, float(c), True) for c in range(6) for i in range(3)], "case_id string, k int, j int, i int, x double, y double, z double, u double, ok boolean")
    products.write_grid(cells, str(tmp_path / "grid"))
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 18
    assert volumes.baseline_set(cells, "^case[0-5]$").count() == 18
    for bad in (cells.filter("case_id <> 'case3'"), cells.filter("case_id <> 'case3' OR i < 2")):
        with pytest.raises(ValueError):
            volumes.baseline_set(bad, "^case")
    products.write_diagnostics(cells, str(tmp_path / "small"))
    assert dict(spark.read.parquet(str(tmp_path / "small")).dtypes) | {"u": "float", "ok": "tinyint"} == dict(spark.read.parquet(str(tmp_path / "small")).dtypes)
    out = products.enrich(spark, str(tmp_path / "small"), {"masked": F.col("u") > 2})
    assert out.filter("masked").count() == 9 and sorted(p.name for p in tmp_path.iterdir()) == ["grid", "small"]
    products.write_csv(products.append_records(cells.select("k", "u"), cells.select("k", "ok")), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == ["k", "u", "ok"] and back.count() == 36
    features = spark.createDataFrame([(100, "a"), (100, "b"), (900, "c")], "ts long, name string")
    near = volumes.nearest_features(features, spark.createDataFrame([(130,), (5000,)], "t1 long"), 600).collect()
    assert sorted((r.t1, r.name) for r in near) == [(130, "a"), (130, "b")]


def test_no_plan_has_a_cartesian_product(spark):
    names = ["m_product_match", "feature_neighbourhood", "circulation", "storm_mean_wind", "tangential_ratio", "tolerance_sweep", "time_match_greedy", "cressman_grid", "blend_weight", "grid_volume"]
    for name in names:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
