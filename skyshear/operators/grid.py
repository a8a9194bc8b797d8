"""Gridding, sampling, smoothing, translation and motion, as joins and sums."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyshear.functions.geo import exact_sum, nonzero
from skyshear.operators.stencil import AXES, beside, cases
from skyshear.sources.store import stored


def near_join(left: DataFrame, right: DataFrame, a: tuple[str, ...], b: tuple[str, ...], radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within ``radius`` and equal in ``on``, with ``d2``: an equi-join on cubes of that size, the left side in its own and all neighbouring ones."""
    cube = lambda cols, shift: [F.floor(F.col(c) / radius).cast("long") + s for c, s in zip(cols, shift, strict=True)]
    shifts = [()]
    for _ in a:
        shifts = [(*s, d) for s in shifts for d in (-1, 0, 1)]
    probe = left.withColumn("_q", F.explode(F.array(*[F.struct(*[x.alias(f"c{n}") for n, x in enumerate(cube(a, s))]) for s in shifts])))
    build = right.withColumn("_q", F.struct(*[x.alias(f"c{n}") for n, x in enumerate(cube(b, (0,) * len(b)))]))
    d2 = sum(((F.col(x) - F.col(y)) ** 2 for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return probe.join(build, ["_q", *on]).drop("_q").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, ...], b: tuple[str, ...], radius: float, tie: str) -> DataFrame:
    """``left`` with the nearest row of ``right`` (smallest ``tie`` on equal distances) and ``d2``; every row has one unless ``right`` is empty.

    Rows that have none within ``radius`` are looked at again with twice the
    radius, so nothing is a cross join and the number of rounds is logarithmic.
    """
    ends = lambda df, cols: df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    p, q = ends(left, a), ends(right, b)
    if any(e[f"lo{i}"] is None for e in (p, q) for i in range(len(a))):
        return left.join(right.limit(0).withColumn("d2", F.lit(0.0)), F.lit(False), "inner")
    span = math.sqrt(sum((max(p[f"hi{i}"], q[f"hi{i}"]) - min(p[f"lo{i}"], q[f"lo{i}"])) ** 2 for i in range(len(a))))
    rest, out = left, None
    while True:
        pairs = near_join(rest, right, a, b, radius)
        best = pairs.groupBy(*keys).agg(F.min_by(F.struct(*pairs.columns), F.struct("d2", tie)).alias("_m")).select("_m.*")
        if radius > span:
            return best if out is None else out.unionByName(best)
        best = stored(best, "nearest")
        rest = stored(rest.join(best.select(*keys), keys, "left_anti"), "nearest-rest")
        out = best if out is None else out.unionByName(best)
        if rest.isEmpty():
            return out
        radius *= 2


def cressman(cells: DataFrame, gates: DataFrame, keys: list[str], value: str, radius: float) -> DataFrame:
    """Weighted mean of the gates around each cell, weight (R2 - d2) / (R2 + d2)."""
    near = near_join(cells, gates, ("x", "y"), ("gx", "gy"), radius).filter(F.col(value).isNotNull())
    w = (radius * radius - F.col("d2")) / (radius * radius + F.col("d2"))
    return near.groupBy(*keys).agg((exact_sum(w * F.col(value)) / nonzero(exact_sum(w))).alias("value"), F.count("*").alias("n"))


def bilinear(points: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("id",), on: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (keys, px, py in cells) sampled from ``grid`` (on, j, i, value); null where one of the four corners is."""
    base = points.withColumn("_i", F.floor("px").cast("int")).withColumn("_j", F.floor("py").cast("int"))
    corner = F.explode(F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj in (0, 1) for di in (0, 1)]))
    c = base.withColumn("c", corner).select(*keys, "px", "py", (F.col("_j") + F.col("c.dj")).alias("j"), (F.col("_i") + F.col("c.di")).alias("i"))
    w = (1 - F.abs(F.col("px") - F.col("i"))) * (1 - F.abs(F.col("py") - F.col("j")))
    got = c.join(grid, [*on, "j", "i"], "left").groupBy(*keys).agg(exact_sum(w * F.col("value"), 12).alias("value"), F.count("value").alias("n"))
    return got.select(*keys, F.when(F.col("n") == 4, F.col("value")).alias("value"))


def linear(levels: DataFrame, at: DataFrame, x: str, y: str) -> DataFrame:
    """``at`` (x0) interpolated in a profile of (x, y), clamped at its ends; a profile is small and broadcast."""
    w = Window.orderBy(x)
    legs = levels.withColumn("x1", F.lead(x).over(w)).withColumn("y1", F.lead(y).over(w))
    ends = levels.agg(F.min(F.struct(x, y)).alias("lo"), F.max(F.struct(x, y)).alias("hi"), F.count("*").alias("n"))
    joined = at.join(F.broadcast(legs), (F.col("x0") >= F.col(x)) & (F.col("x0") < F.col("x1")), "left").crossJoin(F.broadcast(ends))
    inside = F.col(y) + (F.col("y1") - F.col(y)) * (F.col("x0") - F.col(x)) / (F.col("x1") - F.col(x))
    value = F.when(F.col("x0") < F.col(f"lo.{x}"), F.col(f"lo.{y}")).when(F.col("x0") >= F.col(f"hi.{x}"), F.col(f"hi.{y}")).otherwise(inside)
    return joined.select(*at.columns, F.when(F.col("n") >= 2, value).alias("value"))


def smoothed(cells: DataFrame, values: tuple[str, ...], sigma: float, reach: int, axes: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """Gaussian means of ``values`` (``s_`` before each) over the cells that have all of them, one axis after the other.

    Sums and weights travel together, so holes and what lies outside count for
    nothing, whatever their place. Every cell of the table gets a mean; null where
    no valid cell is within ``reach`` along each axis. Partial sums are made
    before each of the shuffles, one an axis. Cases don't mix.
    """
    keys = [*cases(cells), "k", "j", "i"]
    valid = cells.filter(" AND ".join(f"{v} IS NOT NULL" for v in values))
    out = valid.select(*keys, *[F.col(v).alias(f"s_{v}") for v in values], F.lit(1.0).alias("s_"))
    total = sum(math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1))
    legs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.exp(-d * d / (2 * sigma * sigma)) / total).alias("w")) for d in range(-reach, reach + 1)])
    sums = [f"s_{v}" for v in values] + ["s_"]
    for axis in axes:
        spread = out.withColumn("leg", F.explode(legs)).withColumn(axis, F.col(axis) + F.col("leg.d"))
        out = spread.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("leg.w")).alias(c) for c in sums])
    kept = cells.select(*keys).join(out, keys, "left")
    return kept.select(*keys, *[(F.col(f"s_{v}") / F.greatest(F.col("s_"), F.lit(1e-6))).alias(f"s_{v}") for v in values])


def smooth(cells: DataFrame, value: str, sigma: float, reach: int) -> DataFrame:
    """Gaussian mean ``smooth`` over valid cells of a level, along i, then j."""
    return smoothed(cells, (value,), sigma, reach, ("i", "j")).withColumnRenamed(f"s_{value}", "smooth")


def distances(cells: DataFrame) -> DataFrame:
    """``d2``: each cell's exact squared distance to the nearest valid cell of its level; null on a level without one.

    First the nearest along each row, from both sides, then along each column the
    least of row distance and way to the row, for all columns at once. One group
    is one level of one case.
    """
    by = [*cases(cells), "k"]
    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)

    def level(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["j", "i"]].copy()
        for n, name in enumerate(by):
            out.insert(n, name, key[n])
        xs, at_x = np.unique(rows["x"], return_inverse=True)
        ys, at_y = np.unique(rows["y"], return_inverse=True)
        valid = np.zeros((len(ys), len(xs)), bool)
        ok = rows["valid"].to_numpy(bool)
        valid[at_y[ok], at_x[ok]] = True
        before = np.maximum.accumulate(np.where(valid, xs, -np.inf), axis=1)
        after = np.minimum.accumulate(np.where(valid, xs, np.inf)[:, ::-1], axis=1)[:, ::-1]
        along = np.minimum(xs - before, after - xs) ** 2
        best = np.full(valid.shape, np.inf)
        for row in np.flatnonzero(valid.any(axis=1)):
            best = np.minimum(best, along[row] + (ys[:, None] - ys[row]) ** 2)
        found = best[at_y, at_x]
        out["d2"] = np.where(np.isfinite(found), found, np.nan)
        return out

    out = cells.select(*by, "j", "i", "x", "y", "valid").groupBy(*by).applyInPandas(level, f"{kinds}, j int, i int, d2 double")
    return out.withColumn("d2", F.nanvl("d2", F.lit(None).cast("double")))


def blend_weight(cells: DataFrame, sigma: float) -> DataFrame:
    """exp(-d2 / 2 sigma2) with the distance to the level's nearest valid cell; 0 on a level without one."""
    return distances(cells).withColumn("weight", F.coalesce(F.exp(-F.col("d2") / (2 * sigma * sigma)), F.lit(0.0))).drop("d2")


def low_pass(cells: DataFrame, values: tuple[str, ...], window: int = 5, order: int = 3) -> DataFrame:
    """``values`` of a full grid smoothed by local least-squares polynomials (Savitzky and Golay) along k, j and i, one after the other.

    A cell takes the polynomial of the ``window`` cells around it, at the ends of
    its line that of the line's first or last ones. Lines shorter than ``window``,
    or with a cell missing in it, keep their values.
    """
    by, half = cases(cells), window // 2
    powers = np.vander(np.arange(window, dtype=float), order + 1, increasing=True)
    weights = powers @ np.linalg.pinv(powers)  # row a: what the cells of the window give to its cell a
    out = cells
    for axis in ("k", "j", "i"):
        line = Window.partitionBy(*by, *AXES[axis])
        place = F.greatest(F.lit(0), F.least(F.col("_n") - window, F.col("_a") - half))
        out = out.withColumn("_a", F.col(axis) - F.min(axis).over(line)).withColumn("_n", F.max(axis).over(line) - F.min(axis).over(line) + 1)
        out = out.withColumn("_r", (F.col("_a") - place).cast("int"))
        table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
        for v in values:
            parts = [
                F.when((F.col("_r") + d >= 0) & (F.col("_r") + d < window), F.get(F.get(table, F.col("_r")), F.col("_r") + d) * beside(F.col(v), axis, d, by)).when((F.col("_r") + d < 0) | (F.col("_r") + d >= window), 0.0)
                for d in range(1 - window, window)
            ]
            out = out.withColumn(f"_{v}", F.when(F.col("_n") >= window, reduce(lambda a, b: a + b, parts)))
        out = out.withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop("_a", "_n", "_r", *[f"_{v}" for v in values])
    return out


def lerp(levels: tuple, value: Column) -> list[Column]:
    """Colours at ``value`` between the given levels (value, r, g, b), clipped at both ends."""
    v = F.greatest(F.lit(float(levels[0][0])), F.least(F.lit(float(levels[-1][0])), value))
    out = []
    for n in (1, 2, 3):
        e = F.lit(float(levels[-1][n]))
        for lo, hi in reversed(list(zip(levels[:-1], levels[1:], strict=True))):
            e = F.when(v < hi[0], lo[n] + (hi[n] - lo[n]) * (v - lo[0]) / float(hi[0] - lo[0])).otherwise(e)
        out.append(e / 255.0)
    return out


def _steps(shift: float) -> list[tuple[int, float]]:
    whole, part = math.floor(shift), shift - math.floor(shift)
    if part < 1e-12 or part > 1 - 1e-12:
        return [(round(shift), 1.0)]
    return [(whole, 1 - part), (whole + 1, part)]


def translate(field: DataFrame, dx: float, dy: float, ny: int, nx: int, adjoint: bool = False) -> DataFrame:
    """``field`` (keys, j, i, v) moved by (dx, dy) cells; what leaves the domain is lost, what enters is zero. The adjoint moves it back with the same weights."""
    sign = -1 if adjoint else 1
    moves = F.array(*[F.struct(F.lit(sign * sj).alias("sj"), F.lit(sign * si).alias("si"), F.lit(wj * wi).alias("w")) for sj, wj in _steps(dy) for si, wi in _steps(dx)])
    keys = [c for c in field.columns if c not in ("j", "i", "v")]
    out = field.withColumn("m", F.explode(moves)).select(*keys, (F.col("j") + F.col("m.sj")).alias("j"), (F.col("i") + F.col("m.si")).alias("i"), (F.col("v") * F.col("m.w")).alias("v"))
    return out.filter(F.col("j").between(0, ny - 1) & F.col("i").between(0, nx - 1)).groupBy(*keys, "j", "i").agg(F.sum("v").alias("v"))


def translate_by(field: DataFrame, shifts: DataFrame, keys: list[str], ny: int, nx: int) -> DataFrame:
    """``field`` (keys, j, i, v) moved by the (dx, dy) that ``shifts`` gives for its ``keys``; what leaves the domain is lost."""
    legs = lambda c: F.filter(F.array(*[F.struct((F.floor(c) + n).cast("int").alias("s"), (1 - F.abs(F.col(c) - F.floor(c) - n)).alias("w")) for n in (0, 1)]), lambda x: x["w"] > 1e-12)
    both = field.join(shifts.select(*keys, F.explode(legs("dx")).alias("a"), "dy").select(*keys, "a", F.explode(legs("dy")).alias("b")), keys)
    out = both.select(*keys, (F.col("j") + F.col("b.s")).alias("j"), (F.col("i") + F.col("a.s")).alias("i"), (F.col("v") * F.col("a.w") * F.col("b.w")).alias("v"))
    return out.filter(F.col("j").between(0, ny - 1) & F.col("i").between(0, nx - 1)).groupBy(*keys, "j", "i").agg(F.sum("v").alias("v"))


def time_difference(field: DataFrame, dx: float, dy: float, ny: int, nx: int) -> DataFrame:
    """T: ``t, j, i, v`` of each volume's successor less the volume moved by (dx, dy); what either lacks is zero."""
    moved = translate(field, dx, dy, ny, nx).select("t", "j", "i", (-F.col("v")).alias("v"))
    later = field.select((F.col("t") - 1).alias("t"), "j", "i", "v")
    ends = field.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    return moved.unionByName(later).filter(F.col("t").between(ends["lo"], ends["hi"] - 1) if ends["lo"] is not None else F.lit(False)).groupBy("t", "j", "i").agg(F.sum("v").alias("v"))


def time_adjoint(change: DataFrame, dx: float, dy: float, ny: int, nx: int) -> DataFrame:
    """T*: each change goes to the later volume as it is and, moved back and negated, to the earlier one."""
    back = translate(change, dx, dy, ny, nx, adjoint=True).select("t", "j", "i", (-F.col("v")).alias("v"))
    return back.unionByName(change.select((F.col("t") + 1).alias("t"), "j", "i", "v")).groupBy("t", "j", "i").agg(F.sum("v").alias("v"))


def trilinear(points: DataFrame, cells: DataFrame, sizes: tuple[int, int, int], values: tuple[str, ...]) -> DataFrame:
    """``points`` (id, px, py, pz in cells) with ``values`` of ``cells`` (k, j, i): from eight corners, missing ones as zero; zero outside and on the last cells.

    Where both tables have case columns, points read the cells of their own case.
    """
    by = [c for c in cases(cells) if c in points.columns]
    base = {a: F.floor(f"p{b}").cast("int") for a, b in zip("kji", "zyx", strict=True)}
    corner = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip("kji", c, strict=True)]) for c in ((x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1))]))
    inside = F.lit(True)
    for a, n in zip("kji", sizes, strict=True):
        inside = inside & (base[a] >= 0) & (base[a] < n - 1)
    c = points.withColumn("_in", inside).withColumn("_c", corner).select(*by, "id", "px", "py", "pz", "_in", *[(base[a] + F.col(f"_c.{a}")).alias(a) for a in "kji"])
    w = (1 - F.abs(F.col("px") - F.col("i"))) * (1 - F.abs(F.col("py") - F.col("j"))) * (1 - F.abs(F.col("pz") - F.col("k")))
    mean = lambda v: F.sum(F.when(F.col("_in"), w * F.coalesce(v, F.lit(0.0))).otherwise(0.0)).alias(v)
    return c.join(cells.select(*by, "k", "j", "i", *values), [*by, "k", "j", "i"], "left").groupBy(*by, "id").agg(*[mean(v) for v in values])


def composite(products: DataFrame, wanted: DataFrame, tolerance: int = 180, least: float = -20.0) -> DataFrame:
    """``t1, py, px, v, stations``: the largest value of several stations at each wanted place and time.

    ``products``: station, ts (s), j, i, v; ``wanted``: t1, px, py (cells). Of each
    station the product nearest to t1 counts, if it is within ``tolerance``; values
    below ``least`` are none, and the four corners of a place must have one.
    """
    from skyshear.operators.match import nearest_within

    times = products.select("station", F.col("ts").alias("t2")).distinct()
    near = None
    for (station,) in times.select("station").distinct().orderBy("station").collect():  # a few stations
        one = nearest_within(wanted.select("t1").distinct(), times.filter(F.col("station") == station).select("t2"), tolerance).filter("t2 IS NOT NULL").select("t1", "t2", F.lit(station).alias("station"))
        near = one if near is None else near.unionByName(one)
    if near is None or near.isEmpty():
        raise ValueError("no product lies within the tolerance of any wanted time")
    fields = near.join(products.withColumnRenamed("ts", "t2"), ["station", "t2"]).select("t1", "station", "j", "i", F.when(F.col("v") >= least, F.col("v")).alias("value"))
    at = wanted.select("t1", "px", "py").distinct().join(near.select("t1", "station"), "t1").withColumn("id", F.struct("t1", "station", "px", "py"))
    got = bilinear(at, fields, ("id", "t1", "station"), ("t1", "station")).filter("value IS NOT NULL")
    return got.groupBy("t1", F.col("id.py").alias("py"), F.col("id.px").alias("px")).agg(F.max("value").alias("v"), F.count("*").alias("stations"))


def transported_mask(mask: DataFrame, dx: float, dy: float, ny: int, nx: int) -> DataFrame:
    """Cells all of whose sources are in the domain and valid, of ``mask`` (keys, j, i) that lists valid cells."""
    moves = [(sj, si) for sj, _ in _steps(dy) for si, _ in _steps(dx)]
    keys = [c for c in mask.columns if c not in ("j", "i")]
    out = mask.withColumn("m", F.explode(F.array(*[F.struct(F.lit(a).alias("sj"), F.lit(b).alias("si")) for a, b in moves])))
    out = out.select(*keys, (F.col("j") + F.col("m.sj")).alias("j"), (F.col("i") + F.col("m.si")).alias("i"))
    return out.filter(F.col("j").between(0, ny - 1) & F.col("i").between(0, nx - 1)).groupBy(*keys, "j", "i").agg(F.count("*").alias("n")).filter(F.col("n") == len(moves)).drop("n")


def motion_scores(field: DataFrame, most: int, floor: float, least: int) -> DataFrame:
    """``t, dj, di, score, cells``: cosine of two successive fields' excess over ``floor`` under each whole shift, over cells where either has one.

    Shifts, (2 most + 1)^2 of them, multiply the cells of the earlier field only,
    and only shifted cells that are observed later take part.
    """
    now = field.select("t", "j", "i", F.greatest(F.col("v") - floor, F.lit(0.0)).alias("a"))
    later = field.select((F.col("t") - 1).alias("t"), "j", "i", F.greatest(F.col("v") - floor, F.lit(0.0)).alias("b"))
    span = F.sequence(F.lit(-most), F.lit(most))
    moved = now.withColumn("dj", F.explode(span)).withColumn("di", F.explode(span)).withColumn("j", F.col("j") + F.col("dj")).withColumn("i", F.col("i") + F.col("di"))
    both = moved.join(later, ["t", "j", "i"]).filter("a > 0 OR b > 0")
    g = both.groupBy("t", "dj", "di").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"), F.count("*").alias("cells"))
    return g.filter(F.col("cells") >= least).select("t", "dj", "di", (F.col("ab") / nonzero(F.sqrt(F.col("aa") * F.col("bb")))).alias("score"), "cells")


def parabolic(before: Column, at: Column, after: Column) -> Column:
    """Offset of the peak of a parabola through three scores, within half a cell; 0 where there is none."""
    bend = before - 2 * at + after
    off = 0.5 * (before - after) / F.nullif(bend, F.lit(0.0))
    return F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), off))).otherwise(0.0)


def motion_found(field: DataFrame, most: int, floor: float = 20.0, least: int = 25) -> DataFrame:
    """The motion between successive fields and how far to trust it.

    ``field`` has t, j, i, v and whatever columns tell cases apart; v is null where
    nothing is observed. Each time gives one row: the best shift ``dj, di`` of at
    most ``most`` cells (first in row order on ties) by the cosine of the excesses
    over ``floor``, with offsets ``oj, oi`` within a cell; ``peak``, ``second``
    (outside the peak's 3 x 3 surroundings) and ``margin``; ``overlap``, the share of
    cells with an excess in both among those with one in either; ``finite``, the
    share of observed cells that both observe; ``at_edge`` of the search; and
    ``confidence``. A shift counts if at least ``least`` observed cells have an
    excess in either; a time without such a shift has no row.

    Only cells with an excess are shifted, from both sides: a union's size is
    that of both parts less what they share.
    """
    by = tuple(c for c in cases(field) if c not in ("t", "t_idx"))
    seen = field.filter("v IS NOT NULL AND NOT isnan(v)").select(*by, "t", "j", "i", F.greatest(F.col("v") - floor, F.lit(0.0)).alias("e"))
    later = seen.withColumn("t", F.col("t") - 1)
    span = F.sequence(F.lit(-most), F.lit(most))

    def shifted(cells: DataFrame, sign: int, name: str) -> DataFrame:
        every = cells.filter("e > 0").withColumn("dj", F.explode(span)).withColumn("di", F.explode(span))
        return every.select(*by, "t", "dj", "di", (F.col("j") + sign * F.col("dj")).alias("j"), (F.col("i") + sign * F.col("di")).alias("i"), F.col("e").alias(name))

    on, key = [*by, "t", "j", "i"], [*by, "t", "dj", "di"]
    ahead = shifted(seen, 1, "a").join(later.withColumnRenamed("e", "b"), on).groupBy(*key)
    ahead = ahead.agg(F.count("*").alias("n_a"), F.count_if(F.col("b") > 0).alias("both"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"))
    back = shifted(later, -1, "b").join(seen, on).groupBy(*key).agg(F.count("*").alias("n_b"), F.sum(F.col("b") ** 2).alias("bb"))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    score = F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 9)
    scores = ahead.join(back, key).filter(union >= least).select(*key, score.alias("score"), (F.col("both") / union).alias("overlap"))

    top = F.max(F.struct("score", (-F.col("dj")).alias("j"), (-F.col("di")).alias("i"), "overlap"))
    best = scores.groupBy(*by, "t").agg(top.alias("m")).select(*by, "t", (-F.col("m.j")).alias("bj"), (-F.col("m.i")).alias("bi"), F.col("m.score").alias("peak"), "m.overlap")
    at = lambda a, b: F.max(F.when((F.col("dj") == F.col("bj") + a) & (F.col("di") == F.col("bi") + b), F.col("score")))
    far = (F.abs(F.col("dj") - F.col("bj")) > 1) | (F.abs(F.col("di") - F.col("bi")) > 1)
    g = scores.drop("overlap").join(best, [*by, "t"]).groupBy(*by, "t", "bj", "bi", "peak", "overlap")
    g = g.agg(at(-1, 0).alias("n"), at(1, 0).alias("s"), at(0, -1).alias("w"), at(0, 1).alias("e"), F.max(F.when(far, F.col("score"))).alias("second"))

    sizes = seen.groupBy(*by, "t").agg(F.count("*").alias("size"))
    moved = seen.join(best.select(*by, "t", "bj", "bi"), [*by, "t"]).select(*by, "t", (F.col("j") + F.col("bj")).alias("j"), (F.col("i") + F.col("bi")).alias("i"))
    shared = moved.join(later, on).groupBy(*by, "t").agg(F.count("*").alias("shared"))
    least_seen = sizes.join(sizes.select(*by, (F.col("t") - 1).alias("t"), F.col("size").alias("next")), [*by, "t"])
    finite = shared.join(least_seen, [*by, "t"]).select(*by, "t", (F.col("shared") / F.least("size", "next")).alias("finite"))

    edge = (F.abs("bj") == most) | (F.abs("bi") == most)
    margin = F.col("peak") - F.col("second")
    sure = (F.col("peak") >= 0.8) & (F.col("overlap") >= 0.45) & F.coalesce(margin >= 0.02, F.lit(False)) & ~edge
    fair = (F.col("peak") >= 0.6) & (F.col("overlap") >= 0.25) & ~edge
    return g.join(finite, [*by, "t"]).select(
        *by, "t", F.col("bj").alias("dj"), F.col("bi").alias("di"), parabolic(F.col("n"), F.col("peak"), F.col("s")).alias("oj"), parabolic(F.col("w"), F.col("peak"), F.col("e")).alias("oi"),
        "peak", "second", margin.alias("margin"), "overlap", "finite", edge.alias("at_edge"), F.when(sure, "high").when(fair, "medium").otherwise("low").alias("confidence"),
    )


def best_motion(scores: DataFrame) -> DataFrame:
    """The best shift of each time (first in row order on ties) with sub-cell offsets and the runner-up outside its 3 x 3 surroundings."""
    w = Window.partitionBy("t").orderBy(F.col("score").desc(), "dj", "di")
    best = scores.withColumn("r", F.row_number().over(w)).filter("r = 1").select("t", F.col("dj").alias("bj"), F.col("di").alias("bi"), F.col("score").alias("peak"), "cells")
    j = scores.join(F.broadcast(best), "t")
    at = lambda a, b: F.max(F.when((F.col("dj") == F.col("bj") + a) & (F.col("di") == F.col("bi") + b), F.col("score")))
    far = (F.abs(F.col("dj") - F.col("bj")) > 1) | (F.abs(F.col("di") - F.col("bi")) > 1)
    g = j.groupBy("t", "bj", "bi", "peak").agg(at(-1, 0).alias("n"), at(1, 0).alias("s"), at(0, -1).alias("w"), at(0, 1).alias("e"), F.max(F.when(far, F.col("score"))).alias("second"))
    off = lambda a, b: F.coalesce(parabolic(F.col(a), F.col("peak"), F.col(b)), F.lit(0.0))
    return g.select("t", F.col("bj").alias("dj"), F.col("bi").alias("di"), "peak", "second", off("n", "s").alias("oj"), off("w", "e").alias("oi"))
