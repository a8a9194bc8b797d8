"""Summaries: bins, percentiles, gates of quality, masks over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyshear.functions.geo import azimuth, nonzero, rounded, wrapped
from skyshear.model import ANGLE_EDGES, RANGE_EDGES, RESIDUAL_P95, W_P99


def bin_of(value: Column, edges: tuple, closed_end: bool) -> Column:
    """Number of the left-closed bin that holds ``value``; the last may hold its end, or all above."""
    out = F.lit(None).cast("int")
    for n, low in enumerate(edges[:-1]):
        high = edges[n + 1]
        inside = (value >= low) & ((value < high) if n + 2 < len(edges) or not closed_end else (value <= high))
        out = F.when(inside, n).otherwise(out)
    return out if closed_end else F.when(value >= edges[-1], len(edges) - 1).otherwise(out)


def with_next(cells: DataFrame, volumes: int) -> DataFrame:
    """``t, j, i, now, next``: cells of ``cells`` (t, j, i) at t or t + 1, and at which of both, for all pairs of successive volumes."""
    each = F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(True).alias("now")), F.struct((F.col("t") - 1).alias("t"), F.lit(False).alias("now"))))
    rows = cells.select("j", "i", each.alias("e")).select("e.t", "j", "i", "e.now").filter(F.col("t").between(0, volumes - 2))
    return rows.groupBy("t", "j", "i").agg(F.max("now").alias("now"), F.max(~F.col("now")).alias("next"))


def coverage_by_height(cells: DataFrame) -> DataFrame:
    """Shares of each level that either radar sees, both see, and the crossing angle accepts."""
    v1, v2 = F.col("vr1").isNotNull(), F.col("vr2").isNotNull()
    both, ok = F.count_if(v1 & v2), F.count_if(v1 & v2 & (F.col("angle") >= 20))
    share = lambda c: rounded(F.avg(c.cast("double")))
    return cells.groupBy("k").agg(share(v1).alias("radar1"), share(v2).alias("radar2"), share(v1 & v2).alias("dual"), share(v1 & v2 & (F.col("angle") >= 20)).alias("accepted"), rounded((both - ok) / F.nullif(both, F.lit(0))).alias("rejected_of_dual"), both.alias("dual_count"), ok.alias("accepted_count"), F.count("*").alias("cells"))


def angle_bins(cells: DataFrame) -> DataFrame:
    """Dual cells of each level by crossing angle, empty bins included."""
    levels = cells.groupBy("k").agg(F.count("*").alias("cells"), F.count_if(F.col("vr1").isNotNull() & F.col("vr2").isNotNull()).alias("dual"))
    found = cells.filter("vr1 IS NOT NULL AND vr2 IS NOT NULL").withColumn("bin", bin_of(F.col("angle"), ANGLE_EDGES, True)).groupBy("k", "bin").agg(F.count("*").alias("n"))
    every = levels.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(ANGLE_EDGES) - 2))))
    n = F.coalesce("n", F.lit(0))
    return every.join(found, ["k", "bin"], "left").select("k", "bin", n.alias("n"), rounded(n / F.nullif(F.col("dual"), F.lit(0))).alias("of_dual"), rounded(n / F.col("cells")).alias("of_level"))


def range_bins(cells: DataFrame) -> DataFrame:
    """Dual cells by the larger range to a radar, with medians of both."""
    far = F.greatest("r1", "r2") / 1000.0
    dual = F.col("vr1").isNotNull() & F.col("vr2").isNotNull()
    return cells.withColumn("bin", bin_of(far, RANGE_EDGES, False)).groupBy("bin").agg(F.count("*").alias("cells"), F.count_if(dual).alias("dual"), rounded(F.percentile(F.when(dual, F.col("angle")), F.lit(0.5)), 5).alias("median_angle"), rounded(F.percentile(F.when(dual, far), F.lit(0.5)), 5).alias("median_km"))


def residual_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, root mean square, and percentiles of the absolute value."""
    x = F.col(value)
    p = lambda q: rounded(F.percentile(F.abs(x), F.lit(q)), 5)
    return rows.filter(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), rounded(F.avg(x), 5).alias("mean"), rounded(F.sqrt(F.avg(x * x)), 5).alias("rms"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), rounded(F.max(F.abs(x))).alias("largest"))


def quality_gate(cells: DataFrame, w: str, residual: str) -> DataFrame:
    """Whether vertical speed and continuity stay within their limits where both radars observe."""
    g = cells.filter("valid").agg(rounded(F.percentile(F.abs(F.col(w)), F.lit(0.99)), 5).alias("w_p99"), rounded(F.percentile(F.abs(F.col(residual)), F.lit(0.95)), 5).alias("residual_p95"))
    return g.withColumn("ok", (F.col("w_p99") <= W_P99) & (F.coalesce("residual_p95", F.lit(0.0)) <= RESIDUAL_P95))


def window_masks(field: DataFrame, lengths: tuple[int, ...] = (3, 4, 5), times: int = 6) -> DataFrame:
    """Cells observed at all times and at some time of each window of successive volumes."""
    spans = field.sparkSession.createDataFrame([(n, s) for n in lengths for s in range(times - n + 1)], "length int, start int")
    joined = field.join(F.broadcast(spans), (field["t"] >= F.col("start")) & (field["t"] < F.col("start") + F.col("length")))
    cells = joined.groupBy("length", "start", "j", "i").agg(F.count("v").alias("n"))
    return cells.groupBy("length", "start").agg(F.count_if(F.col("n") == F.col("length")).alias("everywhen"), F.count_if(F.col("n") > 0).alias("somewhen"), rounded(F.count_if(F.col("n") == F.col("length")) / F.nullif(F.count_if(F.col("n") > 0), F.lit(0))).alias("share"))


def window_levels(seen: DataFrame, first: int, last: int, cells: int, lengths: tuple[int, ...] = (3, 4, 5), by: tuple[str, ...] = ("k",), cell: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """``length, start, by, union, intersection, of_union, of_level`` of windows of successive volumes ``first`` to ``last``.

    ``seen`` has a row (t, by, cell) wherever something was observed; repeated
    rows count once. ``by`` are the columns that results are told apart by: level,
    radar, case. ``cells`` is the number of cells of one such part, observed or
    not. A part that a window doesn't see at all has no row. Rows move once, to
    their cell; windows are counted from there.
    """
    times = seen.filter(F.col("t").between(first, last)).groupBy(*by, *cell).agg(F.collect_set("t").alias("_ts"))

    def met(n: int) -> Column:
        """The windows of ``n`` volumes that have one of a cell's times, and whether they have all."""
        inside = lambda s: (s >= first) & (s <= last - n + 1)
        starts = F.array_distinct(F.flatten(F.transform("_ts", lambda t: F.filter(F.sequence(t - n + 1, t), inside))))
        held = lambda s: F.size(F.filter("_ts", lambda t: (t >= s) & (t < s + n)))
        return F.transform(starts, lambda s: F.struct(F.lit(n).alias("length"), s.alias("start"), (held(s) == n).alias("all")))

    each = times.select(*by, F.explode(F.concat(*[met(n) for n in lengths])).alias("w")).select(*by, "w.*")
    g = each.groupBy("length", "start", *by).agg(F.count("*").alias("union"), F.count_if("all").alias("intersection"))
    return g.withColumns({"of_union": rounded(F.col("intersection") / F.col("union")), "of_level": rounded(F.col("intersection") / cells)})


def norms(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Norm and root mean square of a difference, and its share of the reference's norm."""
    d = F.col(a) - F.col(b)
    ref = F.sqrt(F.sum(F.col(b) * F.col(b)))
    l2 = F.sqrt(F.sum(d * d))
    return pairs.filter(d.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), rounded(l2, 5).alias("l2"), rounded(F.sqrt(F.avg(d * d)), 5).alias("rmse"), rounded(F.coalesce(l2 / nonzero(ref), l2), 5).alias("relative"))


def harmonic_fit(gates: DataFrame, *keys: str, counted: bool = False) -> DataFrame:
    """Least squares of v = a sin(az) + b cos(az) + c from nine sums, solved by Cramer's rule; ``counted`` adds ``samples``."""
    s, c, v = F.sin(F.radians(F.col("azimuth"))), F.cos(F.radians(F.col("azimuth"))), F.col("v")
    sums = {"n": F.count("*").cast("double"), "ss": F.sum(s * s), "cc": F.sum(c * c), "sc": F.sum(s * c), "s": F.sum(s), "c": F.sum(c), "sv": F.sum(s * v), "cv": F.sum(c * v), "v": F.sum(v)}
    g = gates.filter("v IS NOT NULL").groupBy(*keys).agg(*[e.alias(f"_{k}") for k, e in sums.items()])
    m = [["ss", "sc", "s"], ["sc", "cc", "c"], ["s", "c", "n"]]
    rhs = ["sv", "cv", "v"]
    col = lambda k: F.col(f"_{k}")

    def det(rows: list[list[str]]) -> Column:
        (a, b, cc), (d, e, f), (gg, h, i) = [[col(x) for x in r] for r in rows]
        return a * (e * i - f * h) - b * (d * i - f * gg) + cc * (d * h - e * gg)

    whole = nonzero(det(m))
    solved = [det([[rhs[r] if k == n else m[r][k] for k in range(3)] for r in range(3)]) / whole for n in range(3)]
    return g.select(*keys, *[rounded(e, 5).alias(n) for e, n in zip(solved, ("east", "north", "mean"), strict=True)], *([F.col("_n").cast("long").alias("samples")] if counted else []))


def fit_against_profile(gates: DataFrame, profile: DataFrame, below: float = 150.0, above: float = 200.0, most: float = 15.0) -> DataFrame:
    """The harmonic fit of each station's gates around the lowest valid level of its wind profile, and whether both blow the same way.

    ``gates`` have station, azimuth, height_m and v; ``profile`` has station,
    height_m, speed and direction (degrees it comes from), valid where speed is
    above 0. They agree if the fit's dot product with the profile's wind is
    positive and their directions differ by less than ``most`` degrees. A station
    without a valid level or without gates in the band has no row; one whose gates
    don't determine a fit has nulls and doesn't agree.
    """
    lowest = profile.filter("speed > 0 AND NOT isnan(speed)").groupBy("station").agg(F.min(F.struct("height_m", "speed", "direction")).alias("_p"))
    band = gates.join(lowest, "station").filter(F.col("height_m").between(F.col("_p.height_m") - below, F.col("_p.height_m") + above))
    fit = harmonic_fit(band.select("station", "azimuth", "v"), "station", counted=True).join(lowest, "station")
    from_deg, speed = F.radians("_p.direction"), F.col("_p.speed")
    toward, expected = azimuth(F.col("east"), F.col("north")), F.pmod(F.col("_p.direction") + 180.0, F.lit(360.0))
    dot = -speed * (F.col("east") * F.sin(from_deg) + F.col("north") * F.cos(from_deg))
    out = fit.select("station", "samples", "mean", rounded(toward, 4).alias("toward"), rounded(expected, 4).alias("profile_toward"), rounded(dot, 4).alias("dot"))
    apart = rounded(wrapped(F.col("toward"), F.col("profile_toward")), 4)
    return out.withColumns({"apart": apart, "agrees": F.coalesce((F.col("dot") > 0) & (apart < most), F.lit(False))})


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
