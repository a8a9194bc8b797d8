"""Time matching between two radars, and nearest products.

A time's nearest of the other radar is the last one before it or the first one
after it, so both sides are put in one order and two window functions find both:
one shuffle and two candidates a row, however many times lie within the
tolerance. Pairs of all times use an equi-join on buckets as wide as the
tolerance. Nothing is a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances that a stretch of time is long; each is one group of a window.
STRETCH = 64


def near_pairs(left: DataFrame, right: DataFrame, tolerance: int, a: str = "t1", b: str = "t2") -> DataFrame:
    """All pairs of times (seconds) at most ``tolerance`` apart, with ``diff``."""
    probe = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(a) / tolerance) + d for d in (-1, 0, 1)])))
    build = right.withColumn("_b", F.floor(F.col(b) / tolerance))
    return probe.join(build, "_b").drop("_b").withColumn("diff", F.abs(F.col(a) - F.col(b))).filter(F.col("diff") <= tolerance)


def nearest_times(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """``t1, t2, diff`` of each t1 with a t2 within ``tolerance``: the nearest, of two the earlier.

    Time is cut into stretches; a t2 near a border stands in both.
    """
    width = STRETCH * max(1, tolerance)
    at = lambda c: F.floor(c / width)
    near = F.array_distinct(F.array(at(F.col("t2") - tolerance), at(F.col("t2") + tolerance)))
    rows = left.select(at(F.col("t1")).alias("_b"), F.col("t1").alias("t"), F.lit(None).cast("long").alias("other")).unionByName(right.select(F.explode(near).alias("_b"), F.col("t2").alias("t"), F.col("t2").alias("other")))
    # running frames in either direction; of equal times the other radar's comes first
    so_far = lambda *order: F.last("other", ignorenulls=True).over(Window.partitionBy("_b").orderBy(*order, F.col("other").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    within = lambda c: F.when(F.abs(F.col("t") - c) <= tolerance, c)
    found = rows.withColumn("before", within(so_far("t"))).withColumn("after", within(so_far(F.col("t").desc()))).filter("other IS NULL AND (before IS NOT NULL OR after IS NOT NULL)")
    pick = F.when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    return found.select(F.col("t").alias("t1"), pick.alias("t2")).distinct().withColumn("diff", F.abs(F.col("t1") - F.col("t2")))


def match_times(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """``t1, t2, diff``: each t1's nearest t2 (ties: the earlier) within ``tolerance``; of several t1 with one t2 the first claims it and the others stay alone."""
    best = nearest_times(left, right, tolerance)
    return best.groupBy("t2").agg(F.min(F.struct("t1", "diff")).alias("m")).select(F.col("m.t1").alias("t1"), "t2", F.col("m.diff").alias("diff"))


def best_pair(matches: DataFrame) -> DataFrame:
    return matches.orderBy("diff", "t1").limit(1)


def nearest_within(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Nearest t2 of each t1 within ``tolerance``, null if none; a t2 may serve many."""
    return left.join(nearest_times(left, right, tolerance), "t1", "left").select("t1", "t2", "diff")


def tolerance_sweep(left: DataFrame, right: DataFrame, minutes: tuple[int, ...]) -> DataFrame:
    """Matches under each tolerance: a time's nearest is the same under all that it is within."""
    best = nearest_times(left, right, 60 * max(minutes)).groupBy("t2").agg(F.min("diff").alias("diff"))
    each = best.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes]))).filter(F.col("diff") <= 60 * F.col("minutes"))
    return each.groupBy("minutes").agg(F.count("*").alias("matches"))


def intervals(times: DataFrame) -> DataFrame:
    """Least and largest gap between a station's successive times."""
    gap = F.col("sec") - F.lag("sec").over(Window.partitionBy("station").orderBy("sec"))
    return times.withColumn("gap", gap).groupBy("station").agg(F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.count("*").alias("scans"))


def volume_pairs(times: DataFrame) -> DataFrame:
    """Successive volumes: time between and midpoint."""
    w = Window.partitionBy("station").orderBy("sec")
    return times.withColumn("next", F.lead("sec").over(w)).filter("next IS NOT NULL").select("station", "sec", "next", (F.col("next") - F.col("sec")).alias("seconds"), ((F.col("sec") + F.col("next")) / 2).alias("midpoint"))


def choose_profile(profiles: DataFrame, least: int = 3) -> DataFrame:
    """The station with most valid levels, the first on ties, if it has enough."""
    n = profiles.groupBy("station").agg(F.count_if("valid").alias("levels"))
    return n.filter(F.col("levels") >= least).orderBy(F.col("levels").desc(), "station").limit(1)
