"""What radars measured around places: gates in polar space, and why a place has no wind.

Sweeps and gates meet places by equality: a radar's sweeps are one short list,
and gates stand in buckets of azimuth and range as wide as the reach, of which a
place asks its own and those beside it. Azimuth buckets wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.model import RADARS
from skyshear.operators import stencil


def seen_from(places: DataFrame, radars: tuple = RADARS) -> DataFrame:
    """``places`` (x, y, z in m) once for each radar: ``radar`` (from 1), ``azimuth`` and ``elevation`` (degrees), ``range_m``."""
    views = []
    for n, (x, y, z) in enumerate(radars, 1):
        e, o, u = F.col("x") - x, F.col("y") - y, F.col("z") - z
        flat = F.sqrt(e * e + o * o)
        views.append(F.struct(F.lit(n).alias("radar"), geo.rounded(geo.azimuth(e, o)).alias("azimuth"), geo.rounded(F.degrees(F.atan2(u, flat))).alias("elevation"), geo.rounded(F.sqrt(e * e + o * o + u * u)).alias("range_m")))
    return places.withColumn("_v", F.explode(F.array(*views))).select(*places.columns, "_v.*")


def support(places: DataFrame, gates: DataFrame, radars: tuple = RADARS, degrees: float = 1.5, reach: float = 2000.0, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Gates of each radar around each place, in the sweep of the nearest elevation.

    ``places`` have ``keys`` (one row each) and x, y, z in m; ``gates`` have
    radar, sweep, elevation, azimuth, range_m and value, null where it is masked.
    Both may have the columns that tell cases apart. A gate counts if its azimuth
    is at most ``degrees`` and its range at most ``reach`` away. For each radar n
    the result has ``sweep<n>``, ``elevation<n>``, ``offset<n>`` (degrees from the
    place's elevation), ``samples<n>``, ``valid<n>`` and ``in_range<n>``: the place
    is no farther than the farthest gate and ``reach``. Of two sweeps as near the
    first counts. A radar without gates has no sweep, no samples and is out of
    range; so is every radar of a place with a null coordinate or a null case.
    """
    own = stencil.cases(places)
    on = [*own, "radar"]
    sweeps = gates.groupBy(*on, "sweep").agg(F.min("elevation").alias("elevation"), F.max("range_m").alias("far"))
    sweeps = sweeps.groupBy(*on).agg(F.collect_list(F.struct("sweep", "elevation")).alias("_sweeps"), F.max("far").alias("_far"))
    asked = seen_from(places.select(*own, *keys, "x", "y", "z"), radars).join(sweeps, on, "left")
    off = lambda s: F.struct(F.round(F.abs(s["elevation"] - F.col("elevation")), 6).alias("off"), s["sweep"].alias("sweep"), s["elevation"].alias("elevation"))
    asked = asked.withColumn("_near", F.when(F.col("elevation").isNotNull(), F.array_min(F.transform("_sweeps", off)))).withColumn("sweep", F.col("_near.sweep"))
    around = max(1, int(360 / degrees))
    pie, ring = lambda c: F.floor(c * around / 360), lambda c: F.floor(c / reach)
    beside = lambda c: F.array(*[c + d for d in (-1, 0, 1)])
    pies = F.array_distinct(F.transform(beside(pie(F.col("azimuth"))), lambda p: F.pmod(p, F.lit(around))))
    asked = asked.withColumn("_pie", F.explode(pies)).withColumn("_ring", F.explode(beside(ring(F.col("range_m")))))
    held = gates.select(*on, "sweep", F.pmod(pie(F.col("azimuth")), F.lit(around)).alias("_pie"), ring(F.col("range_m")).alias("_ring"), F.col("azimuth").alias("_a"), F.col("range_m").alias("_r"), "value")
    near = (F.round(geo.wrapped(F.col("h._a"), F.col("a.azimuth")), 6) <= degrees) & (F.round(F.abs(F.col("h._r") - F.col("a.range_m")), 6) <= reach)
    for c in (*on, "sweep", "_pie", "_ring"):
        near = near & (F.col(f"a.{c}") == F.col(f"h.{c}"))
    met = asked.alias("a").join(held.alias("h"), near, "left").select("a.*", "h._a", "h.value")
    out = []
    for n in range(1, len(radars) + 1):
        mine = lambda c, n=n: F.when(F.col("radar") == n, c)
        out += [
            F.max(mine(F.col("sweep"))).alias(f"sweep{n}"), F.max(mine(F.col("_near.elevation"))).alias(f"elevation{n}"), F.max(mine(F.col("_near.off"))).alias(f"offset{n}"),
            F.count(mine(F.col("_a"))).alias(f"samples{n}"), F.count(mine(F.col("value"))).alias(f"valid{n}"),
            F.coalesce(F.max(mine(F.col("range_m") <= F.col("_far") + reach)), F.lit(False)).alias(f"in_range{n}"),
        ]
    return met.groupBy(*own, *keys).agg(*out)


def why(seen1: Column, seen2: Column, angle_ok: Column, downstream_ok: Column) -> Column:
    """Why a place with ``support`` has a wind or none: the first rule that applies, of twelve (three of the first by the radars' names)."""
    lost = lambda n: F.when(~F.col(f"in_range{n}"), f"radar {n} out of range").when(F.col(f"valid{n}") == 0, f"radar {n} has no valid gate nearby").otherwise(f"radar {n} has gates nearby but no value")
    neither = (
        F.when(~F.col("in_range1") & ~F.col("in_range2"), "out of both ranges").when(~F.col("in_range1"), "out of range of radar 1").when(~F.col("in_range2"), "out of range of radar 2")
        .when((F.col("valid1") == 0) & (F.col("valid2") == 0), "no valid gate nearby").otherwise("gates nearby but no value")
    )
    return F.when(~seen1 & ~seen2, neither).when(~seen2, lost(2)).when(~seen1, lost(1)).when(~angle_ok, "angle").when(~downstream_ok, "downstream").otherwise("accepted")
