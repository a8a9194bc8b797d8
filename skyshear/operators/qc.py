"""Quality control of a volume: despeckling, unfolding, limits, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyshear.operators import scan, stencil, unfold

GATE = ["radar", "sweep", "ray", "gate"]
#: Names of velocity that is still folded; a corrected one is never unfolded again.
FOLDED = ("VEL", "V", "VELOCITY")


def keys(gates: DataFrame) -> list[str]:
    """What tells gates of one table apart: its case, radar, sweep, ray and gate."""
    return [*stencil.cases(gates), *GATE]


def despeckle(gates: DataFrame, value: str = "vr") -> DataFrame:
    """``value`` replaced by its 3 x 3 median; a gate without a value, or with one missing around it, has none."""
    smooth = stencil.median3(gates.select(*keys(gates), value), value).withColumnRenamed("median", "_median")
    return gates.join(smooth, keys(gates)).withColumn(value, F.when(F.col(value).isNotNull(), F.col("_median"))).drop("_median")


def control(gates: DataFrame, quantity: str = "V", nyquist: float = 30.0, corrected: bool = False) -> DataFrame:
    """``gates`` (radar, sweep, ray, gate, vr, dbz) despeckled, unfolded if the quantity is a folded velocity, and within limits."""
    out = despeckle(gates)
    if quantity.upper() in FOLDED and not corrected:
        out = unfold.by_regions(out, nyquist).withColumn("vr", F.col("unfolded")).drop("unfolded")
    return scan.without_extremes(out)
