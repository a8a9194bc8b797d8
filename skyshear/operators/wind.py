"""Beams, dual-Doppler synthesis and the observation operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.model import DX, DY, MIN_ANGLE, RADARS
from skyshear.operators import stencil
from skyshear.sources.store import stored


def beams(cells: DataFrame, radars: tuple = RADARS) -> DataFrame:
    """Adds both radars' unit vectors, ranges and the crossing angle (rounded, so thresholds split alike everywhere)."""
    out = cells
    for n, radar in enumerate(radars, 1):
        bx, by, bz, r = geo.unit_to(F.col("x"), F.col("y"), F.col("z"), radar)
        out = out.withColumns({f"bx{n}": bx, f"by{n}": by, f"bz{n}": bz, f"r{n}": r})
    angle = geo.crossing_angle(F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"))
    return out.withColumn("angle", geo.rounded(angle))


def dual(cells: DataFrame, least: float = MIN_ANGLE) -> Column:
    """Both radars observe the cell from directions at least ``least`` degrees apart."""
    return F.coalesce(F.col("vr1").isNotNull() & F.col("vr2").isNotNull() & (F.col("angle") >= least) & (F.col("r1") > 0) & (F.col("r2") > 0), F.lit(False))


def solve_uv(w: Column) -> tuple[Column, Column]:
    """u and v of a cell from both radial velocities and a vertical speed, by Cramer's rule."""
    a, b = F.col("vr1") - F.col("bz1") * w, F.col("vr2") - F.col("bz2") * w
    det = geo.nonzero(F.col("bx1") * F.col("by2") - F.col("bx2") * F.col("by1"))
    return (F.col("by2") * a - F.col("by1") * b) / det, (F.col("bx1") * b - F.col("bx2") * a) / det


def synthesise(cells: DataFrame, w: Column | None = None, least: float = MIN_ANGLE) -> DataFrame:
    """``cells`` with beams, ``valid`` and, where valid, u and v."""
    return solved(beams(cells), w, least)


def solved(out: DataFrame, w: Column | None = None, least: float = MIN_ANGLE) -> DataFrame:
    """Cells that have their beams with ``valid`` and, where valid, u and v."""
    out = out.withColumn("valid", dual(out, least))
    u, v = solve_uv(F.lit(0.0) if w is None else w)
    return out.withColumn("u", F.when(F.col("valid"), u)).withColumn("v", F.when(F.col("valid"), v))


def radial(u: Column, v: Column, w: Column, n: int, fall: Column | None = None) -> Column:
    """Radial velocity that radar ``n`` sees; precipitation falls at ``fall``."""
    return F.col(f"bx{n}") * u + F.col(f"by{n}") * v + F.col(f"bz{n}") * (w if fall is None else w - F.abs(fall))


def forward(cells: DataFrame) -> DataFrame:
    """H: both radial velocities of a wind field; zero where a radar doesn't observe."""
    u, v, w = (F.coalesce(F.col(c), F.lit(0.0)) for c in "uvw")
    return cells.withColumns({f"h{n}": F.when(F.col(f"vr{n}").isNotNull(), radial(u, v, w, n)).otherwise(0.0) for n in (1, 2)})


def sound(weight: Column) -> Column:
    """``weight``, or an error where it is negative or not finite."""
    bad = weight.isNull() | F.isnan(weight) | (weight < 0) | (weight == float("inf"))
    return F.when(bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(weight)


def weighted_forward(cells: DataFrame, weights: tuple[Column, Column]) -> DataFrame:
    """The roots of ``weights`` times H, whose transpose is the weighted adjoint."""
    return forward(cells).withColumns({f"h{n}": F.sqrt(sound(weights[n - 1])) * F.col(f"h{n}") for n in (1, 2)})


def adjoint(cells: DataFrame, weights: tuple[Column, Column] | None = None) -> DataFrame:
    """H*, weighted by the roots of ``weights`` if given: what both radars' values say about u, v and w."""
    parts = {c: F.lit(0.0) for c in "uvw"}
    for n in (1, 2):
        d = F.coalesce(F.col(f"vr{n}"), F.lit(0.0)) * (F.lit(1.0) if weights is None else F.sqrt(sound(weights[n - 1])))
        for c, b in zip("uvw", "xyz", strict=True):
            parts[c] = parts[c] + F.col(f"b{b}{n}") * d
    return cells.withColumns({f"a{c}": e for c, e in parts.items()})


def retrieve(cells: DataFrame, dz: float, rounds: int = 5, least: float = MIN_ANGLE) -> DataFrame:
    """Dual-Doppler wind with vertical speed fed back: u and v from w, w from their divergence, a fixed number of rounds.

    Each round shuffles by rows, then by columns of one case, and is written to
    the shared folder, so the plan doesn't grow with ``rounds``.
    """
    out = beams(cells)
    out = out.withColumn("valid", dual(out, least)).withColumn("w", F.lit(0.0))
    out = stored(out.withColumn("is_top", F.col("k") == F.max("k").over(Window.partitionBy(*stencil.cases(out), "j", "i"))), "beams")
    for _ in range(rounds):
        u, v = solve_uv(F.col("w"))
        out = out.withColumn("u", F.when(F.col("valid"), u)).withColumn("v", F.when(F.col("valid"), v)).drop("w")
        out = stencil.divergence_vorticity(out, DX, DY).withColumn("div", F.col("divergence"))
        out = stencil.downward_integral(stored(out, "round"), dz, F.lit(0.0)).drop("joined", "island", "div", "divergence", "vorticity", "dudx", "dvdy", "dvdx", "dudy")
    return out
