"""From gates of two radars to the wind of a case: gridding, first guess, variational solution, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyshear.functions import geo
from skyshear.functions.geo import exact_sum, nonzero
from skyshear.model import DX, DY, DZ, MIN_ANGLE, RADARS
from skyshear.operators import grid, stencil, variational, wind
from skyshear.sources.store import stored

KEY = ["k", "j", "i"]
#: Radius of influence (m) of a gate in a retrieval, and of one in a display grid.
ROI, ROI_DISPLAY = 2000.0, 3000.0
#: Vertical speeds of a first guess stay within this (m/s).
W_LIMIT = 30.0


def place(gates: DataFrame, elevation: Column, gate_m: float, radars: tuple = RADARS) -> DataFrame:
    """``gates`` with gx, gy, gz (m, to the millimetre) in the grid's frame: azimuth from the ray, range from the gate's middle."""
    e, n, u = geo.cosines(F.col("ray").cast("double"), elevation)
    r = (F.col("gate") + 0.5) * gate_m
    origin = lambda axis: F.element_at(F.array(*[F.lit(x[axis]) for x in radars]), F.col("radar"))
    return gates.withColumns({f"g{a}": geo.rounded(origin(axis) + r * c, 3) for axis, (a, c) in enumerate(zip("xyz", (e, n, u), strict=True))})


def grid_volume(cells: DataFrame, gates: DataFrame, radius: float = ROI) -> DataFrame:
    """``radar, k, j, i, vr, dbz, n``: weighted means, weight (R2 - d2) / (R2 + d2), of each radar's gates within ``radius`` of a cell, in space.

    Gates of several volumes keep their case columns; cells without any serve
    every case, others the gates of their own.
    """
    by = list(stencil.cases(gates))
    shared = tuple(c for c in by if c in cells.columns)
    near = grid.near_join(cells.select(*shared, *KEY, "x", "y", "z"), gates.select(*by, "radar", "gx", "gy", "gz", "vr", "dbz"), ("x", "y", "z"), ("gx", "gy", "gz"), radius, shared)
    w = (radius * radius - F.col("d2")) / (radius * radius + F.col("d2"))
    mean = lambda c: (exact_sum(w * F.col(c)) / nonzero(exact_sum(F.when(F.col(c).isNotNull(), w)))).alias(c)
    return near.groupBy(*by, "radar", *KEY).agg(mean("vr"), mean("dbz"), F.count("vr").alias("n"))


def both_radars(cells: DataFrame, gridded: DataFrame) -> DataFrame:
    """Cells with what each radar gives them: vr1, vr2, dbz1, dbz2. Where gates have case columns, cells have them too."""
    by = list(stencil.cases(gridded))
    if missing := set(by) - set(cells.columns):
        raise ValueError(f"cells have no {', '.join(sorted(missing))}")
    of = lambda c, n: F.max(F.when(F.col("radar") == n, F.col(c))).alias(f"{c}{n}")
    wide = gridded.groupBy(*by, *KEY).agg(*[of(c, n) for c in ("vr", "dbz") for n in (1, 2)])
    return cells.select(*by, *KEY, "x", "y", "z").join(wide, [*by, *KEY], "left")


def direct_wind(cells: DataFrame, least: float = MIN_ANGLE) -> DataFrame:
    """``cells`` with ``direct`` and, there, u, v from both radars at rest and w from their divergence, downwards, within W_LIMIT."""
    s = wind.synthesise(cells, None, least)
    by = stencil.cases(s)
    out = stencil.divergence_vorticity(s, DX, DY).withColumn("div", F.col("divergence")).withColumn("is_top", F.col("k") == F.max("k").over(Window.partitionBy(*by, "j", "i")))
    out = stencil.downward_integral(out, DZ, F.lit(0.0))
    w = F.when(F.col("valid"), F.greatest(F.lit(-W_LIMIT), F.least(F.lit(W_LIMIT), F.col("w"))))
    return out.select(*by, *KEY, "x", "y", "z", "vr1", "vr2", F.col("valid").alias("direct"), "u", "v", w.alias("w"))


def initial_wind(cells: DataFrame, background: DataFrame | None, sigma: float = 2.0, least: float = MIN_ANGLE) -> DataFrame:
    """First guess u0, v0, w0 of ``cells`` (k, j, i, x, y, z, vr1, vr2) with a ``background`` (k, ub, vb) of each level, or of each case and level.

    Where both radars give a wind, its masked Gaussian mean (``sigma`` cells in all
    three directions, to four sigma) stands: the blend weight is 1 there. Elsewhere
    there is no increment, so the background stands, at rest in the vertical.
    Without a background the direct wind stays as it is, and nothing elsewhere.
    Several cases in one table don't mix.
    """
    found = direct_wind(cells, least)
    by = list(stencil.cases(found))
    keep = [*by, *KEY, "x", "y", "z", "vr1", "vr2", "direct"]
    if background is None:
        return found.select(*keep, *[F.coalesce(c, F.lit(0.0)).alias(f"{c}0") for c in "uvw"])
    means = grid.smoothed(found.select(*by, *KEY, "u", "v", "w"), ("u", "v", "w"), sigma, int(4 * sigma + 0.5))
    out = found.join(background, [*[c for c in by if c in background.columns], "k"]).join(means, [*by, *KEY])
    guess = lambda c, b: F.when(F.col("direct"), F.col(f"s_{c}")).otherwise(b).alias(f"{c}0")
    return out.select(*keep, guess("u", F.col("ub")), guess("v", F.col("vb")), guess("w", F.lit(0.0)))


def retrieve(cells: DataFrame, background: DataFrame | None, *, weights: tuple = variational.WEIGHTS, most: int = 150, tol: float = 1e-8, change: float = 0.0, filter_window: int | None = None, filter_order: int = 3, **tiles: int) -> DataFrame:
    """The variational wind of each case: u, v, w with masks, divergence, vorticity and the solver's record.

    ``change`` (m/s) ends a case once its wind moves by less; ``filter_window``
    and ``filter_order`` smooth the solution by local polynomials. ``wind_masked``:
    no radar sees the cell; ``diagnostics_masked``: not both do from directions
    that differ enough. ``iterations``, ``residual`` and ``moved`` tell how a case
    ended: at ``most`` iterations its residual may still be above ``tol``.
    ``task`` and ``tile`` say which cases are cut into tiles, and how.
    """
    guess, by = variational.with_case(wind.beams(initial_wind(cells, background)))
    guess = stored(guess, "first-guess")  # read by the count of cells, the solver and the masks
    given = guess.select(*by, *KEY, "z", *[f"b{a}{n}" for n in (1, 2) for a in "xyz"], "vr1", "vr2", "u0", "v0")
    solved = variational.wind_of(given, weights=weights, steps=(DX, DY, DZ), most=most, tol=tol, change=change, **tiles)
    if filter_window:
        solved = grid.low_pass(solved, ("u", "v", "w"), filter_window, filter_order)
    out = guess.select(*by, *KEY, "x", "y", "z", "vr1", "vr2", "angle", "r1", "r2").join(solved, [*by, *KEY]).withColumn("valid", F.lit(True))
    out = stencil.divergence_vorticity(out, DX, DY)
    seen = F.col("vr1").isNotNull() | F.col("vr2").isNotNull()
    named = list(stencil.cases(cells))
    return out.select(*named, *KEY, "u", "v", "w", "divergence", "vorticity", (~seen).alias("wind_masked"), (~wind.dual(out)).alias("diagnostics_masked"), "iterations", "residual", "moved")
