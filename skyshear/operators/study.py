"""The low-rank study: windows of volumes, two frames, two domains, five rank rules; and what of a rotation an estimate keeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyshear.functions.geo import nonzero
from skyshear.operators import grid, kernels, stencil

#: Lengths of the windows.
LENGTHS = (3, 4, 5)
#: Shares of the horizontal ranks, and the rank in time (0: all), by rule.
RULES = {"aggressive_temporal": (0.125, 1), "compact_temporal": (0.25, 2), "moderate_temporal": (0.5, 3), "compact_rt_full": (0.25, 0), "moderate_rt_full": (0.5, 0)}


def windows(field: DataFrame, volumes: int) -> DataFrame:
    """``field`` (t, j, i, v) once for each window (length, start) that holds its volume, ``s`` its place there."""
    spans = [(n, a) for n in LENGTHS for a in range(volumes - n + 1)]
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.lit(a).alias("start")) for n, a in spans]))
    out = field.withColumn("w", of).filter((F.col("t") >= F.col("w.start")) & (F.col("t") < F.col("w.start") + F.col("w.length")))
    return out.select("w.length", "w.start", (F.col("t") - F.col("w.start")).alias("s"), "j", "i", "v")


def frames(field: DataFrame, motion: tuple[float, float], volumes: int, ny: int, nx: int) -> DataFrame:
    """Every window as it stands (eulerian) and moved back along ``motion`` cells a volume to the window's first (storm_relative)."""
    still = windows(field, volumes)
    shifts = field.sparkSession.range(max(LENGTHS)).select(F.col("id").cast("int").alias("s"), (-motion[0] * F.col("id")).alias("dx"), (-motion[1] * F.col("id")).alias("dy"))
    window = still.select("length", "start", "s").distinct().join(F.broadcast(shifts), "s")
    moved = grid.translate_by(still, window, ["length", "start", "s"], ny, nx)
    return still.withColumn("frame", F.lit("eulerian")).unionByName(moved.withColumn("frame", F.lit("storm_relative")))


def rank_study(field: DataFrame, motion: tuple[float, float], volumes: int, ny: int, nx: int) -> DataFrame:
    """Error, compression and speed kept of each window, frame, domain and rule: one fit a group, spread over tasks.

    The domain ``common`` holds cells that all volumes of a window have and fits
    their bounding box; ``any`` fills cells that some lack, again and again.
    """
    rows = frames(field, motion, volumes, ny, nx)
    both = rows.withColumn("domain", F.explode(F.array(F.lit("common"), F.lit("any"))))
    every = both.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in RULES])))

    def fit(key: tuple, case: pd.DataFrame) -> pd.DataFrame:
        length, start, frame, domain, rule = key
        x = np.full((ny, nx, length), np.nan)
        x[case["j"], case["i"], case["s"]] = case["v"]
        if domain == "common":
            whole = ~np.isnan(x).any(axis=2)
            x = np.where(whole[:, :, None], x, np.nan)
        if np.isnan(x).all():
            return pd.DataFrame([(*key, 0, None, None, None, None)], columns=[*STUDY])
        known = ~np.isnan(x)
        js, is_ = np.flatnonzero(known.any(axis=(1, 2))), np.flatnonzero(known.any(axis=(0, 2)))
        x, known = (a[js[0] : js[-1] + 1, is_[0] : is_[-1] + 1] for a in (x, known))
        share, rt = RULES[rule]
        part = lambda n: min(n, max(1 if n == 1 else 2, int(np.ceil(share * n))))
        ranks = (part(x.shape[0]), part(x.shape[1]), min(length, rt) if rt else length)
        filled = np.where(known, x, x[known].mean())
        for _ in range(0 if known.all() else 12):
            filled = np.where(known, x, kernels.rebuilt(*kernels.hosvd(filled, ranks)))
        core, factors = kernels.hosvd(filled, ranks)
        got, true = kernels.rebuilt(core, factors)[known], x[known]
        norm, spread = float(np.sqrt((true**2).sum())), float(true.max() - true.min())
        gap = float(np.sqrt(((got - true) ** 2).sum()))
        size = core.size + sum(f.size for f in factors)
        top = float(np.abs(true).max())
        return pd.DataFrame([(*key, int(known.sum()), round(gap / norm if norm else gap, 5), round(gap / np.sqrt(known.sum()) / spread, 5) if spread else None, round(known.size / size, 4), round(float(np.abs(got).max()) / top, 5) if top else None)], columns=[*STUDY])

    return every.groupBy("length", "start", "frame", "domain", "rule").applyInPandas(fit, ", ".join(f"{k} {v}" for k, v in STUDY.items()))


STUDY = {"length": "int", "start": "int", "frame": "string", "domain": "string", "rule": "string", "cells": "long", "error": "double", "nrmse": "double", "compression": "double", "speed_kept": "double"}


def vortex_kept(cells: DataFrame, dx: float, dy: float, dz: float, near: float = 30_000.0, high: float = 3000.0, circle: float = 15_000.0) -> DataFrame:
    """How much of a field's strongest rotation an estimate keeps, in one row.

    ``cells``: k, j, i, x, y, z, valid, u, v and the estimate's eu, ev. The
    estimate's peak is looked for within ``near`` and ``high`` of the field's;
    circulations are of the peak's level within ``circle``, depths of levels
    whose peak in the circle is a quarter of the field's. Ties go to the first
    cell by level, row and column.
    """
    ref = stencil.divergence_vorticity(cells, dx, dy).select("k", "j", "i", "x", "y", "z", "valid", "eu", "ev", F.col("vorticity").alias("zeta"))
    both = stencil.divergence_vorticity(ref.withColumnsRenamed({"eu": "u", "ev": "v"}), dx, dy).withColumnRenamed("vorticity", "ezeta")
    both = both.select("k", "j", "i", "x", "y", "z", "valid", "zeta", "ezeta")
    first = lambda value: F.struct(-F.col(value), "k", "j", "i")
    peak = both.filter("zeta IS NOT NULL").agg(F.min_by(F.struct("zeta", "k", "x", "y", "z"), first("zeta")).alias("p")).select(*[F.col(f"p.{c}").alias(f"p{c}") for c in ("zeta", "k", "x", "y", "z")])
    at = both.join(F.broadcast(peak), F.lit(True)).withColumn("d", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2))  # one row, the peak
    inside, level = F.col("d") <= circle, F.col("k") == F.col("pk")
    local = at.filter(F.col("valid") & (F.col("d") <= near) & (F.abs(F.col("z") - F.col("pz")) <= high) & F.col("ezeta").isNotNull())
    found = local.agg(F.min_by(F.struct("ezeta", F.sqrt(F.col("d") ** 2 + (F.col("z") - F.col("pz")) ** 2).alias("shift")), first("ezeta")).alias("e"))
    area = dx * dy
    total = lambda c: F.coalesce(F.sum(F.when(inside & level & F.col("valid"), c)), F.lit(0.0)) * area
    sums = at.agg(F.first("pzeta").alias("zeta"), total(F.col("zeta")).alias("circulation"), total(F.col("ezeta")).alias("circulation_est"), total(F.greatest("zeta", F.lit(0.0))).alias("cyclonic"), total(F.greatest("ezeta", F.lit(0.0))).alias("cyclonic_est"), (F.count_if(inside & level & F.col("valid")) / nonzero(F.count_if(inside & level).cast("double"))).alias("coverage"))
    tops = at.filter(inside & F.col("valid")).groupBy("k").agg(F.max("zeta").alias("a"), F.max("ezeta").alias("b"), F.first("pzeta").alias("p"))
    deep = lambda c: stencil.longest_run(tops.withColumn("one", F.lit(1)), F.col(c) >= 0.25 * F.col("p"), ["one"], "k").agg((F.coalesce(F.max("longest"), F.lit(0)) * dz).alias(f"depth_{c}"))
    row = sums.join(found.select("e.*"), F.lit(True)).join(deep("a"), F.lit(True)).join(deep("b"), F.lit(True))  # of one row each
    kept = lambda a, b: (F.col(a) / nonzero(F.col(b)))
    return row.select("zeta", F.col("ezeta").alias("zeta_est"), kept("ezeta", "zeta").alias("zeta_kept"), "circulation", "circulation_est", kept("circulation_est", "circulation").alias("circulation_kept"), "cyclonic", "cyclonic_est", kept("cyclonic_est", "cyclonic").alias("cyclonic_kept"), "coverage", "shift", F.col("depth_a").alias("depth"), F.col("depth_b").alias("depth_est"), kept("depth_b", "depth_a").alias("depth_kept"))
