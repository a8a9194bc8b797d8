"""Unfolding of radial velocities by regions.

A sweep falls into regions of touching gates whose velocities lie in one part of
the Nyquist interval. Where two regions meet, gates face each other; their
number and the sum of their jumps make an edge. The strongest edge joins its two
regions first, by the whole number of intervals that takes its mean jump back;
edges that then lead to the same region are added up, until none is left.

Windows and sums find what faces what, for all gates of all sweeps; only runs
of gates along a ray and the edges between runs, both added up, come together a
sweep at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyshear.operators.stencil import cases

#: Parts of the Nyquist interval that tell regions apart; gates and rays that an edge may reach over.
SPLITS, SKIP = 3, 100


def faced(gates: DataFrame, nyquist: Column, splits: int) -> DataFrame:
    """Valid gates with their ``run`` (of touching gates of one ray in one part of the interval) and what they face next along the ray and at the next ray, which wraps."""
    by = [*cases(gates), "radar", "sweep"]
    part = F.greatest(F.lit(0), F.least(F.lit(splits - 1), F.floor((F.col("vr") + F.col("nyq")) * splits / (2 * F.col("nyq"))).cast("int")))
    out = gates.select(*by, "ray", "gate", "vr", nyquist.alias("nyq")).filter(F.col("vr").isNotNull() & ~F.isnan("vr")).withColumn("part", part)
    island = F.col("gate") - F.row_number().over(Window.partitionBy(*by, "ray", "part").orderBy("gate"))
    out = out.withColumn("island", island).withColumn("run", F.shiftleft(F.col("ray").cast("long"), 32) + F.min("gate").over(Window.partitionBy(*by, "ray", "part", "island")))
    place = F.struct("ray", "gate", "vr", "part", "run")
    along = Window.partitionBy(*by, "ray").orderBy("gate")
    around = Window.partitionBy(*by, "gate").orderBy("ray")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.select(*by, "ray", "gate", "vr", "nyq", "part", "run", F.lead(place).over(along).alias("beyond"), F.coalesce(F.lead(place).over(around), F.first(place).over(whole)).alias("beside"))


def fold_numbers(rows: pd.DataFrame, nyquist: float) -> pd.DataFrame:
    """``run, fold`` of one sweep from its runs (a = b, ``count`` gates) and the edges between them (``joined``: one region; ``jump``: the sum of differences)."""
    runs = rows.loc[rows["a"] == rows["b"], ["a", "count"]].groupby("a", sort=True)["count"].sum()
    index = {run: n for n, run in enumerate(runs.index)}
    root = list(range(len(index)))

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    edges = rows[rows["a"] != rows["b"]]
    for a, b in edges.loc[edges["joined"], ["a", "b"]].itertuples(index=False):
        x, y = find(index[a]), find(index[b])
        root[max(x, y)] = min(x, y)
    region = [find(n) for n in range(len(root))]
    size: dict[int, int] = {}
    for n, count in zip(region, runs, strict=True):
        size[n] = size.get(n, 0) + int(count)
    near: dict[int, dict[int, list[float]]] = {n: {} for n in size}
    for a, b, count, jump in edges[["a", "b", "count", "jump"]].itertuples(index=False):
        x, y = region[index[a]], region[index[b]]
        if x != y:
            for p, q, d in ((x, y, jump), (y, x, -jump)):
                e = near[p].setdefault(q, [0, 0.0])
                e[0], e[1] = e[0] + int(count), e[1] + float(d)
    fold, members = dict.fromkeys(size, 0), {n: [n] for n in size}
    heap = [(-e[0], p, q) for p in near for q, e in near[p].items() if p < q]
    heapq.heapify(heap)
    while heap:
        count, a, b = heapq.heappop(heap)
        if a not in near or near[a].get(b, [0])[0] != -count:
            continue  # it was joined or grew meanwhile
        if (size[b], -b) > (size[a], -a):
            a, b = b, a
        back = int(np.floor(near[a][b][1] / near[a][b][0] / (2 * nyquist) + 0.5))
        for n in members[b]:
            fold[n] -= back
        members[a] += members.pop(b)
        size[a] += size.pop(b)
        for c, (n, jump) in near.pop(b).items():
            del near[c][b]
            if c == a:
                continue
            e = near[a].setdefault(c, [0, 0.0])
            e[0], e[1] = e[0] + n, e[1] + jump + back * 2 * nyquist * n
            near[c][a] = [e[0], -e[1]]
            heapq.heappush(heap, (-e[0], min(a, c), max(a, c)))
    found = np.array([fold[n] for n in region], np.int64)
    gates = runs.to_numpy()
    middle = int(np.floor((found * gates).sum() / max(gates.sum(), 1) + 0.5))
    return pd.DataFrame({"run": runs.index.astype("int64"), "fold": (found - middle).astype("int32")})


def by_regions(gates: DataFrame, nyquist: float | Column, *, splits: int = SPLITS, skip: int = SKIP) -> DataFrame:
    """``gates`` (case columns, radar, sweep, ray, gate, vr) with ``unfolded``; a gate without a velocity has none.

    ``nyquist`` is a number or a column, equal for all gates of a sweep. The last
    ray of a sweep is next to the first. Regions that nothing within ``skip``
    gates or rays leads to keep their velocities. Each sweep is centred: the mean
    of its fold numbers, weighted by gates, rounds to 0. Jumps are summed in whole
    millionths, so results don't depend on the order or number of partitions.
    """
    limit = nyquist if isinstance(nyquist, Column) else F.lit(float(nyquist))
    by = [*cases(gates), "radar", "sweep"]
    seen = faced(gates, limit, splits)
    rays = F.max("ray").over(Window.partitionBy(*by)) + 1
    seen = seen.withColumn("rays", rays)
    ahead = F.struct(F.col("beyond").alias("to"), (F.col("beyond.gate") - F.col("gate")).alias("gap"))
    across = F.struct(F.col("beside").alias("to"), F.when(F.col("beside.ray") > F.col("ray"), F.col("beside.ray") - F.col("ray")).otherwise(F.col("beside.ray") + F.col("rays") - F.col("ray")).alias("gap"))
    own = F.struct(F.struct("ray", "gate", "vr", "part", "run").alias("to"), F.lit(0).cast("int").alias("gap"))
    pairs = seen.select(*by, "nyq", F.col("run").alias("a"), "vr", "part", F.explode(F.array(own, ahead, across)).alias("p"))
    pairs = pairs.filter(F.col("p.to").isNotNull() & (F.col("p.gap") <= skip) & ((F.col("p.gap") == 0) | (F.col("a") != F.col("p.to.run"))))
    jump = F.round(F.col("p.to.vr") - F.col("vr"), 6).cast("decimal(20,6)")
    edges = pairs.groupBy(*by, "a", F.col("p.to.run").alias("b")).agg(
        F.max("nyq").alias("nyq"), F.count("*").alias("count"), F.sum(jump).cast("double").alias("jump"), F.max((F.col("p.gap") == 1) & (F.col("part") == F.col("p.to.part"))).alias("joined"),
    )

    def sweep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = fold_numbers(rows.sort_values(["a", "b"]), float(rows["nyq"].max()))
        for n, name in enumerate(by):
            out.insert(n, name, key[n])
        return out

    kinds = ", ".join(f"{c} {gates.schema[c].dataType.simpleString()}" for c in by)
    folds = edges.groupBy(*by).applyInPandas(sweep, f"{kinds}, run long, fold int")
    found = seen.select(*by, "ray", "gate", "run", "nyq").join(folds, [*by, "run"]).select(*by, "ray", "gate", (F.col("fold") * 2 * F.col("nyq")).alias("_shift"))
    joined = gates.join(found, [*by, "ray", "gate"], "left")
    return joined.select(*[joined[c] for c in gates.columns], (F.when(~F.isnan("vr"), F.col("vr")) + F.col("_shift")).alias("unfolded"))
