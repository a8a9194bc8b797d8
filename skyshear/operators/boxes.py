"""The largest box of valid cells, from runs of cells.

For every range of levels lo..hi, the columns (j, i) that are valid on all of it
come from each column's runs along k. In that common mask a cell's depth is the
length of its run along j up to it. A box whose last row is j and whose thinnest
column is i spans all neighbours in the row that are at least as deep, so each
row of depths gives its best box by itself, and rows spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a box, ends exclusive.
BOX = ["k0", "k1", "j0", "j1", "i0", "i1"]


def runs(cells: DataFrame, axis: str, *keys: str) -> DataFrame:
    """``cells`` with ``run``, the same number for cells that follow each other along ``axis``."""
    return cells.withColumn("run", F.col(axis) - F.row_number().over(Window.partitionBy(*keys).orderBy(axis)))


def spans(i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of a row (places ``i``, ascending): first and last place of its unbroken surroundings that are as deep."""
    wide = int(i[-1] - i[0]) + 1
    row = np.zeros(wide, depth.dtype)
    row[i - i[0]] = depth
    shallow = row[None, :] < depth[:, None]
    at, place = (i - i[0])[:, None], np.arange(wide)[None, :]
    left = np.where(shallow & (place < at), place, -1).max(axis=1) + 1
    right = np.where(shallow & (place > at), place, wide).min(axis=1) - 1
    return left + i[0], right + i[0]


def largest(cells: DataFrame) -> DataFrame:
    """``case, cells`` and the box (k0, k1, j0, j1, i0, i1; ends exclusive) of each case with a valid cell, from ``case, k, j, i, valid``.

    Of equals the first by levels, then by last row, last column and narrowest.
    """
    ok = cells.filter("valid").select("case", "k", "j", "i")
    columns = runs(ok, "k", "case", "j", "i").groupBy("case", "j", "i", "run").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    levels = columns.withColumn("lo", F.explode(F.sequence("a", "b"))).withColumn("hi", F.explode(F.sequence("lo", "b"))).select("case", "lo", "hi", "j", "i")
    along = Window.partitionBy("case", "lo", "hi", "i", "run").orderBy("j")
    deep = runs(levels, "j", "case", "lo", "hi", "i").withColumn("depth", F.row_number().over(along))
    rows = deep.groupBy("case", "lo", "hi", "j").agg(F.sort_array(F.collect_list(F.struct("i", "depth"))).alias("row"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for case, lo, hi, j, row in batch[["case", "lo", "hi", "j", "row"]].itertuples(index=False):
                i, depth = (np.array([x[c] for x in row]) for c in ("i", "depth"))
                left, right = spans(i, depth)
                area = depth * (right - left + 1)
                at = np.lexsort((-left, right, -area))[0]
                out.append((case, int(area[at]) * (hi - lo + 1), lo, hi + 1, j + 1 - int(depth[at]), j + 1, int(left[at]), int(right[at]) + 1))
            yield pd.DataFrame(out, columns=["case", "cells", *BOX])

    found = rows.mapInPandas(best, "case int, cells int, k0 int, k1 int, j0 int, j1 int, i0 int, i1 int")
    order = F.struct(-F.col("cells"), "k0", "k1", "j1", "i1", -F.col("i0"))
    return found.groupBy("case").agg(F.min_by(F.struct("cells", *BOX), order).alias("m")).select("case", "m.*")
