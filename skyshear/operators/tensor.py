"""Tucker approximations of tensors in coordinates, of any number of modes and any size.

A mode's Gram matrix is a sum over the tensor's fibres along it, added up in each
task before it is shuffled. Its leading eigenvectors, one small group a case, are
the mode's factor; the product with a factor is a join on the mode's index and a
sum over it. Modes are truncated one after the other, so each works on what the
one before has left (sequentially truncated higher-order singular values).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyshear.functions.geo import nonzero
from skyshear.operators.stencil import cases
from skyshear.sources.store import discard, stored

#: The longest mode: its Gram matrix is held by a task of its own.
LONGEST = 4096


def _kinds(df: DataFrame, by: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)


def gram(entries: DataFrame, mode: str, modes: tuple[str, ...], value: str = "value") -> DataFrame:
    """Case columns, ``p, q, g``: inner products of the slices of ``mode``, for p <= q; missing entries count as zero.

    The entries of a fibre come together once; tasks add up the products of their
    fibres in one matrix a case.
    """
    by = list(cases(entries))
    others = [m for m in modes if m != mode]
    fibres = entries.filter(F.col(value).isNotNull()).groupBy(*by, *others).agg(F.collect_list(F.struct(F.col(mode).cast("int").alias("at"), F.col(value).cast("double").alias("v"))).alias("e")).select(*by, "e")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(by, sort=False, dropna=False) if by else [((), batch)]:
                size = [len(e) for e in rows["e"]]
                at = np.array([x["at"] for e in rows["e"] for x in e])
                names, place = np.unique(at, return_inverse=True)
                x = np.zeros((len(names), len(size)))
                x[place, np.repeat(np.arange(len(size)), size)] = [x["v"] for e in rows["e"] for x in e]
                p, q = np.triu_indices(len(names))
                out = pd.DataFrame({"p": names[p], "q": names[q], "g": (x @ x.T)[p, q]})
                for n, name in enumerate(by):
                    out.insert(n, name, key[n])
                yield out

    return fibres.mapInPandas(products, f"{_kinds(entries, by)}p int, q int, g double").groupBy(*by, "p", "q").agg(F.sum("g").alias("g"))


def factor(products: DataFrame, rank: int) -> DataFrame:
    """Case columns, ``at, r, f``: the ``rank`` leading eigenvectors of each case's Gram matrix, their largest entry positive."""
    by = list(cases(products))

    def leading(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["q"].max()) + 1
        if n > LONGEST:
            raise ValueError(f"a mode has {n} places; {LONGEST} at most")
        g = np.zeros((n, n))
        g[rows["p"], rows["q"]] = g[rows["q"], rows["p"]] = rows["g"]
        vectors = np.linalg.eigh(g)[1][:, ::-1][:, :rank]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        at, r = np.indices(vectors.shape)
        out = pd.DataFrame({"at": at.ravel(), "r": r.ravel(), "f": vectors.ravel()})
        for i, name in enumerate(by):
            out.insert(i, name, key[i])
        return out

    grouped = products.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"]))
    return grouped.applyInPandas(leading, f"{_kinds(products, by)}at int, r int, f double")


def times(entries: DataFrame, factors: DataFrame, mode: str, modes: tuple[str, ...], back: bool = False) -> DataFrame:
    """The product with a factor along ``mode``: its places become ranks, or ``back`` from ranks to places."""
    by = list(cases(entries))
    old, new = ("r", "at") if back else ("at", "r")
    legs = factors.select(*by, F.col(old).alias(mode), F.col(new).alias("_to"), "f")
    others = [m for m in modes if m != mode]
    return entries.join(legs, [*by, mode]).groupBy(*by, *others, F.col("_to").alias(mode)).agg(F.sum(F.col("value") * F.col("f")).alias("value")).select(*by, *modes, "value")


def hosvd(entries: DataFrame, modes: tuple[str, ...], ranks: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """The core (case columns, modes, value) and the factor of each mode; each is a written table, as the next mode reads it twice."""
    core, factors, last = entries, [], None
    for mode, rank in zip(modes, ranks, strict=True):
        factors.append(stored(factor(gram(core, mode, modes), rank), "factor"))
        core = stored(times(core, factors[-1], mode, modes), "core")
        if last is not None:
            discard(last)
        last = core
    return core, factors


def rebuilt(core: DataFrame, factors: list[DataFrame], modes: tuple[str, ...]) -> DataFrame:
    """The tensor that a core and its factors stand for."""
    return reduce(lambda x, mf: times(x, mf[1], mf[0], modes, back=True), zip(modes, factors, strict=True), core)


def boxed(entries: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Every place of each case's box of indices from 0, with ``value``, null where there is none."""
    by = list(cases(entries))
    sizes = entries.groupBy(*by).agg(*[F.max(m).cast("int").alias(m) for m in modes])
    places = reduce(lambda df, m: df.withColumn(m, F.explode(F.sequence(F.lit(0), F.col(m)))), modes, sizes)
    known = entries.select(*by, *[F.col(m).cast("int").alias(m) for m in modes], F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))
    return places.join(known, [*by, *modes], "left")


def approximation(entries: DataFrame, modes: tuple[str, ...], ranks: tuple[int, ...], rounds: int = 0) -> DataFrame:
    """Case columns, modes, ``value`` (null: missing) and ``estimate``, on the whole box of each case.

    Missing entries start from the mean of their slice along the last mode, or of
    the case, and are replaced by the approximation ``rounds`` times; the last
    approximation isn't clamped to what is known. A round writes one table and
    deletes the one before.
    """
    by = list(cases(entries))
    whole = stored(boxed(entries, modes), "box")
    slices = whole.groupBy(*by, modes[-1]).agg(F.avg("value").alias("_slice"))
    means = whole.groupBy(*by).agg(F.avg("value").alias("_mean"))
    start = whole.join(slices, [*by, modes[-1]])
    start = start.join(means, by) if by else start.join(F.broadcast(means), F.lit(True))  # one row
    filled = stored(start.select(*by, *modes, F.coalesce("value", "_slice", "_mean").alias("value")), "filled")
    keys = [*by, *modes]
    for n in range(rounds + 1):
        core, factors = hosvd(filled, modes, ranks)
        estimate = rebuilt(core, factors, modes).withColumnRenamed("value", "estimate")
        out = stored(whole.join(estimate, keys), "approximation")
        discard(core, *factors, filled)
        if n < rounds:
            filled = stored(out.select(*keys, F.coalesce("value", "estimate").alias("value")), "filled")
            discard(out)
    discard(whole)
    return out


def fit(entries: DataFrame, modes: tuple[str, ...], ranks: tuple[int, ...], rounds: int = 0) -> DataFrame:
    """Case columns, ``cells, error, parameters``: known entries, the relative error on them, and the numbers that core and factors hold."""
    by = list(cases(entries))
    out = approximation(entries, modes, ranks, rounds)
    gap, norm = F.sqrt(F.sum((F.col("estimate") - F.col("value")) ** 2)), F.sqrt(F.sum(F.col("value") ** 2))
    stored_numbers = F.lit(math.prod(ranks)) + sum(((F.max(m) + 1) * r for m, r in zip(modes, ranks, strict=True)), F.lit(0))
    return out.groupBy(*by).agg(F.count("value").alias("cells"), F.coalesce(gap / nonzero(norm), gap).alias("error"), stored_numbers.cast("long").alias("parameters"))
