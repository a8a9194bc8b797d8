"""Tucker approximations in coordinates against arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyshear.operators import kernels, tensor

MODES = ("m", "k", "j", "i", "c")


def tensors(spark, shape, share, names=MODES, n=2):
    rng = np.random.default_rng(len(shape))
    arrays, rows = [], []
    for case in range(n):
        core = rng.normal(size=[min(2, s) for s in shape])
        x = core
        for mode, s in enumerate(shape):
            x = np.moveaxis(np.tensordot(rng.normal(size=(s, core.shape[mode])), x, axes=(1, mode)), 0, mode)
        x = x + 0.05 * rng.normal(size=shape)
        known = rng.random(shape) < share
        known[tuple(s - 1 for s in shape)] = True
        arrays.append((x, known))
        rows += [(case, *map(int, p), float(x[p])) for p in np.ndindex(*shape) if known[p]]
    cols = ", ".join(f"{m} int" for m in names)
    return arrays, spark.createDataFrame(rows, f"case_id int, {cols}, value double").repartition(5)


@pytest.mark.parametrize(("shape", "ranks", "share", "rounds"), [((3, 2, 4, 5, 3), (2, 2, 3, 2, 3), 1.0, 0), ((3, 2, 4, 5, 3), (1, 2, 2, 2, 2), 0.8, 2)])
def test_approximation_equals_arrays(spark, shape, ranks, share, rounds):
    arrays, entries = tensors(spark, shape, share)
    got = {}
    for r in tensor.approximation(entries, MODES, ranks, rounds).collect():
        got.setdefault(r["case_id"], np.full(shape, np.nan))[tuple(r[m] for m in MODES)] = r["estimate"]
    for case, (x, known) in enumerate(arrays):
        filled = x.copy()
        for s in range(shape[-1]):
            filled[..., s] = np.where(known[..., s], x[..., s], x[..., s][known[..., s]].mean())
        for _ in range(rounds):
            filled = np.where(known, x, kernels.rebuilt(*kernels.hosvd(filled, ranks)))
        want = kernels.rebuilt(*kernels.hosvd(filled, ranks))
        assert got[case] == pytest.approx(want, abs=1e-8)


def test_fit_counts_numbers_and_error(spark):
    arrays, entries = tensors(spark, (4, 5, 3), 0.9, ("a", "b", "c"), 1)
    entries = entries.drop("case_id")
    row = tensor.fit(entries, ("a", "b", "c"), (2, 2, 2)).first()
    x, known = arrays[0]
    filled = np.stack([np.where(known[..., s], x[..., s], x[..., s][known[..., s]].mean()) for s in range(3)], axis=-1)
    gap = (kernels.rebuilt(*kernels.hosvd(filled, (2, 2, 2))) - x)[known]
    assert row["cells"] == known.sum() and row["parameters"] == 8 + 2 * (4 + 5 + 3)
    assert row["error"] == pytest.approx(np.sqrt((gap**2).sum() / (x[known] ** 2).sum()), abs=1e-8)
    whole = tensor.fit(entries, ("a", "b", "c"), (4, 5, 3)).first()
    assert whole["error"] < 1e-10  # with full ranks nothing is lost
    assert tensor.fit(entries.withColumn("case_id", F.lit(1)).filter("false"), ("a", "b", "c"), (1, 1, 1)).count() == 0


def test_gram_of_any_partitioning(spark):
    arrays, entries = tensors(spark, (3, 4, 5), 0.7, ("a", "b", "c"))
    for mode, axis in (("a", 0), ("b", 1), ("c", 2)):
        for parts in (1, 7):
            got = {(r["case_id"], r["p"], r["q"]): r["g"] for r in tensor.gram(entries.repartition(parts), mode, ("a", "b", "c")).collect()}
            for case, (x, known) in enumerate(arrays):
                flat = np.moveaxis(np.where(known, x, 0.0), axis, 0).reshape(x.shape[axis], -1)
                want = flat @ flat.T
                assert all(want[p, q] == pytest.approx(g, abs=1e-9) for (c, p, q), g in got.items() if c == case)
