"""Three-dimensional variational wind: least squares of observations, background, mass continuity and smoothness.

All four terms are quadratic, so conjugate gradients solve the normal equations
without a matrix. ``solve`` gives each case to one task. ``solve_tiled`` cuts
cases of any size into tiles: a round sends each tile the strips of its
neighbours' residuals that its stencils reach into, applies the operator there,
and adds up two scalar products a case; the other vectors follow by recurrence
(the conjugate gradients of Chronopoulos and Gear), so both take the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyshear.operators.stencil import cases
from skyshear.sources.store import discard, stored

#: Cells that the operator reaches over.
HALO = 2
#: Weights of observations, background, mass continuity and smoothness.
WEIGHTS = (1.0, 1e-2, 256.0, 1.0)
#: Cells of a case that one task solves; columns of a tile in either direction.
TASK, TILE = 2_000_000, 64
#: Iterations between two looks at how far the wind has moved.
CHECK = 10
GIVEN = ("bx1", "by1", "bz1", "bx2", "by2", "bz2", "vr1", "vr2", "u0", "v0", "z")


class System:
    """The normal equations on an array of cells (k, j, i) given by the columns of GIVEN; null where there is none."""

    def __init__(self, given: np.ndarray, weights: tuple[float, float, float, float], steps: tuple[float, float, float]) -> None:
        self.weights, self.steps = weights, steps
        clean = np.nan_to_num(given)
        self.beams = (clean[0:3], clean[3:6])
        self.seen = tuple((~np.isnan(given[n])).astype(float) for n in (6, 7))
        self.there = ~np.isnan(given[10])
        self.start = np.stack([clean[8], clean[9], np.zeros_like(clean[8])])
        self.rho = np.exp(-clean[10] / 10_000.0)
        co, cb = weights[:2]
        self.right = cb * self.start + sum(co * b * (m * o) for b, m, o in zip(self.beams, self.seen, clean[6:8], strict=True))

    def divergence(self, x: np.ndarray) -> np.ndarray:
        dx, dy, dz = self.steps
        inner = tuple(slice(0, n - 1) for n in x.shape[1:])
        return np.diff(x[0], axis=2)[inner] / dx + np.diff(x[1], axis=1)[inner] / dy + np.diff(self.rho * x[2], axis=0)[inner] / dz / self.rho[inner]

    def divergence_adjoint(self, g: np.ndarray) -> np.ndarray:
        dx, dy, dz = self.steps
        inner = tuple(slice(0, n) for n in g.shape)

        def back(a: np.ndarray, axis: int, h: float) -> np.ndarray:
            full = np.pad(a, [(0, 1 if n != axis else 0) for n in range(3)])
            return -np.diff(np.pad(full, [(1, 1) if n == axis else (0, 0) for n in range(3)]), axis=axis) / h

        return np.stack([back(g, 2, dx), back(g, 1, dy), self.rho * back(g / self.rho[inner], 0, dz)])

    def apply(self, x: np.ndarray) -> np.ndarray:
        co, cb, cm, cs = self.weights
        out = cb * x
        for b, m in zip(self.beams, self.seen, strict=True):
            out = out + co * b * (m * (b * x).sum(0))
        out = out + cm * self.steps[0] ** 2 * self.divergence_adjoint(self.divergence(x))
        for axis in (1, 2, 3):
            if x.shape[axis] > 2:
                second = np.diff(x, 2, axis=axis)
                out = out + cs * np.diff(np.pad(second, [(2, 2) if n == axis else (0, 0) for n in range(4)]), 2, axis=axis)
        return out


def with_case(cells: DataFrame) -> tuple[DataFrame, list[str]]:
    """``cells`` with the columns that tell cases apart; a table of one case gets one."""
    by = list(cases(cells))
    return (cells, by) if by else (cells.withColumn("case", F.lit(0)), ["case"])


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def solve(cells: DataFrame, *, weights: tuple = WEIGHTS, steps: tuple[float, float, float], most: int = 150, tol: float = 1e-8, change: float = 0.0, check: int = CHECK) -> DataFrame:
    """Case columns, ``k, j, i, u, v, w, iterations, residual, moved``: the wind of each case, one task a case.

    ``cells``: k, j, i from 0, z, both radars' unit vectors and radial velocities
    (null: unobserved), background u0, v0. It stops at a relative residual of
    ``tol``, after ``most`` iterations, or when the wind has moved by less than
    ``change`` (m/s) anywhere since the last look; ``moved`` says by how much.
    """
    table, by = with_case(cells)

    def one(key: tuple, case: pd.DataFrame) -> pd.DataFrame:
        at = tuple(case[c].to_numpy() for c in "kji")
        given = np.full((len(GIVEN), *(int(a.max()) + 1 for a in at)), np.nan)
        for n, name in enumerate(GIVEN):
            given[(n, *at)] = case[name].astype(float)
        system = System(given, weights, steps)
        x = system.start.copy()
        r = system.right - system.apply(x)
        p, rr, norm = r.copy(), float((r * r).sum()), float((system.right**2).sum()) or 1.0
        it, mark, moved = 0, x, math.nan
        while it < most and rr / norm > tol * tol:
            ap = system.apply(p)
            a = rr / float((p * ap).sum())
            x, r = x + a * p, r - a * ap
            new = float((r * r).sum())
            p, rr, it = r + new / rr * p, new, it + 1
            if it % check == 0:
                moved, mark = float(np.abs(x - mark).max()), x
                if moved < change:
                    break
        out = case[["k", "j", "i"]].copy()
        for n, name in enumerate(by):
            out.insert(n, name, key[n])
        for c, name in enumerate("uvw"):
            out[name] = np.round(x[(c, *at)], 4)
        out["iterations"], out["residual"], out["moved"] = it, math.sqrt(rr / norm), moved
        return out

    return table.groupBy(*by).applyInPandas(one, f"{_kinds(table, by)}, k int, j int, i int, u double, v double, w double, iterations int, residual double, moved double")


def _extent(t: int, tile: int, n: int, halo: int) -> tuple[int, int]:
    return max(t * tile - halo, 0), min((t + 1) * tile + halo, n)


def _own(row, tile: int) -> tuple[slice, slice]:  # noqa: ANN001
    """Where a tile's own cells stand in its array with halos."""
    out = []
    for t, n in ((row.tj, row.nj), (row.ti, row.ni)):
        (lo, hi), (first, _) = _extent(t, tile, n, 0), _extent(t, tile, n, HALO)
        out.append(slice(lo - first, hi - first))
    return out[0], out[1]


def solve_tiled(cells: DataFrame, *, weights: tuple = WEIGHTS, steps: tuple[float, float, float], most: int = 150, tol: float = 1e-8, change: float = 0.0, check: int = CHECK, tile: int = TILE) -> DataFrame:
    """What ``solve`` gives, for cases of any size: tiles of ``tile`` columns square, a written table a round.

    Only the sums of each case decide when it stops; cases that have leave the
    rounds. A task holds one tile and the strips around it.
    """
    table, by = with_case(cells)
    sizes = table.groupBy(*by).agg(*[(F.max(c) + 1).cast("int").alias(f"n{c}") for c in "kji"])
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-HALO), F.lit(0), F.lit(HALO)), lambda d: F.floor((F.col(c) + d) / tile).cast("int")))
    dealt = table.join(sizes, by).withColumn("tj", F.explode(near("j"))).withColumn("ti", F.explode(near("i")))
    dealt = dealt.filter((F.col("tj") >= 0) & (F.col("ti") >= 0) & (F.col("tj") * tile < F.col("nj")) & (F.col("ti") * tile < F.col("ni")))
    place = [*by, "tj", "ti"]
    state = f"{_kinds(table, by)}, tj int, ti int, nk int, nj int, ni int, it int, alpha double, before double, gamma double, delta double, norm double, moved double, given binary, vectors binary"
    names = [x.split()[0] for x in state.split(", ")]

    def unpack(row) -> tuple[System, np.ndarray]:  # noqa: ANN001
        (j0, j1), (i0, i1) = _extent(row.tj, tile, row.nj, HALO), _extent(row.ti, tile, row.ni, HALO)
        own = _own(row, tile)
        given = np.frombuffer(row.given).reshape(len(GIVEN), row.nk, j1 - j0, i1 - i0)
        vectors = np.frombuffer(row.vectors).reshape(6, 3, row.nk, own[0].stop - own[0].start, own[1].stop - own[1].start)
        return System(given, weights, steps), vectors

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tj, ti = int(key[-2]), int(key[-1])
        nk, nj, ni = (int(rows[f"n{c}"].iloc[0]) for c in "kji")
        (j0, j1), (i0, i1) = _extent(tj, tile, nj, HALO), _extent(ti, tile, ni, HALO)
        given = np.full((len(GIVEN), nk, j1 - j0, i1 - i0), np.nan)
        at = (rows["k"].to_numpy(), rows["j"].to_numpy() - j0, rows["i"].to_numpy() - i0)
        for n, name in enumerate(GIVEN):
            given[(n, *at)] = rows[name].astype(float)
        system = System(given, weights, steps)
        out = pd.DataFrame([[*key, nk, nj, ni, 0, 1.0, math.inf, 0.0, 0.0, 0.0, math.nan, given.tobytes(), b""]], columns=names)
        own = _own(out.iloc[0], tile)
        x = system.start[:, :, own[0], own[1]]
        r = (system.right - system.apply(system.start))[:, :, own[0], own[1]]
        none = np.zeros_like(x)
        out["norm"] = float((system.right[:, :, own[0], own[1]] ** 2).sum())
        out["vectors"] = [np.stack([x, r, none, none, none, x]).tobytes()]  # wind, residual, direction, its image, the residual's image, the wind at the last look
        return out

    moving = f"{state}, kind int, sj int, si int, strip binary"

    def send(row, vectors: np.ndarray) -> Iterator[dict]:  # noqa: ANN001
        """The tile itself, and the strips of its residual that its neighbours' arrays hold."""
        base = {n: getattr(row, n) for n in names}
        yield {**base, "vectors": vectors.tobytes(), "kind": 0, "sj": row.tj, "si": row.ti, "strip": b""}
        (j0, j1), (i0, i1) = _extent(row.tj, tile, row.nj, 0), _extent(row.ti, tile, row.ni, 0)
        for dj in (-1, 0, 1):
            for di in (-1, 0, 1):
                tj, ti = row.tj + dj, row.ti + di
                if (dj or di) and tj >= 0 and ti >= 0 and tj * tile < row.nj and ti * tile < row.ni:
                    (a0, a1), (b0, b1) = _extent(tj, tile, row.nj, HALO), _extent(ti, tile, row.ni, HALO)
                    cut = vectors[1][:, :, max(a0, j0) - j0 : min(a1, j1) - j0, max(b0, i0) - i0 : min(b1, i1) - i0]
                    yield {**base, "tj": tj, "ti": ti, "given": b"", "vectors": b"", "kind": 1, "sj": row.tj, "si": row.ti, "strip": np.ascontiguousarray(cut).tobytes()}

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names, "kind", "sj", "si", "strip"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                _, vectors = unpack(row)
                x, r, p, s, w, mark = vectors
                values = row._asdict()
                if not math.isnan(row.total):  # the first round only fetches strips
                    beta = row.total / row.before if math.isfinite(row.before) else 0.0
                    alpha = row.total / (row.image - beta * row.total / row.alpha if beta else row.image)
                    p = r + beta * p
                    s = w + beta * s
                    x, r = x + alpha * p, r - alpha * s
                    values |= {"alpha": alpha, "before": row.total, "it": row.it + 1}
                    if values["it"] % check == 0:
                        values["moved"], mark = float(np.abs(x - mark).max()), x
                yield pd.DataFrame(list(send(pd.Series(values), np.stack([x, r, p, s, w, mark]))), columns=columns)

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        home = rows[rows["kind"] == 0].iloc[0]
        system, vectors = unpack(home)
        own = _own(home, tile)
        (j0, j1), (i0, i1) = _extent(home.tj, tile, home.nj, HALO), _extent(home.ti, tile, home.ni, HALO)
        r = np.zeros((3, home.nk, j1 - j0, i1 - i0))
        r[:, :, own[0], own[1]] = vectors[1]
        for strip in rows[rows["kind"] == 1].itertuples(index=False):
            (a0, a1), (b0, b1) = _extent(strip.sj, tile, home.nj, 0), _extent(strip.si, tile, home.ni, 0)
            a, b = slice(max(a0, j0) - j0, min(a1, j1) - j0), slice(max(b0, i0) - i0, min(b1, i1) - i0)
            r[:, :, a, b] = np.frombuffer(strip.strip).reshape(r[:, :, a, b].shape)
        w = system.apply(r)[:, :, own[0], own[1]]
        out = home[names].copy()
        out["gamma"], out["delta"] = float((vectors[1] ** 2).sum()), float((w * vectors[1]).sum())
        new = vectors.copy()
        new[4] = w
        out["vectors"] = new.tobytes()
        return pd.DataFrame([out], columns=names)

    def told(tiles: DataFrame) -> DataFrame:
        """A row a case: its scalar products, and whether it goes on."""
        sums = tiles.groupBy(*by).agg(F.sum("gamma").alias("total"), F.sum("delta").alias("image"), F.sum("norm").alias("whole"), F.max("moved").alias("far"), F.max("it").alias("round"))
        whole = F.when(F.col("whole") > 0, F.col("whole")).otherwise(1.0)
        still = (F.col("round") > 0) & (F.col("round") % check == 0) & (F.col("far") < change)
        return sums.withColumn("whole", whole).withColumn("on", (F.col("round") < most) & (F.col("total") / F.col("whole") > tol * tol) & ~still)

    def exchanged(ready: DataFrame) -> DataFrame:
        return stored(ready.mapInPandas(advance, moving).groupBy(*place).applyInPandas(gather, state), "tiles")

    first = stored(dealt.select(*place, "nk", "nj", "ni", "k", "j", "i", *GIVEN).groupBy(*place).applyInPandas(build, state), "tiles")
    tiles = exchanged(first.withColumns({"total": F.lit(math.nan), "image": F.lit(math.nan)}))
    discard(first)
    ended: list[DataFrame] = []
    while True:
        sums = told(tiles)
        states = {r["on"]: r["n"] for r in sums.groupBy("on").agg(F.count("*").alias("n")).collect()}
        if states.get(False) or not states:
            ended.append(stored(tiles.join(sums.filter(~F.col("on")), by), "solved"))
        if not states.get(True):
            break
        new = exchanged(tiles.join(sums.filter("on").select(*by, "total", "image"), by))
        discard(tiles)
        tiles = new
    discard(tiles)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                system, vectors = unpack(row)
                own = _own(row, tile)
                k, j, i = np.nonzero(system.there[:, own[0], own[1]])
                out = pd.DataFrame({"k": k, "j": j + row.tj * tile, "i": i + row.ti * tile})
                for n, name in enumerate(by):
                    out.insert(n, name, getattr(row, name))
                for c, name in enumerate("uvw"):
                    out[name] = np.round(vectors[0][c][k, j, i], 4)
                out["iterations"], out["residual"], out["moved"] = row.it, math.sqrt(row.total / row.whole), row.far
                yield out

    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return found.mapInPandas(rows_of, f"{_kinds(table, by)}, k int, j int, i int, u double, v double, w double, iterations int, residual double, moved double")


def wind_of(cells: DataFrame, *, task: int = TASK, **options) -> DataFrame:  # noqa: ANN003
    """``solve`` for cases of up to ``task`` cells, ``solve_tiled`` for larger ones; both take the same steps."""
    table, by = with_case(cells)
    counts = table.groupBy(*by).agg(F.count("*").alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    plain = {k: v for k, v in options.items() if k != "tile"}
    if largest <= task:
        return solve(table, **plain)
    small, large = (table.join(counts.filter(c).drop("_n"), by, "left_semi") for c in (F.col("_n") <= task, F.col("_n") > task))
    return solve(small, **plain).unionByName(solve_tiled(large, **options))
