"""Streamlines through a field that lies in tiles.

Particles, not fields, travel: a round sends each to the tile that holds the
point where it next needs the wind, within a Runge-Kutta step or between two.
There all particles of the tile go on together, as arrays, until they need a
point well outside it or end. So a round lasts as long as lines stay in their
tiles and the margins around them, and a line that winds along a border doesn't
cross it all the time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyshear.operators.stencil import cases
from skyshear.sources.store import discard, stored

#: Columns of a tile in either direction; columns around it that a line may wander into; particles of one tile in one task.
TILE, MARGIN, CROWD = 64, 8, 50_000
#: What a particle carries: its point, the slopes so far and the point it needs next.
CARRIED = [f"{name}{axis}" for name in ("p", "a", "b", "c", "q") for axis in "xyz"]


def corners(field: np.ndarray, at: np.ndarray, first: tuple[int, int, int], sizes: tuple[int, int, int]) -> np.ndarray:
    """The wind (n, 3) at points in cells (n, 3: x, y, z) from a tile's array (3, z, y, x) that starts at cell ``first`` (x, y, z); zero outside the domain and on its last cells."""
    base = np.floor(at).astype(np.int64)
    inside = ((base >= 0) & (base < np.array(sizes) - 1)).all(axis=1)
    out = np.zeros((len(at), 3))
    b, f = base[inside] - np.array(first), at[inside] - base[inside]
    for corner in np.ndindex(2, 2, 2):
        w = np.prod(np.where(corner, f, 1 - f), axis=1)
        x, y, z = (b + np.array(corner)).T
        out[inside] += w[:, None] * field[:, z, y, x].T
    return out


def streamlines(seeds: DataFrame, wind: DataFrame, origin: tuple[float, float, float], step: tuple[float, float, float], *, length: float = 1.0, most: int = 200, slow: float = 0.5, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """Case columns, ``seed, seq, x, y, z, speed``: fourth-order Runge-Kutta lines through each seed, backwards then forwards.

    ``seeds``: seed, x, y, z; ``wind``: k, j, i from 0, u, v, w (null or missing:
    none), with cell (0, 0, 0) at ``origin`` and cells ``step`` apart (x, y, z).
    Where both have case columns, lines run through the wind of their own case. A
    step is ``length`` long. A line ends outside, where the wind is still, after a
    point slower than ``slow`` or after ``most`` points. More than ``crowd``
    particles of one tile are dealt over several tasks.
    """
    by = [c for c in cases(wind) if c in seeds.columns]
    kinds = "".join(f"{c} {wind.schema[c].dataType.simpleString()}, " for c in by)
    o, h = np.array(origin, float), np.array(step, float)
    sizes = wind.groupBy(*by).agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).cast("int").alias(f"n{c}") for c in "kji"])
    spread = wind.join(sizes, by) if by else wind.join(F.broadcast(sizes), F.lit(True))  # one row
    margin = min(MARGIN, tile // 2)
    near = lambda c: F.explode(F.array_distinct(F.transform(F.array(F.lit(-margin - 1), F.lit(0), F.lit(margin)), lambda d: F.floor((F.col(c) + d) / tile).cast("int"))))
    dealt = spread.withColumn("tj", near("j")).withColumn("ti", near("i")).filter("tj >= 0 AND ti >= 0")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tj, ti = int(key[-2]), int(key[-1])
        nk, nj, ni = (int(rows[f"n{c}"].iloc[0]) for c in "kji")
        field = np.zeros((3, nk, tile + 2 * margin + 1, tile + 2 * margin + 1))
        at = (rows["k"].to_numpy(), rows["j"].to_numpy() - tj * tile + margin, rows["i"].to_numpy() - ti * tile + margin)
        for n, c in enumerate("uvw"):
            field[(n, *at)] = rows[c].astype(float).fillna(0.0)
        return pd.DataFrame([[*key, nk, nj, ni, field.tobytes()]], columns=[*by, "tj", "ti", "nk", "nj", "ni", "field"])

    tiles = stored(dealt.select(*by, "tj", "ti", "nk", "nj", "ni", "k", "j", "i", "u", "v", "w").groupBy(*by, "tj", "ti").applyInPandas(build, f"{kinds}tj int, ti int, nk int, nj int, ni int, field binary"), "tiles")
    place = [F.floor((F.col(f"q{a}") - float(o[n])) / float(h[n]) / tile).cast("int").alias(f"t{c}") for a, c, n in (("y", "j", 1), ("x", "i", 0))]
    state = ["seed", "sign", "n", "stage", *CARRIED]
    zero = [F.lit(0.0).alias(c) for c in CARRIED if c[0] in "abc"]
    points = [F.col(a).cast("double").alias(f"{name}{a}") for name in "pq" for a in "xyz"]
    start = seeds.withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1)))).select(*by, F.col("seed").cast("long").alias("seed"), "sign", F.lit(0).alias("n"), F.lit(0).alias("stage"), *zero, *points)
    schema = f"{kinds}seed long, sign int, n int, stage int, {', '.join(f'{c} double' for c in CARRIED)}, speed double, moving boolean"

    def advance(key: tuple, particles: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, *state, "speed", "moving"]
        if not len(particles) or not len(about):
            return pd.DataFrame(columns=columns)
        tj, ti = int(key[len(by)]), int(key[len(by) + 1])
        one = about.iloc[0]
        shape = (int(one.ni), int(one.nj), int(one.nk))
        field = np.frombuffer(one.field).reshape(3, shape[2], tile + 2 * margin + 1, tile + 2 * margin + 1)
        seed, sign = particles["seed"].to_numpy(), particles["sign"].to_numpy()
        count, stage = particles["n"].to_numpy(copy=True), particles["stage"].to_numpy(copy=True)
        p, a, b, c, q = (particles[[f"{name}{x}" for x in "xyz"]].to_numpy(float, copy=True) for name in ("p", "a", "b", "c", "q"))
        running, found = np.ones(len(seed), bool), []
        while True:
            at = np.floor((q - o) / h)
            outside = ((at < 0) | (at >= np.array(shape) - 1)).any(axis=1)  # no wind, wherever that is
            here = [(at[:, n] >= t * tile - margin) & (at[:, n] < (t + 1) * tile + margin) for n, t in ((0, ti), (1, tj))]
            now = np.flatnonzero(running & (outside | here[0] & here[1]))
            if not len(now):
                break
            v = corners(field, (q[now] - o) / h, (ti * tile - margin, tj * tile - margin, 0), shape)
            speed = np.sqrt((v**2).sum(axis=1))
            first = stage[now] == 0
            still = now[first & (speed < 1e-6)]
            running[still] = False
            seen = first & (speed >= 1e-6)
            for n, s in zip(now[seen], speed[seen], strict=True):
                found.append((seed[n], sign[n], count[n], *p[n], s))
            last = now[seen & ((speed < slow) | (count[now] + 1 >= most))]
            running[last] = False
            a[now[seen]], b[now[stage[now] == 1]], c[now[stage[now] == 2]] = v[seen], v[stage[now] == 1], v[stage[now] == 2]
            dt = (sign[now] * length / np.maximum(np.sqrt((a[now] ** 2).sum(axis=1)), 1e-3))[:, None]
            at = stage[now][:, None]
            ends = p[now] + dt / 6 * (a[now] + 2 * b[now] + 2 * c[now] + v)
            p[now] = np.where(at == 3, ends, p[now])
            q[now] = np.where(at == 0, p[now] + dt / 2 * a[now], np.where(at == 1, p[now] + dt / 2 * b[now], np.where(at == 2, p[now] + dt * c[now], ends)))
            count[now] += stage[now] == 3
            stage[now] = (stage[now] + 1) % 4
        rest = pd.DataFrame({"seed": seed, "sign": sign, "n": count, "stage": stage, **dict(zip(CARRIED, np.hstack([p, a, b, c, q]).T, strict=True)), "speed": np.nan, "moving": True})[running]
        done = pd.DataFrame(found, columns=["seed", "sign", "n", "px", "py", "pz", "speed"])
        done = done.assign(stage=0, moving=False, **{x: 0.0 for x in CARRIED if x[0] != "p"})
        out = pd.concat([x for x in (done, rest) if len(x)] or [rest])
        for n, name in enumerate(by):
            out[name] = key[n]
        return out[columns].astype({"n": "int32", "sign": "int32", "stage": "int32", "seed": "int64", "moving": bool})

    made: list[DataFrame] = []
    active = start
    while True:
        placed = active.select(*by, *state, *place)
        crowds = placed.groupBy(*by, "tj", "ti").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts"))
        home = tiles.join(crowds, [*by, "tj", "ti"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        ready = placed.join(crowds, [*by, "tj", "ti"]).withColumn("part", F.pmod(F.xxhash64("seed"), F.col("parts")).cast("int"))
        key = [*by, "tj", "ti", "part"]
        new = stored(ready.select(*key, *state).groupBy(*key).cogroup(home.select(*[F.col(c).alias(c) for c in [*key, "nk", "nj", "ni", "field"]]).groupBy(*key)).applyInPandas(advance, schema), "particles")
        made.append(new.filter("NOT moving"))
        active = new.filter("moving").select(*by, *state)
        if active.isEmpty():
            break
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    before = F.count(F.when(F.col("sign") < 0, 1)).over(Window.partitionBy(*by, "seed"))
    seq = F.when(F.col("sign") < 0, before - 1 - F.col("n")).otherwise(before + F.col("n")).alias("seq")
    out = stored(found.select(*by, "seed", seq, *[F.round(f"p{a}", 5).alias(a) for a in "xyz"], F.round("speed", 5).alias("speed")), "lines")
    discard(tiles, *made)
    return out

