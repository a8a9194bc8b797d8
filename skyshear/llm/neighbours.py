"""Approximate nearest neighbours by cross-polytope hashing.

A table turns every unit vector by pseudo-random rotations, each of three rounds
of random signs and a fast Hadamard transform. The signed axis that is nearest
after a rotation is a digit of the vector's bucket; as many digits are joined,
the last from a few axes only, as leave LOAD vectors in a bucket. So a query
looks at about TABLES * PROBES * LOAD candidates whatever the number of vectors.
Its probes are the PROBES buckets whose axes it is nearest to in sum, and all
that it finds in them is ranked by exact cosine.

Equal vectors are one entry with its smallest ids, so a very common vector is
one row. Buckets meet queries in chunks of neighbouring buckets. The vectors of
a large chunk, and the queries for it, are split by numbers that the counts
give, so no task grows with a chunk and no candidate is left out. A block keeps
each query's best entries, which hold the best of all once blocks are brought
together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Tables, buckets that a query looks at in each, vectors of a bucket, neighbours.
TABLES, PROBES, LOAD, NEAREST = 32, 26, 3, 5
#: Vectors of a chunk of buckets on average, and vectors or queries of a chunk in one block.
CHUNK, BLOCK = 2048, 4096
#: At most so many chunks are split further; their list is broadcast.
SPLIT = 100_000
#: Pairs of a query and a vector that a block compares at once.
PAIRS = 500_000
#: Groups in which the ids of equal vectors are cut to the smallest before they come together.
SALTS = 256
ROUNDS = 3
#: Rows of the transform's butterfly.
RADIX = 64


@lru_cache
def butterfly(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of ``n`` rows, n a power of two, scaled to keep lengths."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(n)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths: butterflies of RADIX at a time."""
    rows, n = x.shape
    step = min(n, RADIX)
    x = x.reshape(rows * (n // step), step) @ butterfly(step)
    if n == step:
        return x
    inner = x.reshape(rows, n // step, step).transpose(0, 2, 1).reshape(rows * step, n // step)
    return hadamard(inner).reshape(rows, step, n // step).transpose(0, 2, 1).reshape(rows, n)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Rows of ``x``, padded to a power of two, after rotation ``number``."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.float32)
    signs = np.random.default_rng([number, width]).choice(np.array([-1.0, 1.0], np.float32), (ROUNDS, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def digits(n: int, dim: int, load: int = LOAD) -> list[int]:
    """How many signed axes each digit of a bucket tells apart, so that ``n`` vectors leave about ``load`` in a bucket."""
    full = max(1, int(dim - 1).bit_length()) + 1
    left, out = max(1, round(np.log2(max(2.0, n / load)))), []
    while left > 0:
        out.append(1 << min(left, full))
        left -= full
    return out


def axes(x: np.ndarray, number: int, place: int, size: int) -> np.ndarray:
    """Nearness of each row to the ``size`` signed axes of digit ``place`` of table ``number``."""
    y = rotated(x, number * 64 + place)[:, : size // 2]
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, number: int, sizes: list[int]) -> np.ndarray:
    """The bucket of each row in table ``number``."""
    out = np.zeros(len(x), np.int64)
    for place, size in enumerate(sizes):
        out = out * size + axes(x, number, place, size).argmax(axis=1)
    return out


def probes(x: np.ndarray, number: int, sizes: list[int], most: int) -> np.ndarray:
    """The ``most`` buckets of table ``number`` to whose axes each row is nearest in sum, ascending."""
    near, code = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
    for place, size in enumerate(sizes):
        y = axes(x, number, place, size)
        best = np.argsort(-y, axis=1, kind="stable")[:, :most]
        near = (near[:, :, None] + np.take_along_axis(y, best, axis=1)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * size + best[:, None, :]).reshape(len(x), -1)
        if near.shape[1] > most:
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            near, code = np.take_along_axis(near, best, axis=1), np.take_along_axis(code, best, axis=1)
    return np.sort(code, axis=1)


def usable(values: list | None) -> np.ndarray | None:
    """The vector in double precision, if it may take part."""
    if not values or None in values:
        return None
    v = np.array(values, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def entries(vectors: DataFrame, id_column: str, column: str, every: int, k: int) -> DataFrame:
    """``key, dim, vector, ids, asks``: each distinct usable vector, its k + 1 smallest distinct ids, and whether an id is divisible by ``every``.

    A batch reduces equal vectors before they are shuffled, and SALTS groups of
    them once more. Null, empty and zero vectors and those with a null or
    non-finite component are left out; so are null ids.
    """
    kind = vectors.schema[column].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set] = {}
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is not None and (v := usable(values)) is not None:
                    held.setdefault(v.tobytes(), set()).add(name)
            rows = [(xxhash.xxh3_128_digest(b), np.frombuffer(b), sorted(names)[: k + 1], any(x % every == 0 for x in names)) for b, names in held.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([len(r[1]) for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.list_(pa.float32() if kind == "float" else pa.float64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.bool_()),
                ],
                ["key", "dim", "vector", "ids", "asks"],
            )

    some = vectors.select(F.col(id_column).cast("long"), column).mapInArrow(run, f"key binary, dim int, vector array<{kind}>, ids array<long>, asks boolean")
    first = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    rest = [F.first("dim").alias("dim"), F.first("vector").alias("vector"), first, F.max("asks").alias("asks")]
    return some.groupBy("key", (F.spark_partition_id() % SALTS).alias("salt")).agg(*rest).groupBy("key").agg(*rest)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length of vector, with their unit vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, unit(matrix(part.column("vector"), dim).astype(np.float64))


def hashed(rows: DataFrame, counts: dict[int, int], tables: int, load: int) -> DataFrame:
    """``rows`` with ``codes``, the bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_dim(batch):
                codes = np.stack([buckets(x, t, digits(counts[dim], dim, load)) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))], [*part.schema.names, "codes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, codes array<long>")


def width(n: int, dim: int, load: int) -> int:
    """Buckets of a chunk."""
    return max(1, int(np.prod([float(x) for x in digits(n, dim, load)]) * CHUNK / max(1, n)))


def asked_of(rows: DataFrame, counts: dict[int, int], tables: int, most: int, load: int) -> DataFrame:
    """``rows`` for each chunk that they look into, with its ``codes``: (number of the table, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_dim(batch):
                sizes, wide = digits(counts[dim], dim, load), width(counts[dim], dim, load)
                for number in range(tables):
                    codes = probes(x, number, sizes, most)
                    chunk = codes // wide
                    new = np.ones(codes.shape, bool)
                    new[:, 1:] = chunk[:, 1:] != chunk[:, :-1]
                    at = np.flatnonzero(new)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [codes.size]]).astype(np.int32)), pa.array(codes.ravel()))
                    own = part.take(pa.array(at // codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), number, np.int32)), pa.array(chunk.ravel()[at]), lists], [*own.schema.names, "number", "chunk", "codes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, number int, chunk long, codes array<long>")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows of equal count, each from its two vectors alone; scaled by powers of two, which rounds nothing."""
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (q, x))
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def best_of(score: np.ndarray, lists: list[list[int]], k: int) -> np.ndarray:
    """Places of the best scores, as many as have k + 1 ids together, and of all that tie with the last."""
    order, seen = np.argsort(-score, kind="stable"), set()
    for n, i in enumerate(order.tolist()):
        if len(seen) > k and score[i] < score[order[n - 1]]:
            return order[:n]
        seen.update(lists[i])
    return order


def best_of_block(queries: pa.Table, index: pa.Table, k: int) -> pa.Table:
    """``query, key, ids, score`` of each query's best entries in the buckets that it looks into."""
    names = ["query", "key", "ids", "score"]
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
    found = []
    if queries.num_rows and index.num_rows:
        dim = index.column("dim")[0].as_py()
        q, x = (matrix(t.column("vector").combine_chunks(), dim).astype(np.float64) for t in (queries, index))
        code = index.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        codes = queries.column("codes").combine_chunks()
        probe = codes.flatten().to_numpy()
        asker = np.repeat(np.arange(len(q)), np.diff(codes.offsets.to_numpy()))
        low, high = np.searchsorted(code, probe), np.searchsorted(code, probe, "right")
        per_query = np.bincount(asker, high - low, len(q)).astype(np.int64)
        lists = index.column("ids").to_pylist()
        for rows in slices(per_query, PAIRS):
            mine = (asker >= rows[0]) & (asker < rows[1])
            size = (high - low)[mine]
            a = np.repeat(asker[mine], size)
            within = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
            b = order[np.repeat(low[mine], size) + within]
            score = np.concatenate([cosines(q[a[i : i + 65_536]], x[b[i : i + 65_536]]) for i in range(0, len(a), 65_536)]) if len(a) else np.zeros(0)
            ends = np.flatnonzero(np.diff(a)) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(a)], strict=True) if len(a) else ():
                best = best_of(score[i:j], [lists[n] for n in b[i:j].tolist()], k) if j - i > k + 1 else np.arange(j - i)
                found.append((a[i + best], b[i + best], score[i + best]))
    if not found:
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
    a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.Table.from_arrays([queries.column("key").take(pa.array(a)), index.column("key").take(pa.array(b)), index.column("ids").take(pa.array(b)), pa.array(score)], names)


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``most`` at most, or of one row."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(sizes))]


def search(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", every: int = 50, k: int = NEAREST, tables: int = TABLES, most: int = PROBES, load: int = LOAD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id is divisible by ``every``, by cosine.

    Ties go to the smaller id. A query whose vector can't take part has no row,
    nor has one without candidates; where there are fewer than k, it gets these.
    Vectors meet only those of their length. Rows that share an id are one id
    with several vectors: the pair's best cosine counts. An empty table gives an
    empty result; other columns are ignored.
    """
    own = stored(entries(vectors, id_column, column, every, k), "ann-entries")
    counts = {r["dim"]: r["count"] for r in own.groupBy("dim").count().toLocalIterator()}  # a row for each length of vector
    wide = F.lit(1).cast("long")
    for dim, n in counts.items():
        wide = F.when(F.col("dim") == dim, F.lit(width(n, dim, load)).cast("long")).otherwise(wide)
    coded = stored(hashed(own.select("key", "dim", "vector", "ids"), counts, tables, load), "ann-codes")
    chunk, block = ["dim", "number", "chunk"], ["dim", "number", "chunk", "i", "j"]
    placed = lambda *keep: coded.select("dim", *keep, F.posexplode("codes").alias("number", "code")).withColumn("chunk", F.floor(F.col("code") / wide))
    asked = stored(asked_of(own.filter("asks").select("key", "dim", "vector"), counts, tables, most, load), "ann-asked")
    # only chunks beyond a block, SPLIT at most, are split
    limit = lambda total: max(BLOCK, total // SPLIT)
    large = lambda rows, name, total: rows.groupBy(*chunk).agg(F.count("*").alias("n")).filter(F.col("n") > limit(total)).select(*chunk, F.ceil(F.col("n") / limit(total)).cast("int").alias(name))
    split = stored(large(placed(), "rows", sum(counts.values()) * tables).join(large(asked, "columns", asked.count()), chunk, "full"), "ann-blocks")
    number = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    parts = lambda rows: rows.join(F.broadcast(split), chunk, "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
    index = parts(placed("key", "vector", "ids")).withColumn("i", F.pmod(number, F.col("rows")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).drop("rows", "columns")
    asks = parts(asked).withColumn("j", F.pmod(number, F.col("columns")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).drop("rows", "columns")
    found = asks.groupBy(*block).cogroup(index.groupBy(*block)).applyInArrow(lambda a, b: best_of_block(a, b, k), "query binary, key binary, ids array<long>, score double")
    found = found.groupBy("query", "key").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    each = found.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    # k + 1 of them, since a query is no candidate of its own
    best = stored(each.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k + 1).drop("place"), "ann-best")
    discard(own, coded, asked, split)
    queries = entry_ids(vectors, id_column, column, every)
    pairs = queries.join(best, "query").filter("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def entry_ids(vectors: DataFrame, id_column: str, column: str, every: int) -> DataFrame:
    """``query_id, query``: each query and the key of its entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, xxhash.xxh3_128_digest(u.tobytes())) for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (u := usable(v)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["query_id", "query"])

    return vectors.filter(F.col(id_column) % every == 0).select(F.col(id_column).cast("long"), column).mapInArrow(run, "query_id long, query binary")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"))
