"""N-gram Jaccard join by parity sketches.

A document is its set of hashed word shingles. Its sketch has B segments of
2^64 bits each; every shingle flips one bit of one segment. The sketch of a
symmetric difference is the exclusive or of both sketches, so two sets that
differ in d shingles have sketches at a Hamming distance of d at most, in at
most d segments. A segment is kept as the exclusive or of a random number for
each of its flipped bits, which is equal where segments are.

With a similarity of 0.8 or more, sets of n shingles differ in n / 4 at most.
By the pigeonhole principle two such sets agree in all but n / 4 of their
segments. Each set therefore publishes its first n / 4 + 1 + q non-empty
segments in one order for all sets, fullest segments first, and any two similar
sets publish q + 1 equal ones. Sketches are made per size band, doubling; a set
that may have partners in the next band is published there as well.

Sets that share a published segment are candidates. A candidate pair goes first
by sizes and by a short sketch of bits, whose Hamming distance is no more than
the symmetric difference; what is left is verified on the sets themselves, which
are read again for these classes alone. Equal sets are one class from the start,
named by 128 bits. A segment that many classes share is hot: its pairs are never
listed. A class with few hot segments has, by q, a colder one in common with
every partner. Classes with many (groups of near copies, texts around a common
passage) show their rarest shingles instead. Those that meet in one are compared
with a pivot (the class with the fewest shingles of its own, likely the text that
others vary), round by round, as long as that settles most of them; what is left
is compared by sketches. Meetings of many classes are dealt over tasks by a salt,
whatever their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyshear.operators.graph import components

from .bpe import forget, parts, texts_of
from .common import discard, stored, table

#: Words of a shingle; the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Classes that share a segment: beyond, it is hot.
HOT = 16
#: Spare segments q: one for each so many shingles; a class with n // LIMIT hot segments or fewer needs no pivot.
SPARE, LIMIT = 24, 30
#: Pivot rounds go on while pairs are more than so many for each row that meets and a round halves the rows; ROUNDS at most.
PAIRS, ROUNDS = 4, 8
#: At most so many meetings are salted, and so many shingles counted as common; these lists are broadcast.
SALTED, COMMON = 8_192, 100_000
#: Rows of one meeting in one task, where no more than SALTED meetings are larger.
BLOCK = 512
#: Words whose hashes a task keeps, each of 64 bytes at most; others are hashed each time.
CACHE = 100_000
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without structure (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(dict):
    """Hash of each word, computed once; a task's own, and of at most CACHE words."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE and len(word) <= 64:
            self[word] = out
        return out


def shingles(text: bytes, known: Words, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased; fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    codes = np.fromiter(map(known.__getitem__, words), U64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, U64)
    for i in range(k):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique(h)


def class_of(hashes: np.ndarray) -> bytes:
    """A 128-bit name of the set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def bits(hashes: np.ndarray) -> np.ndarray:
    """The parity of the set's shingles in each of 2^(band + 1) bits, 64 at least, as bytes."""
    count = max(64, 1 << len(hashes).bit_length())
    at = (mixed(hashes ^ U64(0x2545F4914F6CDD1D)) & U64(count - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=count) & 1).astype(np.uint8), bitorder="little")


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference from two sketches; the longer one is folded, which only cancels bits."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def segments(hashes: np.ndarray) -> np.ndarray:
    """The keys that a set publishes: of its own size band and, where a partner may be larger, of the next."""
    n = len(hashes)
    own = n.bit_length() - 1
    bands = [own, own + 1] if n * 100 // PERCENT >= 1 << (own + 1) else [own]
    place, value = mixed(hashes ^ U64(0x5851F42D4C957F2D)) >> U64(32), mixed(hashes + U64(0x14057B7EF767814F))
    out = []
    for band in bands:
        count = (37 << (band + 1)) // 100 + 16
        at = (place * U64(count)) >> U64(32)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parity = np.bitwise_xor.reduceat(value[order], first)
        fill = np.diff(np.concatenate([first, [n]]))
        keys = mixed(parity ^ mixed(at[first] + U64((band + 1) << 40)))
        need = n // 4 + 1 + n // SPARE
        if len(keys) >= need:
            keys = keys[np.lexsort((keys, -fill))[:need]]
        else:  # too few: equal segments may all be empty ones, so these are published too
            empty = np.setdiff1d(np.arange(count, dtype=U64), at[first])
            keys = np.concatenate([keys, mixed(mixed(empty + U64((band + 1) << 40)))])
        out.append(keys)
    return np.concatenate(out)


def texts(batch: pa.RecordBatch, column: int, rows: int, known: Words) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the shingles of their texts."""
    for part in parts(batch, rows):
        data, _, starts = texts_of(part.column(column))
        yield part, [shingles(bytes(data[a:b]), known) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n, class, sketch`` of each row; n is 0 and class null where there is no word. A task sketches a class once, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, done = Words(), set()
        for batch in batches:
            for rows, got in texts(batch, 1, 1024, known):
                names, sketches = [], []
                for h in got:
                    name = class_of(h) if len(h) else None
                    names.append(name)
                    sketches.append(None if name is None or name in done else bits(h).tobytes())
                    done.add(name)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(h) for h in got], pa.int64()), pa.array(names, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n", "class", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, class binary, sketch binary")


def published(docs: DataFrame) -> DataFrame:
    """``key, hi, lo``: each set's published segments and its class in two numbers; a task publishes a class once, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, done = Words(), set()
        for batch in batches:
            for _, got in texts(batch, 0, 2048, known):
                keys, names = [], []
                for h in got:
                    if len(h) and (name := class_of(h)) not in done:
                        done.add(name)
                        keys.append(segments(h))
                        names.append(name)
                if keys:
                    both = np.repeat(np.frombuffer(b"".join(names), np.int64).reshape(-1, 2), [len(k) for k in keys], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["key", "hi", "lo"])

    return docs.select("text").mapInArrow(run, "key long, hi long, lo long")


def binaries(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """Names of classes from their two numbers."""
    return pa.Array.from_buffers(pa.binary(), len(hi), [None, pa.py_buffer(np.arange(0, 16 * len(hi) + 1, 16, dtype=np.int32)), pa.py_buffer(np.stack([hi, lo], axis=1).tobytes())])


def candidates(keys: DataFrame) -> DataFrame:
    """``a, b, key``: pairs of classes that share a segment, and, where it is hot, class a of hot segment ``key``.

    Rows stream in order of their keys, so a task holds one batch and, of the
    key that goes on in the next batch, HOT rows.
    """

    def out(a: list, b: list | None, key: np.ndarray | None) -> pa.RecordBatch:
        left = binaries(*np.concatenate(a).T)
        right = pa.nulls(len(left), pa.binary()) if b is None else binaries(*np.concatenate(b).T)
        return pa.RecordBatch.from_arrays([left, right, pa.nulls(len(left), pa.int64()) if key is None else pa.array(key)], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, burning = np.zeros((0, 3), np.int64), False  # rows of the last key so far; whether it is hot and some of its rows are out
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
            first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            size = np.diff(np.concatenate([first, [len(rows)]]))
            hot = size > HOT
            if burning:
                hot[0] = True
            whole = np.arange(len(first)) < len(first) - 1
            left, right = [], []
            for n in np.unique(size[whole & ~hot & (size > 1)]).tolist():
                groups = first[whole & ~hot & (size == n)]
                i, j = np.triu_indices(n, 1)
                left.append(rows[(groups[:, None] + i).ravel(), 1:])
                right.append(rows[(groups[:, None] + j).ravel(), 1:])
            if left:
                yield out(left, right, None)
            # a hot key's last row stays, to tell a repeated one in the next batch; the first of it was out before
            last = rows[first[-1] :]
            stays = 1 if hot[-1] else len(last)
            burnt = np.repeat(hot, size)
            if burning and len(first) > 1:
                burning = False
            burnt[len(rows) - stays :] = False
            if burnt.any():
                yield out([rows[burnt, 1:]], None, rows[burnt, 0])
            held, burning = last[len(last) - stays :], bool(hot[-1])
        if burning and len(held):
            yield out([held[:, 1:]], None, held[:, 0])
        elif len(held) > 1:
            i, j = np.triu_indices(len(held), 1)
            yield out([held[i, 1:]], [held[j, 1:]], None)

    return keys.repartition(F.col("key")).sortWithinPartitions("key", "hi", "lo").mapInArrow(run, "a binary, b binary, key long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) that sizes and sketches allow to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = [c.to_pylist() for c in batch.columns[4:]]
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (100 - percent) // (100 + percent)
            ok = [least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= d for x, y, d in zip(*sketch, most.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    of = lambda side: classes.select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(near).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary")


def sets_by_class(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, shingles`` (sorted hashes as bytes) of the ``wanted`` classes, from one text each."""
    ids = classes.join(wanted, "class", "left_semi").select(F.col("_id").alias("of")).distinct()
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = Words()
        for batch in batches:
            for _, got in texts(batch, 0, 512, known):
                yield pa.RecordBatch.from_arrays([pa.array([class_of(h) for h in got], pa.binary()), pa.array([h.tobytes() for h in got], pa.binary())], ["class", "shingles"])

    return found.mapInArrow(run, "class binary, shingles binary").dropDuplicates(["class"])


def same_enough(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) whose sets' similarity is ``percent`` hundredths or more, by the sets themselves."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.withColumnRenamed("class", "a").withColumnRenamed("shingles", "x"), "a")
    return left.join(sets.withColumnRenamed("class", "b").withColumnRenamed("shingles", "y"), "b").select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


#: Lower edges of the size buckets of prefixes, each a twentieth above the last.
EDGES = np.unique(np.ceil(1.05 ** np.arange(600, dtype=np.float64)).astype(np.int64))


def shown(n: int, percent: int = PERCENT) -> list[tuple[int, int, bool]]:
    """Of a set of n shingles: size bucket, how many of its rarest shingles it shows there, and whether as the smaller partner.

    Two sets of m <= n shingles need c = percent (m + n) / (100 + percent) in
    common, so the first m - c + 1 and n - c + 1 of them in one order of all
    shingles meet. The smaller set shows its own for partners of its size or
    more, the larger one shows its own for each size bucket below it.
    """
    own, least = int(np.searchsorted(EDGES, n, "right")) - 1, -(-percent * n // 100)
    out = [(own, n - -(-percent * 2 * n // (100 + percent)) + 1, True)]
    for bucket in range(int(np.searchsorted(EDGES, least, "right")) - 1, own + 1):
        m = max(least, int(EDGES[bucket]))
        out.append((bucket, n - -(-percent * (n + m) // (100 + percent)) + 1, False))
    return out


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key, class, smaller, place``: the rarest shingles of each set, so few that similar sets must share one.

    The order is by how many of ``sets`` hold a shingle, so what many share comes
    last; ``place`` is how many shingles of the set come before. Counts of common
    shingles are broadcast, which are COMMON at most; others meet their rows by a join.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, 1024):
                own = [np.frombuffer(v.as_buffer(), np.int64) for v in rows.column(1)]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), rows.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))], ["shingle", "class"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, 64):
                keys, names, smaller, places = [], [], [], []
                for at, ranked in enumerate(rows.column(1)):
                    df, shingle = (c.to_numpy() for c in ranked.values.flatten())
                    shingle = mixed(shingle.view(U64))
                    shingle = shingle[np.lexsort((shingle, df))]
                    for bucket, length, role in shown(len(shingle), percent):
                        keys.append(mixed(shingle[:length] ^ mixed(np.full(1, bucket + 1, U64))))
                        names.append(np.full(len(keys[-1]), at))
                        smaller.append(np.full(len(keys[-1]), role))
                        places.append(np.arange(len(keys[-1]), dtype=np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), rows.column(0).take(pa.array(np.concatenate(names))), pa.array(np.concatenate(smaller)), pa.array(np.concatenate(places))], ["key", "class", "smaller", "place"])

    rows = sets.mapInArrow(flat, "shingle long, class binary")
    counts = stored(rows.groupBy("shingle").agg(F.count("*").alias("df")), "jaccard-shingles")
    limit = max(1000, (counts.agg(F.sum("df")).first()[0] or 0) // COMMON)
    known = rows.join(F.broadcast(counts.filter(F.col("df") > limit).select("shingle", F.col("df").alias("often"))), "shingle", "left")
    rare = known.filter("often IS NULL").drop("often").join(counts.filter(F.col("df") <= limit), "shingle").select("class", "shingle", "df")
    ranked = rare.unionByName(known.filter("often IS NOT NULL").select("class", "shingle", F.col("often").alias("df")))
    return ranked.groupBy("class").agg(F.collect_list(F.struct("df", "shingle")).alias("ranked")).mapInArrow(first, "key long, class binary, smaller boolean, place int")


def salted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``salt`` and the number of salts of their key: 1, and more where a key has over BLOCK rows.

    Keys of more rows than a share of 1 / SALTED of all are SALTED at most, so their list is broadcast.
    """
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK), "jaccard-meetings")
    block = max(BLOCK, rows.count() // SALTED)
    many = F.broadcast(sizes.filter(F.col("rows") > block).select("key", F.ceil(F.col("rows") / block).cast("int").alias("salts")))
    out = rows.join(many, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return out.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"))


def each_salt(rows: DataFrame) -> DataFrame:
    """Each row once for every salt of its key."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: verified links between classes, enough of them to join all that are similar."""
    found = stored(candidates(published(docs)), "jaccard-candidates")
    pairs = stored(likely(found.filter("b IS NOT NULL").select("a", "b").distinct(), classes), "jaccard-pairs")
    many = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.count("*").alias("h")).join(classes.select("class", "n"), "class").filter(F.col("h") > F.floor(F.col("n") / LIMIT))
    many = stored(many.select("class"), "jaccard-hot")
    discard(found)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(many).distinct()
    sets = stored(sets_by_class(docs, classes, wanted), "jaccard-sets")
    links = stored(same_enough(sets, pairs), "jaccard-links")
    discard(pairs)
    rows = stored(salted(stored(prefixes(sets.join(many, "class", "left_semi")), "jaccard-prefixes")), "jaccard-salted")
    before = None
    for turn in range(ROUNDS + 1):
        of = components(links)
        placed = rows.join(of.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        pivot = F.min(F.when(F.col("smaller"), F.struct("place", F.xxhash64("class", F.lit(turn)), "class", "component")))
        ends = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pivot.alias("p"), F.max("salts").alias("salts"), F.sum(F.col("smaller").cast("long")).alias("small"), F.count("*").alias("rows"))
        ends = stored(ends.filter("lo < hi AND p IS NOT NULL").select("key", "salts", "small", "rows", F.col("p.class").alias("pivot"), F.col("p.component").alias("pivot_component")), "jaccard-meetings")
        work = ends.agg(F.sum(F.col("small") * (F.col("rows") - F.col("small"))).alias("pairs"), F.sum("rows").alias("rows")).first()
        if not work["rows"]:
            discard(ends, of)
            break
        placed = stored(placed.join(each_salt(ends.select("key", "salts", "pivot", "pivot_component")), ["key", "salt"]), "jaccard-open")
        discard(ends, of)
        listed = work["pairs"] <= PAIRS * work["rows"] or turn == ROUNDS or before is not None and 2 * work["rows"] > before
        before = work["rows"]
        if listed:
            other = each_salt(placed.filter("smaller").select("key", "salts", F.col("class").alias("other"), F.col("component").alias("other_component")))
            open_pairs = placed.filter("NOT smaller").join(other, ["key", "salt"]).filter("component <> other_component").select(*pair("class", "other"))
        else:
            open_pairs = placed.filter("component <> pivot_component").select(*pair("class", "pivot"))
        pairs = stored(likely(open_pairs.distinct(), classes), "jaccard-pairs")
        more, old = stored(links.union(same_enough(sets, pairs)), "jaccard-links"), links
        discard(old, pairs, rows)
        links = more
        if listed:
            discard(placed)
            break
        rows = stored(placed.filter("class <> pivot").select("key", "class", "smaller", "place", "salt", "salts"), "jaccard-salted")
        discard(placed)
    discard(sets, many)
    return links


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (doc_id, text).

    A null, empty or wordless text has no shingles and is linked with nothing,
    not even its copies: its component is itself. Rows with equal ids are
    documents of their own. A null id is no component's name; a component of
    null ids alone has a null name. Texts of any length are taken whole. An
    empty table gives an empty result; columns beside doc_id and text are ignored.
    """
    sets = stored(sets_of(docs), "jaccard-classes")
    classes = stored(sets.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("doc_id").alias("_id")), "jaccard-representatives")
    links = links_of(docs, classes)
    of = components(links)
    discard(links)
    placed = classes.join(of.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("_id").alias("component_id"))
    by_class = stored(placed.join(least, "component").select(F.col("class").alias("of"), "component_id"), "jaccard-components")
    discard(of, classes)
    return sets.join(by_class, sets["class"] == by_class["of"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document."""
    return groups(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is their component's least; all columns stay.

    Of rows that share an id and a text one stays; rows without id all do. A text
    without words is a component of its own. An empty table stays empty.
    """
    first = groups(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    # columns travel packed, so none can clash with those of the groups
    packed = docs.select(F.col("doc_id").alias("_of"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = packed.join(first, packed["_of"] == first["_first"], "left_semi").groupBy("_of", "_text").agg(F.first("_row").alias("_row")).select("_row")
    rows = kept.unionByName(packed.filter("_of IS NULL").select("_row"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
