"""Quality rules by distribution divergence.

Each language has a reference: how its characters divide into classes and its
words into the language's most common words and the rest. A document is
compared with its language's reference by the Jensen-Shannon distance of either
histogram. References come from the corpus: from all documents long enough and
not repetitive, then once more from those that agree with the first version, so
that junk leaves no mark on them. Short documents give noisy histograms, so
below a least length no verdict is passed, and the limits widen with one over
the root of the length.

A language's common words are the COMMON most frequent ones among those that
make up SHARE of its words. They are found exactly in two passes: the corpus
falls into blocks, and a word with that share of all has it in one block at
least, so each block names its candidates; then candidates are counted over all
documents. The result doesn't depend on how documents are dealt to tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import forget, parts
from .common import discard, stored, table

SYMBOLS = "#*$%&|<>"
#: Character classes, by number: lower, upper, digit, white space, symbol, punctuation, others.
CLASSES = 7
LOWER, UPPER, DIGIT, SPACE, SYMBOL, POINT, OTHER = range(CLASSES)
#: Words of a language in its histogram, and the least share of its words that one of them makes up.
COMMON, SHARE = 32, 1e-3
#: A language with this share of all words has a reference, so there are 1,000 at most; null is a language of its own.
LANGUAGE_SHARE = 1e-3
#: Words of a block, in which candidates are counted.
BLOCK = 2_000_000
#: Up to so many candidates are broadcast; beyond, all words are counted.
CANDIDATES = 200_000
#: Fewer words get no verdict from the method.
LEAST_WORDS = 50
#: Largest distances of a good document, and what is added for n words: SLACK / sqrt(n).
CHAR_LIMIT, WORD_LIMIT, SLACK = 0.28, 0.40, 0.20


def _class_table() -> np.ndarray:
    out = np.full(0x3000, OTHER, dtype=np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c == " " or "\t" <= c <= "\r":
            out[code] = SPACE
        elif c in SYMBOLS:
            out[code] = SYMBOL
        elif c.islower():
            out[code] = LOWER
        elif c.isupper():
            out[code] = UPPER
        elif c.isdigit():
            out[code] = DIGIT
        elif code < 128 and c.isprintable():
            out[code] = POINT
    return out


CLASS_OF = _class_table()


def classes(text: str) -> np.ndarray:
    """Characters of each class."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.bincount(CLASS_OF[np.minimum(codes, 0x2FFF)], minlength=CLASSES)


def base_counts(text: str) -> tuple[int, int, int]:
    """n_words, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        often = Counter(triples)
        hit = np.fromiter((often[t] > 1 for t in triples), dtype=bool, count=len(triples))
        covered = np.zeros(len(words), dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(hit)] |= hit
        repeated = int(covered.sum())
    return len(words), len(lines) - len(set(lines)), repeated


def block_counts(docs: DataFrame, share: float, only: dict[str, set[str]] | None = None) -> DataFrame:
    """``lang, word, n`` of each block of ``docs`` and language: its words of at least ``share``, or those in ``only``; all its words under a null word."""

    def out(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = []
        for lang, own in counts.items():
            total = own.total()
            rows.append((lang, None, total))
            if only is None:
                rows += [(lang, w, n) for w, n in own.items() if n >= share * total]
            else:
                rows += [(lang, w, own[w]) for w in only.get(lang, ()) if w in own]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").lower().split()
                counts.setdefault(lang or "", Counter()).update(words)
                held += len(words)
                if held >= BLOCK:
                    yield out(counts)
                    counts, held = {}, 0
        yield out(counts)

    return docs.select("text", "lang").mapInArrow(count, "lang string, word string, n long")


def vocabularies(docs: DataFrame) -> dict[str, list[str]]:
    """The common words of each language with LANGUAGE_SHARE of all words; null is the language of an empty name."""
    summed = lambda rows: stored(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")), "common-words")
    found = summed(block_counts(docs, SHARE))
    totals = {r["lang"]: r["n"] for r in _enough(found).toLocalIterator()}
    some = F.broadcast(_enough(found).withColumnRenamed("n", "total"))
    candidates = found.filter("word IS NOT NULL").join(some, "lang")
    if candidates.count() <= CANDIDATES:
        only: dict[str, set[str]] = {lang: set() for lang in totals}
        for r in candidates.select("lang", "word").toLocalIterator():
            only[r["lang"]].add(r["word"])
        words = summed(block_counts(docs, 0.0, only))
    else:
        words = summed(block_counts(docs, 0.0))
    # a share of SHARE leaves 1 / SHARE rows of a language at most, so the window is small
    often = words.filter("word IS NOT NULL").join(some, "lang").filter(F.col("n") >= SHARE * F.col("total"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = often.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= COMMON)
    out: dict[str, list[str]] = {lang: [] for lang in totals}
    for r in top.orderBy("lang", "rank").toLocalIterator():
        out[r["lang"]].append(r["word"])
    discard(found, words)
    return out


def _enough(found: DataFrame) -> DataFrame:
    """``lang, n``: languages with LANGUAGE_SHARE of all words, 1 / LANGUAGE_SHARE at most."""
    everything = found.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    return found.filter(F.col("word").isNull() & (F.col("n") > 0) & (F.col("n") >= LANGUAGE_SHARE * everything)).select("lang", "n")


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, key string, chars array<long>, words array<long>"


def features(text: str | None, lang: str | None, common: dict[str, dict[str, int]]) -> tuple:
    """The values of FEATURES of one text; null is a text without words."""
    text = text or ""
    chars = classes(text)
    n, dup, repeated = base_counts(text)
    key = lang or ""
    places = common.get(key, {})
    words = [0] * (COMMON + 1)
    for w, k in Counter(text.lower().split()).items():
        words[places.get(w, COMMON)] += k
    return n, int(len(text) - chars[SPACE]), int(chars[SYMBOL]), dup, repeated, n < 50 or 100 * repeated > 50 * n, key, chars.tolist(), words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of rows of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


@dataclass
class References:
    """For each key: common words with their places, class shares, common-word shares."""

    common: dict[str, dict[str, int]]
    shares: dict[str, tuple[np.ndarray, np.ndarray]]

    def distances(self, key: str, chars: list, words: list) -> tuple[float, float]:
        """Of classes and of words; 0, so no objection, without a reference or a text."""
        if key not in self.shares or not sum(chars) or not sum(words):
            return 0.0, 0.0
        c, w = self.shares[key]
        return float(distance(np.array(chars) / sum(chars), c)), float(distance(np.array(words) / sum(words), w))

    def agrees(self, n_words: int, char_distance: float, word_distance: float) -> bool:
        """The method's verdict."""
        if n_words < LEAST_WORDS:
            return True
        slack = SLACK / n_words**0.5
        return char_distance <= CHAR_LIMIT + slack and word_distance <= WORD_LIMIT + slack


def featured(docs: DataFrame, common: dict[str, dict[str, int]]) -> DataFrame:
    """``doc_id`` and FEATURES of each row, one scan of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for rows in parts(batch, 1024):
                got = [features(t, lang, common) for t, lang in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]
                columns = list(zip(*got, strict=True)) if got else [[] for _ in range(9)]
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [x.split()[0] for x in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FEATURES}")


def shares(rows: DataFrame, keys: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms by key, of ``keys`` alone; one row a key reaches the driver, 1,000 at most."""
    mean = lambda column, n: [F.avg(F.col(column)[i] / F.col(f"{column}_sum")).alias(f"{column}{i}") for i in range(n)]
    add = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumn("chars_sum", add("chars")).withColumn("words_sum", add("words"))
    out = {}
    rows = rows.filter(F.col("key").isin(keys)) if keys else rows.limit(0)
    for r in rows.groupBy("key").agg(*mean("chars", CLASSES), *mean("words", COMMON + 1)).toLocalIterator():
        c, w = (np.array([round(r[f"{name}{i}"], 6) for i in range(n)]) for name, n in (("chars", CLASSES), ("words", COMMON + 1)))
        out[r["key"]] = (c / c.sum(), w / w.sum())
    return out


def learn(docs: DataFrame) -> tuple[References, DataFrame]:
    """References of ``docs`` (doc_id, text, lang), and the stored features of its rows.

    A null text has no words; a null lang is a language of its own. Repeated rows
    count as often as they stand there. Texts of any length are taken whole. An
    empty table gives no reference and no rows; extra columns are ignored.
    """
    common = {lang: {w: i for i, w in enumerate(ws)} for lang, ws in vocabularies(docs).items()}
    rows = stored(featured(docs, common), "quality-features")
    fit = rows.filter(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS))
    first = References(common, shares(fit, list(common)))
    agreeing = judged(fit, first).filter("agrees")
    again = shares(agreeing, list(common))
    return References(common, first.shares | again), rows


def judged(rows: DataFrame, references: References) -> DataFrame:
    """``rows`` with ``char_distance, word_distance, agrees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            pick = lambda name: batch.column(at[name]).to_pylist()  # noqa: B023, E731
            both = [references.distances(*x) for x in zip(pick("key"), pick("chars"), pick("words"), strict=True)]
            ok = [references.agrees(n, *d) for n, d in zip(pick("n_words"), both, strict=True)]
            extra = [pa.array([d[0] for d in both], pa.float64()), pa.array([d[1] for d in both], pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "char_distance", "word_distance", "agrees"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, char_distance double, word_distance double, agrees boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, both distances and the verdict for each document, repeated ones each; documents without a reference are judged by the base rules alone."""
    references, rows = learn(table(spark, sf_dir, "documents"))
    return judged(rows, references).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("agrees")).alias("kept"), "char_distance", "word_distance"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns.

    A null text or one under 50 words goes, as the base rules say; a language of
    too few words for a reference passes by these alone. Rows are judged one by
    one, so repeated ones fare alike; an empty table stays empty.
    """
    references, rows = learn(docs)
    discard(rows)
    names = docs.columns
    text_at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for rows in parts(batch, 1024):
                mask = []
                for text, lang in zip(rows.column(text_at).to_pylist(), rows.column(lang_at).to_pylist(), strict=True):
                    n, _, _, _, _, failed, key, chars, words = features(text, lang, references.common)
                    mask.append(not failed and references.agrees(n, *references.distances(key, chars, words)))
                yield rows.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
