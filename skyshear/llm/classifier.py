"""A quality classifier from positive and unlabelled documents.

Labels name trusted good documents; other web text is unlabelled, part of it
good. With the share p of good documents among unlabelled ones, the risk on
negatives is that of unlabelled documents as negatives less p times that of
positives as negatives. A flexible model drives this estimate below zero, which
no risk can be, so its negative part is cut off (non-negative unbiased risk).
p is estimated first: a plain positive-against-unlabelled model ranks both, and
the least ratio of their shares above a threshold bounds p from above.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import parts
from .common import stored, table
from .quality import CLASSES, SYMBOLS, base_counts, classes
from .toxicity import held_out

#: At most so many positives and so many unlabelled documents are learned from: those with the least hashes of their ids.
TRAIN = 20_000
#: Hidden units, steps, rows a step of each kind, learning rate, weight decay.
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1500, 1024, 0.01, 1e-4
#: Scores from here on are predicted to be good.
THRESHOLD = 0.3
END = frozenset(".!?,;:")


def features(text: str | None) -> list[float]:
    """Shares and counts that describe a text's form, none of its meaning; null is empty."""
    text = text or ""
    chars = classes(text)
    n, dup, repeated = base_counts(text)
    words = text.split()
    often = Counter(words)
    total, m = max(1, int(chars.sum())), max(1, len(words))
    lines = max(1, text.count("\n") + 1)
    bare = sum(k for w, k in often.items() if not any(c.isalnum() for c in w))
    marked = sum(k for w, k in often.items() if len(w) > 1 and w[-1] in SYMBOLS)
    loud = sum(k for w, k in often.items() if w.endswith("!!") or len(w) > 3 and w.isupper())
    ended = sum(k for w, k in often.items() if w[-1] in END)
    return [
        *(chars / total).tolist(),
        np.log1p(n),
        float(sum(len(w) * k for w, k in often.items()) / m) / 10,
        len(often) / m,
        max(often.values(), default=0) / m,
        sum(k for _, k in often.most_common(8)) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        repeated / m,
        dup / lines,
        bare / m,
        marked / m,
        loud / m,
        ended / m,
        np.log1p(m / lines),
    ]


WIDTH = CLASSES + 13


@dataclass
class Model:
    """A network of one hidden layer over standardised features, and the class prior."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        a, b, c, d = self.layers
        return (np.tanh(z @ a + b) @ c + d)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> Model:
    """Minimises the non-negative risk for ``prior``; without one, the plain risk of positive against unlabelled."""
    rng = np.random.default_rng(seed)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    layers = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, STEPS + 1):
        x = np.concatenate([p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]])
        h = np.tanh(x @ layers[0] + layers[1])
        g = (h @ layers[2] + layers[3])[:, 0]
        s = sigmoid(g)
        if prior is None:
            slope = np.concatenate([s[:BATCH] - 1, s[BATCH:]]) / BATCH
        else:
            as_negative = np.logaddexp(0, g)
            risk = as_negative[BATCH:].mean() - prior * as_negative[:BATCH].mean()
            negative = np.concatenate([-prior * s[:BATCH], s[BATCH:]]) / BATCH
            positive = np.concatenate([prior * (s[:BATCH] - 1), np.zeros(BATCH)]) / BATCH
            slope = positive + negative if risk >= 0 else -negative
        back = (slope[:, None] @ layers[2].T) * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ slope[:, None], slope.sum(keepdims=True)]
        rate = RATE * (1 - step / (STEPS + 1))
        for i, grad in enumerate(grads):
            grad = grad + DECAY * layers[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, layers, prior if prior is not None else float("nan"))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the least ratio of shares above a threshold, where its error is small."""
    cuts = np.quantile(pos, np.linspace(0.02, 0.98, 97))
    q_p = np.array([(pos >= c).mean() for c in cuts])
    q_u = np.array([(unl >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / (2 * len(unl))) + np.sqrt(np.log(40) / (2 * len(pos)))
    best = int(np.argmin((q_u + slack) / np.maximum(q_p, 1e-9)))
    return float(np.clip(q_u[best] / max(q_p[best], 1e-9), 0.05, 0.98))


def described(docs: DataFrame, *extra: str) -> DataFrame:
    """``extra`` columns and ``x``, the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, 1024):
                x = [features(t) for t in rows.column(len(extra)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(extra)], pa.array(x, pa.list_(pa.float64()))], [*extra, "x"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return docs.select(*extra, "text").mapInArrow(run, f"{fields}x array<double>")


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = TRAIN) -> Model:
    """The model from a bounded sample: positives (label 1) and documents without any label, held-out ids in neither.

    Repeated labels count once; an id labelled both 1 and 0 counts as positive,
    one labelled null has no label, a null id is in no sample. Rows that share an
    id are all in it. Of equal hashes of ids the smaller id comes first. Texts
    are read whole, a null text is empty. Without positives or without documents
    that have no label, as in an empty table, all documents score alike.
    """
    known = labels.filter(F.col(column).isNotNull())
    positive = known.filter(~held_out() & (F.col(column) == 1)).groupBy("doc_id").agg(F.lit(1).alias("kind"))
    free = docs.filter(~held_out()).select("doc_id").distinct().join(known.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("kind", F.lit(0))
    pick = lambda ids: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = stored(pick(positive).unionByName(pick(free)), "quality-sample").withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    got = described(rows, "doc_id", "kind").drop("text").orderBy("doc_id").collect()
    x, kind = np.array([r.x for r in got]).reshape(-1, WIDTH), np.array([r.kind for r in got], dtype=int)
    pos, unl = x[kind == 1], x[kind == 0]
    if not len(pos) or not len(unl):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros((1, 1)), np.array([2.0 if len(pos) else 0.0])], 0.5)
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    plain = fit(pos[::2], unl[::2], None, mean, scale)
    prior = estimate_prior(plain.logits(pos[1::2] if len(pos) > 1 else pos), plain.logits(unl[1::2] if len(unl) > 1 else unl))
    return fit(pos, unl, prior, mean, scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, texts whole; a null text is scored as an empty one.

    Repeated rows score alike; an empty table gives an empty result; without
    positives or without unlabelled rows all scores are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, 1024):
                x = np.array([features(t) for t in rows.column(1).to_pylist()]).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
