"""Toxicity by maximum-scoring segments.

Words score by their signed log-odds between toxic and clean documents under a
Dirichlet prior, discounted where evidence is thin and a little lowered, so that
clean text falls; a word that training hardly knows takes the score of its
beginning, so inflected and compounded forms count. One linear scan over a document's scores finds every
maximal segment, the passages whose sum can't be raised by moving an end.

In clean text the best of n scores follows an extreme-value law: passages of
score s or more are expected E = K n exp(-lambda s) times. lambda comes from the
scores of clean words and K from the best passages of clean documents. A
document's evidence is the sum of its best passage and -ln E of its significant
ones; passages that speak for clean text, of negated scores, are weighed in the
same way against those of toxic documents. A logistic curve turns all four into
the score. Its slopes never turn against what a side speaks for, so that a few
labelled documents rank too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import parts
from .common import stored, table

#: At most so many labelled documents are learned from: those with the least hashes of their ids.
TRAIN = 20_000
#: Weight of the prior, in documents.
PRIOR = 100.0
#: Documents that must hold a form, and how many standard deviations halve the log-odds of one: z * z / (z * z + DOUBT).
LEAST_COUNT, DOUBT = 5, 40.0
#: What every word's score is lowered by; that of a form that training hardly knows is this alone.
DRIFT = -0.15
#: Lengths of beginnings.
STEMS = (3, 4, 5, 6, 7)
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_"
#: Slope of each kind of evidence before labels are seen, documents that it weighs as much as, and the least that they leave of it.
SLOPE, RIDGE, LEAST_SLOPE = 0.5, 1.0, 0.05
EULER = 0.5772156649015329


def held_out(column: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w.strip(EDGES) for w in (text or "").lower().split()]


def forms(word: str) -> list[str]:
    """A word and its beginnings, marked."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def segments(scores: list[float]) -> list[float]:
    """Sums of all maximal segments of ``scores``, in one pass (Ruzzo and Tompa)."""
    total, stack = 0.0, []  # each: sum before it, sum at its end
    for s in scores:
        before = total
        total += s
        if s <= 0:
            continue
        left, right = before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][2]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, j))
                break
            left = stack[j][0]
            del stack[j:]
    return [right - left for left, right, _ in stack]


@dataclass
class Law:
    """How the best passages of text without any meaning grow with its length."""

    rate: float = 1.0
    scale: float = 1.0

    def evidence(self, n: int, sums: list[float]) -> tuple[float, float]:
        """The best sum, and ln(1 + the sum of -ln E over significant ones)."""
        if not sums:
            return 0.0, 0.0
        log_e = [self.rate * s - np.log(self.scale * max(n, 1)) for s in sums]
        return max(sums), float(np.log1p(sum(x for x in log_e if x > 0)))


def sides(scores: list[float]) -> tuple[list[float], list[float]]:
    """Words' scores for toxic and for clean text: each log-odds or its negative, lowered by DRIFT."""
    return scores, [2 * DRIFT - s for s in scores]


@dataclass
class Model:
    """Scores of known words and beginnings, the laws of toxic passages in clean text and the reverse, and the curve."""

    odds: dict[str, float]
    laws: tuple[Law, Law] = field(default_factory=lambda: (Law(), Law()))
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, SLOPE, SLOPE, -SLOPE, -SLOPE]))
    known: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        """The log-odds of the word or, if it is hardly known, of its most telling beginning, lowered by DRIFT."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            own = self.odds.get(word)
            if own is None:
                own = max((self.odds[f] for f in forms(word)[1:] if f in self.odds), key=abs, default=0.0)
            self.known[word] = own + DRIFT
        return self.known[word]

    def evidence(self, text: str | None) -> tuple[float, ...]:
        """Both numbers of each side. Only where a word scores above zero can a segment be."""
        scores = [self.word(w) for w in words_of(text)]
        both = zip(self.laws, sides(scores), strict=True)
        return tuple(x for law, side in both for x in law.evidence(len(side), segments(side) if any(s > 0 for s in side) else []))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1:] @ self.evidence(text), -30, 30))))


def training(docs: DataFrame, labels: DataFrame, column: str, most: int = TRAIN) -> DataFrame:
    """``text, label, half`` of labelled rows that aren't held out, each distinct text once; labels are conflicting or null: left out.

    The sample is bounded, so its ids are broadcast (16 bytes a row).
    """
    ids = labels.filter(~held_out() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_hi")).filter("label = _hi")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    text = F.coalesce("text", F.lit(""))
    return rows.groupBy(F.xxhash64(text).alias("h")).agg(F.min(F.struct("doc_id", text.alias("text"), "label")).alias("r")).select("r.text", "r.label", F.pmod("h", F.lit(2)).alias("half"))


def log_odds(rows: DataFrame, known: dict[str, float] | None = None, share: float = 1.0) -> dict[str, float]:
    """Signed log-odds of all words that LEAST_COUNT documents hold, from ``text, label``; given ``known`` words, of the beginnings of all others.

    The prior draws them to those of the sample, and what little evidence says is
    discounted. Their number is bounded by the sample. A ``share`` below 1 asks for
    less of each: a few documents can't meet what many can.
    """
    prior, doubt, least = PRIOR * share, DOUBT * max(share, 0.25), max(2, round(LEAST_COUNT * share))

    def told_by(word: str) -> list[str]:
        return [word] if known is None else [] if word in known else forms(word)[1:]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {"": [0, 0]}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[""][label] += 1
                for form in {f for w in set(words_of(text)) if w for f in told_by(w)}:
                    seen.setdefault(form, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["form", "clean", "toxic"])

    counts = stored(rows.select("text", "label").mapInArrow(count, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "form-counts")
    n = counts.filter("form = ''").agg(F.sum("clean"), F.sum("toxic")).first()
    n0, n1 = n[0] or 0, n[1] or 0
    if not n0 or not n1:
        return {}
    p = (F.col("clean") + F.col("toxic")) * (prior / (n0 + n1))
    odds = lambda y, total: F.log((y + p) / (total + prior - y - p))
    told = counts.filter(F.col("clean") + F.col("toxic") >= least).filter("form <> ''").select("form", (odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)).alias("d"), F.sqrt(1 / (F.col("toxic") + p) + 1 / (F.col("clean") + p)).alias("sd"))
    z2 = (F.col("d") / F.col("sd")) ** 2
    return {r["form"]: r["score"] for r in told.select("form", (F.col("d") * z2 / (z2 + doubt)).alias("score")).toLocalIterator()}


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the first without input, by Newton's method with halved steps; drawn to ``start``, and a slope keeps its sign.

    A slope that would pass LEAST_SLOPE is held there, and the others are fitted again.
    """
    a = np.column_stack([np.ones(len(x)), x])
    sign, pull = np.concatenate([[0], np.sign(start[1:])]), np.concatenate([[1e-2], np.full(len(start) - 1, ridge)])
    w, free = np.zeros(len(start)), np.ones(len(start), bool)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)).sum() + pull @ (w - start) ** 2 / 2)

    while True:
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            b = a[:, free]
            step = np.zeros(len(w))
            step[free] = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + np.diag(pull[free]), (a.T @ (p - y) + pull * (w - start))[free])
            while np.abs(step).max() >= 1e-8 and loss(w - step) > loss(w):
                step /= 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        against = free & (sign * w < LEAST_SLOPE) & (sign != 0)
        if not against.any():
            return w
        free &= ~against
        w[against] = sign[against] * LEAST_SLOPE


def extreme_law(hist: dict[float, int], best: list[tuple[int, float]]) -> tuple[float, float]:
    """lambda with a mean of exp(lambda s) of 1 over clean words' scores, and K from clean documents' best sums."""
    s, n = np.array(list(hist)), np.array(list(hist.values()), float)
    p = n / n.sum() if len(n) else n
    if not len(s) or not (s > 0).any() or p @ s >= 0:
        return 1.0, 1.0
    low, high = 1e-9, 1.0
    while p @ np.exp(high * s) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    rate = high
    # the mean of lambda * best - ln(K n) is Euler's number in clean text
    gaps = [rate * b - np.log(max(words, 1)) for words, b in best]
    return rate, float(np.exp(np.clip(np.mean(gaps) - EULER, -20, 20))) if gaps else 0.1


def odds_of(rows: DataFrame) -> Model:
    """A model that knows the words of ``text, label`` and the beginnings of others."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, min(n.get(0, 0), n.get(1, 0)) / PRIOR)
    words = log_odds(rows, share=share)
    return Model(log_odds(rows, words, share) | words)


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """Word scores from one half of the sample, the laws and the curve from the other half.

    Where a half has under PRIOR documents of a label, word scores are from the
    whole sample, the laws and the curve from what each half's words say of the other.

    What repeats, and labels that conflict or are null, are as ``training`` says;
    texts are read whole, a null text is empty, and rows without an id are in no
    sample. Of equal hashes of ids the smaller id comes first.
    """
    rows = stored(training(docs, labels, column), "toxicity-sample")
    full = {(r["half"], r["label"]) for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= PRIOR).collect()}
    tried = [(odds_of(rows.filter(F.col("half") == h)), rows.filter(F.col("half") == 1 - h).select("text", "label")) for h in ((0,) if len(full) == 4 else (0, 1))]
    model = tried[0][0] if len(tried) == 1 else odds_of(rows)

    def scan(by: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Length and best sum of each text on the side against its label (kind 0: toxic passages, 1: clean ones) and, a task, how often each score occurs there (kind 2, 3)."""
        hist: dict[tuple[int, float], int] = {}
        for batch in batches:
            words, best = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = sides([by.word(w) for w in words_of(text)])[label]
                for s in scores:
                    key = (label + 2, round(s, 1))
                    hist[key] = hist.get(key, 0) + 1
                words.append(len(scores))
                best.append(max(segments(scores), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(words, pa.int64()), pa.array(best, pa.float64())], ["kind", "n", "value"])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hist], pa.int32()), pa.array(list(hist.values()), pa.int64()), pa.array([s for _, s in hist], pa.float64())], ["kind", "n", "value"])

    def weigh(by: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([by.evidence(t) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *(pa.array(c) for c in x.T)], ["label", "best", "all", "clean_best", "clean_all"])

    # what reaches the driver are a few numbers a text of the bounded sample
    told = [r for by, other in tried for r in other.mapInArrow(partial(scan, by), "kind int, n long, value double").collect()]
    for side, law in enumerate(model.laws):
        hist: dict[float, int] = {}
        for r in told:
            if r.kind == side + 2:
                hist[r.value] = hist.get(r.value, 0) + r.n
        if model.odds:  # one word more than was seen, so that a sample without any that speaks for this side has a law too
            usual = round(float(np.mean([s for s in sides([d + DRIFT for d in model.odds.values()])[side] if s > 0] or [1.0])), 1)
            hist[usual] = hist.get(usual, 0) + 1
        law.rate, law.scale = extreme_law(hist, [(r.n, r.value) for r in told if r.kind == side and r.value > 0])
    for by, _ in tried:
        by.laws = model.laws
    seen = [r for by, other in tried for r in other.mapInArrow(partial(weigh, by), "label int, best double, all double, clean_best double, clean_all double").collect()]
    x, y = np.array([r[1:] for r in seen]).reshape(-1, 4), np.array([r.label for r in seen])
    if 0 < y.sum() < len(y):
        order = np.lexsort((*x.T[::-1], y))
        model.curve = logistic(x[order], y[order], model.curve)
    model.known = {}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, texts whole; a null text is scored as an empty one.

    Repeated rows score alike; an empty table gives an empty result; without
    labels of both kinds no word has evidence and all scores are low.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, 1024):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([model.score(t) for t in rows.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
