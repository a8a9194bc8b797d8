"""Fingerprints against a plain version, their likeness against whole sets, and hard rows."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from skyshear.llm import fingerprints

SCHEMA = "doc_id long, text string, mark string, `_run` int, `_sent` int, changed string, next_text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:2] for _ in range(n))


def brute_hashes(text):
    h = [xxhash.xxh64_intdigest(w, seed=42) for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    out = []
    for i in range(len(h) - 4) if len(h) >= 5 else [0] if h else []:
        seed = 42
        for x in h[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=seed)
        out.append(seed)
    return set(out)


def brute_mark(text, fraction=0.25):
    found = brute_hashes(text)
    return sorted(x for x in found if x < fraction * 2**64) or sorted(found)[:1]


def rows_of(seed=1):
    rng = random.Random(seed)
    rows = [(i * 7, prose(rng, rng.randint(1, 120))) for i in range(80)]
    rows += [(561 + i, rows[3][1]) for i in range(5)]  # copies
    rows += [(600, None), (601, ""), (602, " \n\t "), (603, "one"), (604, "ONE"), (605, "a b c d"), (606, "é\U0001f600x" * 500), (607, prose(rng, 9000)), (610, "tail " * 3000), (-(2**62), "far away indeed it is"), (None, "no id at all in here"), (603, "one"), (603, "two")]
    return rows


def spread(rows):
    return [(*r, "m", 1, 2, "c", "n") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(spread(rows_of()), SCHEMA).repartition(3)


def brute_followed(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    return [(i, t, rows[(n + 1) % len(rows)][1]) for n, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("run", [1, 3, 512])
def test_every_document_meets_the_next_one(docs, monkeypatch, run):
    monkeypatch.setattr(fingerprints, "RUN", run)
    got = sorted(((r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.followed(docs).select("doc_id", "text", "next_text").collect()), key=repr)
    assert got == sorted(brute_followed(rows_of()), key=repr)


def test_fingerprints_equal_brute_force(docs):
    for r in fingerprints.followed(docs).select("text", "mark", "next_text", "next_mark").collect():
        assert [x % 2**64 for x in sorted(r["mark"])] == brute_mark(r["text"])
        assert sorted(x % 2**64 for x in r["next_mark"]) == brute_mark(r["next_text"])


def test_query_equals_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "table", lambda *_: docs)
    got = fingerprints.op12_fingerprints(spark, "").collect()
    want = []
    for i, text, after in brute_followed(rows_of()):
        part = len(text) // 3
        new = text[: len(text) - part] + after[:part]
        a, b, c = (set(brute_mark(x)) for x in (text, new, after))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        hexed = lambda x: "".join(f"{h:016x}" for h in sorted(x))
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), hexed(a), hexed(b), round(like(a, b), 12), round(like(a, c), 12)))
    rows = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (21, 561, 562, 563, 564, 565)}) == 1  # equal texts


def test_unequal_texts_keep_their_containment(spark):
    rng = random.Random(3)
    long = [f"w{rng.random()}" for _ in range(20_000)]
    part = long[5000:6000]
    a, b = (fingerprints.sketch(F.col(c)) for c in "ab")
    row = spark.createDataFrame([(" ".join(part), " ".join(long))], "a string, b string").select(fingerprints.containment(a, b).alias("c"), fingerprints.containment(b, a).alias("d"), fingerprints.resemblance(a, b).alias("r")).first()
    assert row["c"] == 1.0 and abs(row["d"] - 0.05) < 0.01 and abs(row["r"] - 0.05) < 0.01


def test_union_of_fingerprints_is_that_of_the_sets(spark):
    rng = random.Random(4)
    texts = [(prose(rng, rng.choice([0, 1, 3, 5, 6, 8, 300])), prose(rng, rng.choice([0, 1, 5, 7, 300]))) for _ in range(60)]
    a, b = (fingerprints.sketch(F.col(c)) for c in "ab")
    got = spark.createDataFrame(texts, "a string, b string").select("a", "b", fingerprints.merged(a, b).alias("m")).collect()
    for r in got:
        both = brute_hashes(r["a"]) | brute_hashes(r["b"])
        assert sorted(x % 2**64 for x in r["m"]) == (sorted(x for x in both if x < 2**62) or sorted(both)[:1])


def test_small_and_empty_tables(spark, docs):
    assert fingerprints.followed(docs.filter("false")).count() == 0
    one = fingerprints.followed(docs.filter("doc_id = 605")).first()
    assert (one["text"], one["next_text"]) == ("a b c d", "a b c d")
    only = fingerprints.followed(docs.filter("doc_id is null")).first()
    assert only["next_text"] == "no id at all in here"
    with pytest.raises(ValueError, match="fraction"):
        fingerprints.limit_of(0.7)
