"""Corpus operators on hard rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; results against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyshear.llm import bpe, classifier, common, jaccard, mixing, neighbours, pages, quality, secrets, tokenfile, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, spans string, `row` int, key int, copies int, label int, `of` int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:2] for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(60, 160)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "b", "c"])) for i in range(60)]
    base = prose(rng, 200).split()
    for i in range(60, 100):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(200)] = f"edit{rng.random()}"
        rows.append((i, " ".join(copy), "en", "a"))
    rows += [(100 + i, rows[0][1], "en", "a") for i in range(20)]  # exact copies
    rows += [
        (200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "en", None), (203, "one", "en", "a"), (204, "One", "en", "a"), (205, "one two three", None, "b"),
        (206, "x" * 20_000, "en", "a"), (207, prose(rng, 9000), "en", "c"), (208, "tail ", "en", "a"), (209, "a  b 　 c  d <|endoftext|> e", "en", "a"), (None, "no id at all", "en", "a"), (203, "one", "en", "a"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), "x", "y", 1, 2, 3, 4, 5) for r in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_encoding_is_exact_and_round_trips(docs, none, tokenizer):
    expected = Counter()
    for doc_id, text, *_ in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == expected
    assert bpe.digests(none).count() == 0


def test_chunks_of_shared_passages_are_shared():
    rng = random.Random(1)
    shared = prose(rng, 800)

    def own(prefix):
        data = np.frombuffer((prefix + " " + shared).encode(), np.uint8)
        cuts = next(bpe.chunks(memoryview(data.tobytes()), data, np.array([0, len(data)])))
        return {data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    assert len(own("some other start") & own(prose(rng, 50))) >= 5


def test_token_files(spark, docs, none, tokenizer, tmp_path):
    to = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, to)
    got = sorted(map(tuple, tokenfile.crc_of_ids(tokenfile.read_tokens(spark, to)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in corpus()), key=lambda x: (x is not None, x))
    start, texts = 0, {r[0]: r[1] for r in corpus()}
    for doc_id, at, n, crc in got:
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert tokenfile.read_index(spark, to).agg(F.sum("n_tokens")).first()[0] == start
    tokenfile.write_tokens(none, str(tmp_path / "none"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_columns_are_encoded_by_their_distinct_words(tokenizer, monkeypatch):
    """Exact on odd texts, sliced columns and short stretches; a word that many texts repeat is looked up once a stretch."""
    import pyarrow as pa

    rng = random.Random(12)
    odd = [None, "", " ", "  a", "a ", "a\n b", "\u3000 x", "x \u3000 y", "don't 's", "<|endoftext|> z", "é.\nÜber## \n", "tail \n", "word\u00a0 word", *(r[1] for r in corpus()[-12:])]
    texts = odd + ["".join(rng.choice(["ab", "É", " ", " ", "  ", "\n", "!!", "'", "\u2003", "9", "日本", "Word"]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"]).slice(1)
    own, size = bpe.Codec(bpe.tokenizer_path()), bpe.STRETCH
    for bpe_stretch in (size, 300):
        monkeypatch.setattr(bpe, "STRETCH", bpe_stretch)
        got = []
        for rows, ids, counts in own.stretches(batch, 1):
            ends = np.cumsum(counts).tolist()
            got += [(i, ids[b - n : b].tolist()) for i, b, n in zip(rows.column(0).to_pylist(), ends, counts.tolist(), strict=True)]
        assert got == [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts) if i]
    looked = []
    monkeypatch.setattr(bpe.Cache, "get", lambda self, w, *a: looked.append(w) or dict.get(self, w, *a), raising=False)
    bpe.Codec(bpe.tokenizer_path()).encode_column(pa.array(["again and again"] * 500))
    assert looked.count(b"and") == 1


def test_texts_are_cut_wherever_the_pretokenizer_splits(tokenizer, monkeypatch):
    """A word with marks or at a line's end is no other word, and white space in a row leaves the rest of a text to the cache; exact across the edges of what is gathered."""
    import pyarrow as pa

    looked, whole = [], []
    monkeypatch.setattr(bpe.Cache, "get", lambda self, w, *a: looked.append(w) or dict.get(self, w, *a), raising=False)
    encoded = bpe.Codec.whole
    monkeypatch.setattr(bpe.Codec, "whole", lambda self, text: whole.append(text) or encoded(self, text))
    for _ in bpe.Codec(bpe.tokenizer_path()).stretches(pa.RecordBatch.from_arrays([pa.array(["one and, and. and!! (and) and\nand.\n and 12and  and " * 50])], ["text"]), 0):
        pass
    assert looked.count(b"and") == 2  # after a space, and elsewhere
    assert max(map(len, whole)) < 20

    rng = random.Random(3)
    some = ["ab", "É", "×", "\u01bb", " ", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\u00a0", "\u2009", "\u201d", "\u3000", "!!", "'", "'s", "'re", "9", "½", "日本", "Слово", "\u0301", "<|endoftext|>", "<|", "\U0001f642"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    monkeypatch.setattr(bpe, "GATHERED", 200)
    own, got = bpe.Codec(bpe.tokenizer_path()), []
    for _, ids, counts in own.stretches(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 0):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def brute_groups(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    least = {}
    for n, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(n)] = min(doc_id, least.get(find(n), doc_id))
    return Counter((doc_id, len(s), least.get(find(n)) if s else doc_id) for n, (doc_id, s) in enumerate(sets))


@pytest.mark.parametrize("hot", [16, 2])
def test_groups_match_brute_force(docs, none, monkeypatch, hot):
    """With a low limit nearly all segments are hot, which is the path by rare shingles and pivots."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    if hot == 2:
        monkeypatch.setattr(jaccard, "LIMIT", 10**9)
        monkeypatch.setattr(jaccard, "BLOCK", 8)  # meetings are salted
    assert Counter(map(tuple, jaccard.groups(docs).collect())) == brute_groups(corpus())
    if hot == 16:
        assert jaccard.groups(none).count() == 0


def test_one_of_each_group_stays(docs):
    kept = jaccard.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(set(ids)) == len(ids) and not {101, 110} & set(ids) and {0, 200, 201, None} <= set(ids)


def test_pivot_path_on_chains_and_passages(spark):
    """Texts around one long passage, some of them alike, in sizes that cross bands."""
    rng = random.Random(9)
    passage, rows = prose(rng, 60).split(), []
    for i in range(70):
        own = prose(rng, rng.choice([8, 12, 20, 40])).split()
        rows.append((i, " ".join(passage + own)))
    for i in range(70, 100):
        words = rows[rng.randrange(len(rows))][1].split()
        words[rng.randrange(len(words))] = f"e{i}"
        rows.append((i, " ".join(words)))
    got = Counter(map(tuple, jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_groups(rows)


def test_quality_counts_and_verdicts(docs, none):
    rows = {r.doc_id: r for r in quality_rows(docs)}
    assert (rows[200].n_words, rows[200].base_failed, rows[200].kept) == (0, True, False)
    assert rows[206].n_words == 1 and rows[206].word_chars == 20_000
    assert quality.base_counts("a b c\na b c\n\nx a b c") == (10, 1, 9)
    assert quality.base_counts("a a a a") == (4, 0, 4)
    assert len(quality_rows(none)) == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}


def quality_rows(docs):
    references, rows = quality.learn(docs)
    return quality.judged(rows, references).withColumn("kept", ~F.col("base_failed") & F.col("agrees")).collect()


def test_junk_of_other_distribution_goes(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 120), "en") for i in range(80)] + [(100 + i, " ".join(w + "###" for w in prose(rng, 120).split()), "en") for i in range(5)] + [(200, prose(rng, 120).upper(), "en")]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(80))


def test_secret_spans_and_masking(spark, none):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [f"é token = 'abcdef' x", "Token:short", "hex 0123456789abcdef01234567 end", f"key {key}", f"{key}{key} secret=aaaaaa=bb", None, "", "password = \"hunter22\" password=x PASSWD=zzzzzz9", f"token={key}"]
    df = spark.createDataFrame([(i, t, "keep", None if t is None else len(t)) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, spans string, n_chars long")
    ledger = secrets.scan(df)
    got = {r.doc_id: r.s for r in secrets.findings_by_path(df.drop("spans"), ledger).select("doc_id", secrets.written(F.col("spans")).alias("s")).collect()}
    assert got[0] == got[9] == "assign:2:17" and got[1] == got[5] == got[6] == "" and got[2] == "hex:4:28" and got[3] == "access:4:24"
    assert got[8] == "assign:0:26,access:6:26"
    assert secrets.scan(df, ledger).count() == 0 and secrets.scan(df, ledger, version=2).count() == ledger.count()
    clean = secrets.without_secrets(df)
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == df.columns and rows[0].text == "é <assign>' x" and rows[0].n_chars == len("é <assign>' x") and rows[5].text is None and rows[0].spans == "keep"
    assert secrets.scan(none).count() == 0


def test_mix_meets_targets(docs, none, duck):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus()) and all(r.copies <= 3 for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(r.size for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    twice = mixing.repeat(docs)
    assert twice.columns == docs.columns
    most = {}
    for r in rows:
        most[r.doc_id] = max(most.get(r.doc_id, 0), r.copies)
    assert Counter(r.doc_id for r in twice.collect()) == Counter({i: n * sum(c[0] == i for c in corpus()) for i, n in most.items() if n})


def test_mix_equals_its_sql(spark, duck):
    from tests.conftest import SF

    got = sorted(map(str, mixing.op7_mix(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()))
    want = duck.sql(mixing.OP7_SQL).df()[["doc_id", "size", "source_size", "target", "taken"]]
    assert got == sorted(f"Row(doc_id={r.doc_id}, size={r.size_}, source_size={r.source_size}, target={r.target}, taken={r.taken})" for r in want.rename(columns={"size": "size_"}).itertuples())


def test_inclusion_odds_decide_the_sample(spark):
    """Longer documents are likelier; ranks by the random odds alone would take others."""
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([4, 9, 25, 100])), s) for s in "abc" for i in range(2000 * "abc".index(s), 2000 * "abc".index(s) + 2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        own = [r for r in out if r.source == source]
        least = min(r.copies for r in own)
        share = {n: np.mean([r.copies > least for r in own if r.size == n]) for n in (4, 9, 25, 100)}
        rest = own[0].target - least * own[0].source_size
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 50
        if 0.05 < rest / own[0].source_size < 0.95:
            rate = min(x for x in (share[100], 1)) / 10
            assert share[100] > share[4] + 0.1 and share[9] == pytest.approx(min(1, 3 * rate), abs=0.08) or share[100] == 1
            plain = sorted(own, key=lambda r: int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[: mixing.DIGITS], 16))
            taken, words = set(), 0
            for r in plain:
                if words < rest:
                    taken.add(r.doc_id)
                    words += r.size
            assert taken != {r.doc_id for r in own if r.copies > least}


@pytest.mark.parametrize("text", ["w w w", None])
def test_mix_at_its_edges(spark, text):
    """One source, sources at their caps, no words at all, repeated ids."""
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "a"), (None, text, "a")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 4 and all(r.copies == (1 if text else 0) for r in out)
    rows += [(10 + i, " ".join(["w"] * 50), "b") for i in range(40)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.copies == (3 if text else 0) for r in out if r.source == "a") and sum(r.size * r.copies for r in out) == pytest.approx(sum(r.size for r in out), abs=50)


def brute_toxic_segments(scores):
    """Every maximal segment by definition: the best one, then the same left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: x[:2])
    return brute_toxic_segments(scores[: best[2]]) + [best[0]] + brute_toxic_segments(scores[best[3] :])


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        scores = [float(rng.randint(-5, 5)) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert sorted(toxicity.segments(scores)) == pytest.approx(sorted(brute_toxic_segments(scores)))


def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        words, bad = prose(rng, 80).split(), i % 4 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(["vile", "rotten"]) + rng.choice(["", "!", "ness"])
        if i % 7 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), int(i % 7 != 0), int(bad)))
    rows += [(1000, None, None, None), (1001, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.filter("doc_id % 3 <> 1 AND quality IS NOT NULL").drop("text")


def test_toxicity_learns(spark, none):
    texts, labels = labelled(spark)
    model = toxicity.learn(texts, labels)
    out = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    unseen = [r for k, r in out.items() if k < 700 and r.held_out]
    assert len(unseen) > 50 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in unseen) / len(unseen) > 0.95
    assert out[1000].score == out[1001].score and out[1000].predicted == 0
    assert toxicity.score(none, model).count() == 0


@pytest.mark.parametrize(("n", "reverse"), [(120, False), (400, True)])
def test_toxicity_ranks_by_few_labels_and_by_reverse_ones(spark, n, reverse):
    """Ten labelled documents with such words rank those held out; where label 1 marks the others, what speaks for label 0 does."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words, bad = prose(rng, 60).split(), i % 8 == 0
        for _ in range(4 * bad):
            words[rng.randrange(60)] = rng.choice(["vile", "rotten", "scummy"])
        rows.append((i, " ".join(words), int(bad != reverse)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = [(r.score, r.toxic) for r in toxicity.score(df, toxicity.learn(df, df)).join(df, "doc_id").filter("held_out").collect()]
    ones, zeros = ([s for s, y in got if y == k] for k in (1, 0))
    assert len(ones) >= 2 and len(zeros) >= 2
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) > 0.9 * len(ones) * len(zeros)


def test_slopes_keep_their_sign():
    """Steps that overshoot are halved, and evidence that happens to stand against its side keeps the least slope."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.exponential(300, 40), rng.normal(0, 1, 40)])
    y = (x[:, 0] < 200).astype(int)
    w = toxicity.logistic(x, y, np.array([-2.0, 0.5, -0.5]))
    assert w[1] == toxicity.LEAST_SLOPE and w[2] <= -toxicity.LEAST_SLOPE and np.isfinite(w).all()
    assert toxicity.logistic(x, 1 - y, np.array([-2.0, 0.5, -0.5]))[1] >= toxicity.LEAST_SLOPE


def test_quality_classifier_learns(spark, none):
    texts, labels = labelled(spark)
    model = classifier.learn(texts, labels)
    out = {r.doc_id: r for r in classifier.score(texts, model).collect()}
    unseen = [r for k, r in out.items() if k < 700 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 7 != 0) for r in unseen) / len(unseen) > 0.95 and 0.7 < model.prior < 0.95
    assert classifier.score(none, model).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 20)).astype(np.float32)
    x[300:340] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1050, [0.0] * 20), (1100, [1.0, None]), (1150, [float("nan")] * 20)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 400, 50)) and [got[50][k][0] for k in range(1, 6)] == [300, 301, 302, 303, 304]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        last = np.sort(s)[-5]
        hit += sum(v >= last - 1e-9 for _, v in found.values())
        assert all(v == pytest.approx(s[i], abs=1e-12) for i, v in found.values())
    assert hit / (5 * len(got)) >= 0.9
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x, far = rng.normal(size=(2, 20))
    rows = [(50, x)] * 6 + [(i, x) for i in range(51, 56)] + [(i, x + 0.001 * rng.normal(size=20)) for i in range(60, 70)]
    rows += [(100, far)] + [(7, far + 1e-4 * rng.normal(size=20)) for _ in range(10)] + [(i, far + 1e-2 * rng.normal(size=20)) for i in range(8, 12)]
    got = {}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[50] == [51, 52, 53, 54, 55]
    assert got[100][0] == 7 and set(got[100]) == {7, 8, 9, 10, 11}


def lcs_length(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        found, rest = sorted(pages.shared(a, b)), iter(b)
        assert all(a[i] in rest for i in found) and len(found) == lcs_length(a, b)


def test_main_text(spark):
    page = lambda body: f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>menu</li></ul></nav>{body}<footer>&copy; foot</footer>"
    rows = [
        (1, "http://h.org/a/1", page("<div class='ad'>buy</div><article><h1>Head &amp;amp; line</h1><p>One\n  two&nbsp;<b>three</b><p>Four<script>x('</p>')</script></article><div id='comments'>first!</div>")),
        (2, "http://h.org/a/2", page("<p>Welcome to h</p><p>Own text</p><p>Subscribe now</p>")),
        (3, "http://h.org/a/3", page("<p>Welcome to h</p><p>Other text</p><p>More</p><p>Subscribe now</p>")),
        (4, None, None), (5, "http://h.org/a/5", ""), (6, "no url", "<p>plain &lt;b&gt; text"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {1: "Head &amp; line\nOne two three\nFour", 2: "Own text", 3: "Other text\nMore", 4: "", 5: "", 6: "plain <b> text"}


def test_shared_lines_decide_in_and_out_of_containers():
    text = lambda page, other: [x.text for x in pages.difference(pages.lines_of(page), [pages.lines_of(other)])]
    frame = "<p>Welcome</p>{}<p>Imprint</p><nav>menu</nav>"
    cards = "<article>Card one</article><article>Card two</article>"
    a, b = (frame.format(f"<div>Lead {n}</div><article><p>Quoted</p><p>Text {n}</p><p>More {n}</p></article>") for n in "ab")
    assert text(a, b) == ["Lead a", "Quoted", "Text a", "More a"]
    a, b = (frame.format(f"{cards}<div>Text {n}</div><div>More {n}</div>") for n in "ab")
    assert text(a, b) == ["Text a", "More a"]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><article><p>text</article>", "<html><head><title>x</title><p>text", "<html><head><title>x</title>text", "<head><noscript><img src=a></noscript><title>x</title></head><p>text",
        "<div><svg><path></div><article>text</article>", "<body><svg><path><article>text</article>", "<body><noscript><img src=a><main>text</main>", "<p><a><button>go</a>text</p>",
        "<ul><li><select><option>a</ul><main>text</main><select></select>", "<div><canvas>old</div><p>text</p><canvas></canvas>", "<svg><foreignObject><p>no</p></foreignObject></svg><p>text", "<div><template><p>no</p></div>no</template>text</div>",
        "<body class='has-sidebar'><main class='with-sidebar'><article class='post no-header'>text</article></main>", "<div role=main class='no-sidebar'>text</div>",
    ],
)
def test_open_elements_and_class_words_keep_the_article(page):
    assert [x.text for x in pages.lines_of(page) if not x.frame] == ["text"]


def test_neighbours_past_copies_and_across_ranges(spark):
    menu, host = "".join(f"<div>item {i}</div>" for i in range(40)), "http://t.org/"
    body = lambda n: "".join(f"<p>{prose(random.Random(100 * n + k), 30)}</p>" for k in range(8))
    # a template of many lines; exact copies of one page, then near copies of another; a host apart
    texts = [body(n) for n in (1, 2, 3)] + [body(4)] * 9 + [body(5) + f"<p>{n}</p>" for n in range(9)] + [body(6)]
    rows = [(i, f"{host}{i:02}", menu + t) for i, t in enumerate(texts)] + [(90, "http://u.org/", "<p>alone</p>"), (91, None, None)]
    want = {i: t.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "") for i, t in enumerate(texts)} | {90: "alone", 91: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in ("1", "3", "8", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = pages.extract(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert pages.extract(df.limit(0)).count() == 0


def test_pipeline_runs_all_stages(spark, docs):
    import corpus_pipeline

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, "")
        if name != "encode":
            assert out.columns == rows.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in rows.collect()} <= {r[0] for r in corpus()}


def brute_quality(rows, passes=2):
    """Counts, references and verdicts of (doc_id, text, lang), from their definitions."""
    def shares(counts):
        return np.array(counts) / sum(counts)

    def js(p, q):
        m = (p + q) / 2
        h = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return max(0.0, (h(p) + h(q)) / 2) ** 0.5

    words = {}
    for _, text, lang in rows:
        words.setdefault(lang or "", Counter()).update((text or "").lower().split())
    everything = sum(w.total() for w in words.values())
    common = {k: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON] if n >= quality.SHARE * c.total()] for k, c in words.items() if c.total() >= quality.LANGUAGE_SHARE * everything and c}
    out = []
    for doc_id, text, lang in rows:
        text, key = text or "", lang or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        hit = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + d for i in range(len(w) - 2) if hit[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        own = Counter(text.lower().split())
        hist = [own[x] for x in common.get(key, [])] + [0] * (quality.COMMON - len(common.get(key, [])))
        out.append((doc_id, key, base, base[0] < 50 or 100 * base[4] > 50 * base[0], quality.classes(text), [*hist, own.total() - sum(hist)]))
    kept, refs = None, {}
    for _ in range(passes):
        for key in common:
            fit = [r for n, r in enumerate(out) if r[1] == key and not r[3] and (kept is None or kept[n])]
            if fit:
                mean = [np.mean([shares(r[k]) for r in fit], axis=0).round(6) for k in (4, 5)]
                refs[key] = [m / m.sum() for m in mean]
        slack = [quality.SLACK / max(1, r[2][0]) ** 0.5 for r in out]
        far = [(0.0, 0.0) if r[1] not in refs or not r[2][0] else (js(shares(r[4]), refs[r[1]][0]), js(shares(r[5]), refs[r[1]][1])) for r in out]
        kept = [r[2][0] < quality.LEAST_WORDS or d[0] <= quality.CHAR_LIMIT + x and d[1] <= quality.WORD_LIMIT + x for r, d, x in zip(out, far, slack, strict=True)]
    return Counter((r[0], *r[2], r[3], not r[3] and k, round(d[0], 6), round(d[1], 6)) for r, k, d in zip(out, kept, far, strict=True))


@pytest.mark.parametrize(("block", "most"), [(2_000_000, 200_000), (300, 200_000), (300, 0)])
def test_quality_matches_brute_force(docs, monkeypatch, block, most):
    """Whatever the blocks and tasks, and with or without candidates, common words are exact."""
    monkeypatch.setattr(quality, "BLOCK", block)
    monkeypatch.setattr(quality, "CANDIDATES", most)
    references, rows = quality.learn(docs.repartition(1 if block > 300 else 5))
    kept = ~F.col("base_failed") & F.col("agrees")
    got = quality.judged(rows, references).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, F.round("char_distance", 6), F.round("word_distance", 6))
    assert Counter(map(tuple, got.collect())) == brute_quality([(r[0], r[1], r[2]) for r in corpus()])


def test_neighbours_of_clustered_vectors_with_few_candidates(spark):
    """Recall against exact search; a query looks at a bounded number of entries however many there are."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(300, 48))
    x = (centres[rng.integers(0, 300, 6000)] + 0.35 * rng.normal(size=(6000, 48))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], "x", 1, [i], 2) for i in range(6000)], "vec_id long, embedding array<float>, key string, dim int, ids array<int>, number int")
    got = {}
    for r in neighbours.search(df, every=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        assert [r[0] for r in sorted(found)] == [1, 2, 3, 4, 5] and all(v == pytest.approx(s[i], abs=1e-12) for _, i, v in found)
        hit += len({i for _, i, _ in found} & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert len(got) == 60 and hit / 300 >= 0.9
    sizes = neighbours.digits(6000, 48)
    at = np.stack([neighbours.buckets(u, t, sizes) for t in range(neighbours.TABLES)])
    looked = [len({i for t in range(neighbours.TABLES) for i in np.flatnonzero(np.isin(at[t], neighbours.probes(u[[q]], t, sizes, neighbours.PROBES)[0])).tolist()}) for q in range(0, 6000, 500)]
    assert np.mean(looked) <= 1.5 * neighbours.TABLES * neighbours.PROBES * neighbours.LOAD
    for n in (10**4, 10**6, 10**9):
        assert neighbours.LOAD / 1.5 <= n / np.prod(np.array(neighbours.digits(n, 64), float)) <= 1.5 * neighbours.LOAD


def test_neighbours_on_hard_rows(spark, monkeypatch):
    """Several lengths, few candidates, multiples of one vector, and large chunks cut into blocks, with ties to the smaller id."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 2.0]) for i in (200, 1, 2)] + [(3, [0.5, 0.0, 1.0])] + [(i, [float(v) for v in rng.normal(size=9)]) for i in range(1000, 1001)]
    v = rng.normal(size=6)
    rows += [(5000 + i, [float(c) for c in v * 2.0 ** (i % 5)]) for i in range(60)] + [(9000, None), (9050, []), (9100, [0.0] * 6), (None, [1.0] * 6)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[200]] == [1, 2, 3] and 1000 not in got and not {9000, 9050, 9100} & set(got)
    assert [i for i, _ in got[5000]] == [5001, 5002, 5003, 5004, 5005] and [i for i, _ in got[5050]] == [5000, 5001, 5002, 5003, 5004]


def test_hadamard_is_the_plain_transform():
    x = np.random.default_rng(3).normal(size=(5, 256))
    h = np.ones((1, 1))
    while len(h) < 256:
        h = np.block([[h, h], [h, -h]])
    assert np.abs(neighbours.hadamard(x.astype(np.float32)) - x @ h / 16).max() < 1e-5


def brute_extract(rows):
    """Each page against the nearest pages of its host, before and after it in order of path, that aren't its copies."""
    def key(r):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r[1] or "")
        return ((m[1].lower() if m else ""), re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "", r[1] or ""), r[1] or "", str(r[0]))

    rows = sorted(rows, key=key)
    lines, out = [pages.lines_of(r[2]) for r in rows], {}
    for n, r in enumerate(rows):
        frame = set()
        for step in (-1, 1):
            m = n + step
            while 0 <= m < len(rows) and key(rows[m])[0] == key(r)[0]:
                if (found := pages.witness(lines[n], lines[m])) is not None:
                    frame |= found
                    break
                m += step
        out[r[0]] = "\n".join(x.text for x in pages.rest(lines[n], frame))
    return out


def test_extraction_matches_brute_force_for_any_number_of_ranges(spark):
    rng = random.Random(14)
    rows, chrome = [], {h: [prose(rng, 3) for _ in range(12)] for h in "abc"}
    for i in range(120):
        host = rng.choice("abc")
        own = "".join(f"<p>{prose(rng, 20)}</p>" for _ in range(rng.randint(2, 5)))
        menu = "".join(f"<div>{x}</div>" for x in chrome[host])
        rows.append((i, f"https://{host}.org/{rng.randint(0, 20)}/{i}?q=1", f"<body>{menu}{own}<div>{chrome[host][0]}!</div></body>"))
    want = brute_extract(rows)
    assert sum(want[i] == "\n".join(x.text for x in pages.lines_of(h)) for i, _, h in rows) == 0  # without neighbours every page keeps its frame
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in ("1", "7", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in pages.extract(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want
    assert {r.page_id: r.n_chars for r in pages.extract(df.union(df)).collect()} == {i: len(t) for i, t in want.items()}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header class='entry-header'><h1>Title</h1></header><p>text</p></article>", ["Title", "text"]),
        ("<article><ul><li class='share'>Share<li>kept</ul><p>text</article>", ["kept", "text"]),
        ("<article><p class='ad'>buy<div>text</div></article>", ["text"]),
        ("<article>a \uf8f0lt; b &lt; c</article>", ["a \uf8f0lt; b < c"]),
        ("<article><table><tr><td class='ad'>buy<td>cell<tr><td>next</table></article>", ["cell", "next"]),
        ("<article>" + "x" * 200_000 + "</article>", ["x" * 200_000]),
    ],
)
def test_markup_that_html_closes_itself(page, want):
    assert [x.text for x in pages.lines_of(page) if not x.frame] == want


def test_token_files_can_be_read_in_part(spark, docs, tmp_path, tokenizer):
    import pyarrow.parquet as pq

    rows = [(i, " ".join(["word", str(i)] * 40)) for i in range(3000)] + [(5, "other text"), (5, "third")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write_tokens(df, str(tmp_path / "t"), files=2)
    names = sorted((tmp_path / "t").glob("*.parquet"))
    assert len(names) == 2
    for name in names:
        f = pq.ParquetFile(name)
        column = f.metadata.row_group(0).column(f.schema_arrow.get_field_index("ids"))
        assert column.has_offset_index and column.has_column_index and {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
    got = tokenfile.read_tokens(spark, str(tmp_path / "t")).filter("doc_id = 5")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in got._jdf.queryExecution().toString()
    want = sorted([*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows if i == 5)
    assert sorted(r.ids for r in got.collect()) == want
    index = tokenfile.read_index(spark, str(tmp_path / "t"))
    assert "ids" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    place = sorted(tuple(r) for r in index.collect())
    assert [p[0] for p in place] == sorted(i for i, _ in rows) and all(a[1] + a[2] == b[1] for a, b in zip(sorted(place, key=lambda r: r[1]), sorted(place, key=lambda r: r[1])[1:], strict=False))


def test_ledger_is_kept_and_a_second_run_scans_what_is_new(spark, tmp_path, none):
    at = str(tmp_path / "ledger")
    long = "x " * 20_000 + "token=abcdefgh"
    texts = ["-----BEGIN RSA PRIVATE KEY----- token=abcdef", "ghp_" + "a1B2" * 10, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK end", "see ftp://me:pass@host/x", long, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.findings_by_path(df, secrets.updated_ledger(df, at)).select("doc_id", secrets.written(F.col("spans")).alias("s")).collect()}
    assert got == {0: "pem:0:31,assign:32:44", 1: "forge:0:44", 2: "jwt:0:39", 3: "login:4:18", 4: "assign:40000:40014", 5: "", 6: ""}
    first = spark.read.parquet(at)
    assert first.count() == 6  # null and empty are one blob
    again = secrets.updated_ledger(df.union(df), at)
    assert again.count() == 6 and secrets.scan(df, again).count() == 0
    more = spark.createDataFrame([(50, texts[1]), (51, "secret: zzzzzz")], "doc_id long, text string")
    after = secrets.updated_ledger(more, at)
    assert after.count() == 7 and secrets.updated_ledger(none, at).count() == 7
    paths = {r.doc_id: r.s for r in secrets.findings_by_path(more, after).select("doc_id", secrets.written(F.col("spans")).alias("s")).collect()}
    assert paths == {50: "forge:0:44", 51: "assign:0:14"}
    assert secrets.updated_ledger(df, at, version=2).filter("rules_version = 2").count() == 6


def test_one_of_each_keeps_texts_that_share_an_id(spark):
    rows = [(1, "one two three four five six", 7), (1, "entirely other words stand in this row", 8), (1, "one two three four five six", 9), (2, "one two three four five six", 7), (None, "one two three four five six", 7), (3, None, 1), (4, "", 1)]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `_first` int"))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, rows[0][1]), (1, rows[1][1]), (None, rows[0][1]), (3, None), (4, "")]) and out.columns == ["doc_id", "text", "_first"]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 200), dtype=np.uint64)]))
        if len(b):
            assert jaccard.least_difference(jaccard.bits(a), jaccard.bits(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("learned", ["toxic", "quality"])
def test_labels_that_teach_nothing(spark, learned):
    """All of one class, conflicting and repeated labels, ties, very long texts, clashing columns."""
    texts = spark.createDataFrame([(i, "same text for all" if i < 40 else "long " * 30_000, 1.0, 1, "x") for i in range(42)] + [(None, None, 0.0, 0, "x")], "doc_id long, text string, score double, label int, n string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(40)] + [(0, 0, 0), (1, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    module, learn = (toxicity, toxicity.learn) if learned == "toxic" else (classifier, classifier.learn)
    out = module.score(texts, learn(texts, labels)).collect()
    assert len(out) == 43 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out) and len({r.score for r in out if r.doc_id is not None and r.doc_id < 40}) == 1
    module.score(texts, learn(texts, labels.limit(0))).collect()


def test_risk_and_its_slope():
    """One step of the non-negative risk goes the way of its numerical gradient, also where it would be negative."""
    rng = np.random.default_rng(2)
    pos, unl = rng.normal(1, 1, (500, classifier.WIDTH)), np.concatenate([rng.normal(1, 1, (300, classifier.WIDTH)), rng.normal(-1, 1, (200, classifier.WIDTH))])
    model = classifier.fit(pos, unl, 0.6, np.zeros(classifier.WIDTH), np.ones(classifier.WIDTH))
    loss = lambda z: np.logaddexp(0, -z)
    risk = lambda m: 0.6 * loss(m.logits(pos)).mean() + max(0.0, loss(-m.logits(unl)).mean() - 0.6 * loss(-m.logits(pos)).mean())
    start = classifier.Model(model.mean, model.scale, [np.zeros_like(w) for w in model.layers], 0.6)
    assert risk(model) < 0.15 < risk(start)
    truth = np.repeat([1, 0], [300, 200])
    assert ((model.scores(unl) >= 0.5) == truth).mean() > 0.97
    plain = classifier.fit(pos[::2], unl[::2], None, np.zeros(classifier.WIDTH), np.ones(classifier.WIDTH))
    assert classifier.estimate_prior(plain.logits(pos[1::2]), plain.logits(unl[1::2])) == pytest.approx(0.6, abs=0.12)


def test_each_stage_against_brute_force(spark):
    """The pipeline's stages one by one, on rows with null ids, repeated ids, nulls and columns that clash."""
    import corpus_pipeline

    rng = random.Random(21)
    base = prose(rng, 90)
    rows = [(i, prose(rng, 80) + (" token=abcdef1" if i % 9 == 0 else ""), "en", "ab"[i % 2]) for i in range(40)]
    rows += [(50 + i, base + f" tail{i}", "en", "a") for i in range(5)] + [(60, None, None, None), (61, "", "en", "a"), (62, "short", "en", "a"), (63, " ".join(w + "###" for w in prose(rng, 90).split()), "en", "b"), (None, prose(rng, 70), "en", "b"), (0, rows[0][1], "en", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, class int, `row` int, `of` int, spans int, copies int, salt int"
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2, 3, 4, 5, 6) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    again = lambda df: common.stored(df, "stage")
    ids = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    kept = again(stages["quality rules"](spark, docs, ""))
    verdict = brute_quality([r[:3] for r in rows])
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: n for k, n in verdict.items() if k[7] for n in [sum(m for q, m in verdict.items() if q[0] == k[0] and q[7])]})
    left = [(r.doc_id, r.text) for r in kept.collect()]
    first = {(g[0]) for g in brute_groups(left) if g[0] == g[2]}
    single = again(stages["near duplicates"](spark, kept, ""))
    assert ids(single) == Counter({(i, t): 1 for i, t in left if i in first and i is not None} | {(i, t): n for (i, t), n in Counter(left).items() if i is None})
    masked = again(stages["secret scan"](spark, single, ""))
    assert ids(masked) == Counter((r.doc_id, r.text.replace("token=abcdef1", "<assign>")) for r in single.collect())
    mixed = again(stages["mix"](spark, masked, ""))
    copies = Counter()
    for r in mixing.mix(masked).collect():
        copies[r.doc_id] = max(copies[r.doc_id], r.copies)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: copies[r.doc_id] for r in masked.collect() if copies[r.doc_id]})
    assert docs.columns == kept.columns == single.columns == masked.columns == mixed.columns
    out = stages["encode"](spark, mixed, "").collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in mixed.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = again(stage(spark, empty, ""))
        assert empty.count() == 0


def test_log_odds_by_hand(spark, monkeypatch):
    """Words by their counts of documents, and beginnings of what isn't a known word."""
    rng = random.Random(31)
    rows = [(prose(rng, 12) + (" vile rottenness" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    got = toxicity.log_odds(df)

    def brute(told_by):
        seen = {}
        for text, label in rows:
            for form in {f for w in set(toxicity.words_of(text)) for f in told_by(w)}:
                seen.setdefault(form, [0, 0])[label] += 1
        n0, n1 = sum(y == 0 for _, y in rows), sum(y == 1 for _, y in rows)
        out = {}
        for form, (c, t) in seen.items():
            if c + t >= toxicity.LEAST_COUNT:
                p = (c + t) * toxicity.PRIOR / (n0 + n1)
                d = np.log((t + p) / (n1 + toxicity.PRIOR - t - p)) - np.log((c + p) / (n0 + toxicity.PRIOR - c - p))
                z2 = d * d / (1 / (t + p) + 1 / (c + p))
                out[form] = d * z2 / (z2 + toxicity.DOUBT)
        return out

    assert got == pytest.approx(brute(lambda w: [w])) and got["vile"] == max(got.values()) > 0 > min(got.values())
    known = {"vile": 1.0}
    assert toxicity.log_odds(df, known) == pytest.approx(brute(lambda w: [] if w in known else toxicity.forms(w)[1:]))


def test_law_of_clean_scores():
    """lambda makes the mean of exp(lambda s) one, and E of a clean text's best passage is one on average."""
    rng = np.random.default_rng(3)
    values, odds = [-1.0, 1.0, 2.0], [0.8, 0.15, 0.05]
    best = [(400, max(toxicity.segments(rng.choice(values, 400, p=odds).tolist()))) for _ in range(400)]
    rate, scale = toxicity.extreme_law({v: int(1000 * p) for v, p in zip(values, odds, strict=True)}, best)
    assert np.array(odds) @ np.exp(rate * np.array(values)) == pytest.approx(1, abs=1e-6)
    gaps = [rate * b - np.log(scale * n) for n, b in best]
    assert np.mean(gaps) == pytest.approx(toxicity.EULER, abs=1e-6) and np.mean(np.array(gaps) > 3) == pytest.approx(1 - np.exp(-np.exp(-3)), abs=0.04)


def test_joined_chunks_equal_whole_encoding(tokenizer, monkeypatch):
    """Short chunks, so many joins; texts of odd white space, marks, scripts and special tokens."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "LEAST", 6)
    monkeypatch.setattr(bpe, "MOST", 48)
    rng, own = random.Random(5), bpe.Codec(bpe.tokenizer_path())
    pieces = [" ", "  ", "\n", " \n ", "\t", "\u00a0", "\u3000", "don't", "I'll", "x" * 30, "é", "ñandú", "日本語", "🙂", "123", "4.5", "...", "<|endoftext|>", "foo", "Bar", "_", "-", "\x85", "\u2028", "'s", "'"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [a + b for a, b in zip(texts[:50], texts[50:100], strict=True)]
    cache = {}
    got = [x for i in range(0, len(texts), 64) for x in bpe.encode_part(pa.array(texts[i : i + 64]), own, {}, cache)]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert cache


@pytest.mark.parametrize("rows_of_batch", [1, 7, 10_000])
def test_candidates_stream_over_batches(spark, rows_of_batch):
    """Pairs of cold segments and each row of hot ones once, wherever batches end."""
    rng = random.Random(rows_of_batch)
    groups = {key: sorted({rng.randrange(-500, 500) for _ in range(rng.choice([1, 1, 2, 3, 16, 17, 18, 60]))}) for key in range(-40, 40)}
    rows = [(key, name, -name) for key, names in groups.items() for name in names for _ in range(rng.choice([1, 1, 3]))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_of_batch))
    out = jaccard.candidates(spark.createDataFrame(rows, "key long, hi long, lo long")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    name = lambda b: int(np.frombuffer(bytes(b), np.int64)[0])
    pairs = Counter(tuple(sorted((name(r.a), name(r.b)))) for r in out if r.b is not None)
    hot = Counter((name(r.a), r.key) for r in out if r.b is None)
    want_pairs, want_hot = Counter(), Counter()
    for key, names in groups.items():
        if len(names) <= jaccard.HOT:
            want_pairs.update((a, b) for n, a in enumerate(names) for b in names[n + 1 :])
        else:
            want_hot.update((n, key) for n in names)
    assert pairs == want_pairs and hot == want_hot


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article class="post"><div class="content no-sidebar"><p>Body of text</p></div></article>', ["Body of text"]),
        ('<article><h1>Title</h1><section class="related-work"><p>Others found</p></section></article>', ["Title", "Others found"]),
        ('<article><p>text</p><div class="share-buttons">Share</div><div id="comments">me</div><span class="ads">buy</span></article>', ["text", "Share"]),
        ('<div class="site-footer">foot</div><div class="cookie-banner">eat</div><div class="with-comments"><p>text</p></div>', ["text"]),
        ("<article><p>1 < 2 and a<b is no tag", ["1 < 2 and a<b is no tag"]),
        ("<article><p>text<b>bold</b> <i", ["textbold <i"]),
    ],
)
def test_names_alone_dont_empty_an_article(page, want):
    assert [x.text for x in pages.difference(pages.lines_of(page), [])] == want


def test_a_neighbour_decides_about_a_hint():
    page = lambda text, name: pages.lines_of(f"<article><h1>{text}</h1><p>{text} has a body of its own</p><div class='{name}'><p>see {text}</p></div></article>")
    left = lambda a, b: [x.text for x in pages.difference(a, [b])]
    assert left(page("one", "related-posts"), page("two", "related-posts")) == ["one", "one has a body of its own"]
    assert left(page("one", "related-posts"), page("two", "other")) == ["one", "one has a body of its own", "see one"]


@pytest.mark.parametrize("unit", ["a<b ", "<", "<a <b", "<!x", "</p", "<p x='", "&amp", "<!-"])
def test_long_pages_of_stray_marks_are_quick(unit):
    import time

    for start in ("", "<article><p>"):
        began = time.process_time()
        pages.lines_of(start + unit * (200_000 // len(unit)))
        assert time.process_time() - began < 1.5, (start, unit)


def test_tasks_that_dont_encode_give_codecs_back(docs, monkeypatch):
    import pyarrow as pa

    class Rows:  # hands out what a task would run
        schema = docs.schema
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    columns = {"doc_id": pa.array([1]), "text": pa.array(["one two three four five six"]), "lang": pa.array(["en"])}
    batch = lambda *names: pa.RecordBatch.from_arrays([columns[c] for c in names], list(names))
    tasks = [
        (jaccard.sets_of(Rows()), batch("doc_id", "text")),
        (jaccard.published(Rows()), batch("text")),
        (quality.block_counts(Rows(), quality.SHARE), batch("text", "lang")),
        (quality.featured(Rows(), {}), batch("doc_id", "text", "lang")),
    ]
    for run, rows in tasks:
        monkeypatch.setattr(bpe, "_codecs", {})
        own = bpe.codec(bpe.tokenizer_path())
        assert bpe.codec(bpe.tokenizer_path()) is own  # tasks that encode share it
        assert sum(out.num_rows for out in run(iter([rows]))) > 0
        assert not bpe._codecs
