"""The divergence audit against a plain version and its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from skyshear.llm import divergence
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, term string, at int, n long, docs long, item string, value long"


def rows_of(seed=1):
    rng = random.Random(seed)
    words = ["Über", "naïve", "東京", "x y", "don't", "a1b", "ZETA", "zeta", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 50))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", "é", None, "a "])) for i in range(260)]
    rows += [(300, None, "en", "only nulls"), (301, " 12 \x00\x7f ", "en", "no terms"), (302, "rare", "de", "x"), (303, "rare", "de", "y"), (304, "one", "it", "alone"), (305, "w" * 20_000, "en", "a"), (305, "zeta " * 9000, "en", "a"), (305, "zeta " * 9000, "en", "a")]
    return rows


def brute(rows, least, top):
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in d[2]).items() if n >= least}
        sources = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            sources[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(sources.values(), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in sources.items()}, share(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, "i", 4) for r in rows_of()], SCHEMA).repartition(3)


@pytest.mark.parametrize(("block", "places", "entries"), [(500_000, 1 << 22, 300_000), (40, 9, 50), (1, 1, 1)])
def test_audit_equals_brute_force(docs, monkeypatch, block, places, entries):
    plain = divergence.distances
    monkeypatch.setattr(divergence, "distances", lambda i, g: plain(i, g, block=block, places=places))
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    got = [tuple(r) for r in divergence.audit(docs, least=6, top=7).collect()]
    assert sorted(got) == brute(rows_of(), 6, 7)


def test_large_counts_stay_exact(spark):
    n, total, terms = 90_000_000_000_000_000, 4_000_000_000_000_000_000, 7
    got = spark.sql(f"SELECT {divergence.share('n', 'total', 'terms')} AS p, {divergence.share('n', 'total', 'none')} AS q FROM (SELECT {n}L AS n, {total}L AS total, {terms}L AS terms, 0L AS none)").first()
    assert got["p"] == 1 + 1_000_000_000 * (n + 5) // (total + 35) and got["q"] is None


def test_empty_table(docs):
    assert divergence.audit(docs.filter("false")).count() == 0


def test_query_equals_its_sql(spark, duck):
    got = [tuple(r) for r in divergence.op11_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(duck.sql(divergence.OP11_SQL).fetchall())
