"""Source divergence audit by Gustavson row accumulation.

Each group (one source within one language) is a row of smoothed shares of its
language's common terms, in whole billionths. The distance of two rows sums
|p - q| over all terms, but rows are sparse: a term that a group lacks has the
same small share z in it, its zero baseline. With U(g, h) the sum of
|p_g - z_h| - |z_g - z_h| over the terms of g, and X(g, h) the sum of
|p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h| over the terms of both,

    D(g, h) = V |z_g - z_h| + U(g, h) + U(h, g) + X(g, h).

The terms of a language are dealt over blocks. A task holds the postings of its
block by term and goes through its groups one by one: it scatters the group's
terms through the postings of each into a dense accumulator with a place for
every peer, so pairs of postings are never emitted. U comes from the sorted
shares of the group and their running sums. Accumulators of all blocks are added
up; all of it is whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import parts, texts_of
from .common import discard, stored, table

#: A term is kept by a language that has it in so many documents.
LEAST_DOCS = 30
#: Added to each count, and the whole of all shares.
PRIOR, WHOLE = 5, 1_000_000_000
#: Ranks of the term part.
TOP = 50
#: Terms that a task has counted before it hands them on.
ENTRIES = 300_000
#: Postings of a block; additions of a block; places of the accumulators that a task makes.
BLOCK, WORK, PLACES = 50_000, 1 << 31, 1 << 22
#: Letters of ASCII in lower case and all bytes of other characters stay, the rest separates terms.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group and how many of its documents have it; an empty term for each group.

    Each task adds up what it reads before anything is shuffled, and hands over
    when it holds ENTRIES terms.
    """

    def out(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        rows = [(lang, source, b"", 0, 0) for lang, source in groups]
        rows += [(lang, source, term, n, seen[term]) for (lang, source), (found, seen) in groups.items() for term, n in found.items()]
        names = ["lang", "source", "term", "n", "docs"]
        columns = zip(*rows, strict=True)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for part in parts(batch):
                data, _, starts = texts_of(part.column("text"))
                langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
                for i, key in enumerate(zip(langs, sources, strict=True)):
                    if key not in groups:
                        groups[key] = (Counter(), Counter())
                    found, seen = groups[key]
                    terms = bytes(data[starts[i] : starts[i + 1]]).translate(TERM).split()
                    held -= len(seen)
                    found.update(terms)
                    seen.update(set(terms))
                    held += len(seen)
                    if held > ENTRIES:
                        yield out(groups)
                        groups, held = {}, 0
        if groups:
            yield out(groups)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, terms: str) -> str:
    """The smoothed share of a count in SQL: exact, since the product has 38 digits at most; null without terms."""
    return f"CASE WHEN {terms} > 0 THEN 1 + (CAST({n} + {PRIOR} AS DECIMAL(20,0)) * {WHOLE}L DIV ({total} + {PRIOR} * {terms})) END"


def index_of(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The postings of all kept terms: ``lang, term, source, n, lang_n, peers, head``; a row with an empty term for each group.

    lang_n is the term's count in the language, peers the number of groups that
    have it, and head is true in one row of each term.
    """
    sums = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    rows = sums.select("*", F.sum("docs").over(of).alias("lang_docs"), F.sum("n").over(of).alias("lang_n"), F.count("*").over(of).alias("peers"), F.row_number().over(of.orderBy("source")).alias("at"))
    return rows.filter((F.col("lang_docs") >= least) | (F.col("term") == "")).select("lang", "term", "source", "n", "lang_n", "peers", (F.col("at") == 1).alias("head"))


def groups_of(index: DataFrame) -> DataFrame:
    """``lang, source, total, terms, lang_total, at, peers``: a row for each group; ``terms`` is V, ``at`` its place among its language's sources, from 0."""
    rows = index.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("head") & (F.col("term") != ""), 1).otherwise(0)).alias("heads"))
    lang = Window.partitionBy("lang")
    return rows.select(
        "lang", "source", "total", F.sum("heads").over(lang).alias("terms"), F.sum("total").over(lang).alias("lang_total"),
        (F.row_number().over(lang.orderBy("source")) - 1).cast("int").alias("at"), F.count("*").over(lang).cast("int").alias("sources"),
    )


def accumulated(postings: pa.Table, peers: pa.Table, first: bool, low: int, high: int) -> pa.Table:
    """Accumulators of the groups from ``low`` to below ``high`` over one block: ``at`` and ``sums``, a value for every peer.

    A value is 2 U + X (see above), and V |z_g - z_h| besides in the first block,
    so the values of (g, h) and (h, g) add up to twice the distance.
    """
    place = np.argsort(peers["peer"].to_numpy())
    z = peers["zero"].to_numpy()[place]
    terms = int(peers["terms"][0].as_py())
    # postings by term: those of term c stand from start[c] on
    names = postings["term"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code, group, p = code[order], postings["at"].to_numpy()[order], postings["p"].to_numpy()[order]
    degree = np.bincount(code, minlength=1) if len(code) else np.zeros(0, np.int64)
    start = np.cumsum(degree) - degree
    # the rows of each group
    by_group = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[by_group], np.arange(low, high + 1))
    out_at, out_sums = [], []
    for g in range(low, high):
        rows = by_group[ends[g - low] : ends[g - low + 1]]
        if not len(rows) and not first:
            continue
        apart = np.abs(z[g] - z)
        acc = terms * apart if first else np.zeros(len(z), np.int64)
        if len(rows):
            own = np.sort(p[rows])
            upto = np.concatenate([[0], np.cumsum(own)])
            below = np.searchsorted(own, z)
            acc = acc + 2 * (z * below - upto[below] + (upto[-1] - upto[below]) - z * (len(own) - below) - len(own) * apart)
            many = degree[code[rows]]
            at = np.arange(many.sum()) + np.repeat(start[code[rows]] - (np.cumsum(many) - many), many)
            h, q, own_p = group[at], p[at], np.repeat(p[rows], many)
            both = np.abs(own_p - q) - np.abs(own_p - z[h]) - np.abs(z[g] - q) + apart[h]
            acc = acc + np.bincount(h, weights=both, minlength=len(z)).astype(np.int64)  # whole numbers far below 2^53, so exact
        out_at.append(g)
        out_sums.append(acc)
    return pa.table({"at": pa.array(out_at, pa.int32()), "sums": pa.array(out_sums, pa.list_(pa.int64()))})


def distances(index: DataFrame, groups: DataFrame, *, block: int = BLOCK, work: int = WORK, places: int = PLACES) -> DataFrame:
    """``lang, source, item, value``: the distance of each two sources of a language, both ways.

    A language's terms are dealt over blocks of ``block`` postings or ``work``
    additions at most, on average; where a language has many sources, each block
    is read by several tasks, which make ``places`` sums each.
    """
    size = index.agg(F.count("*"), F.sum("peers")).first()
    blocks = max(1, -(-size[0] // block), -(-(size[1] or 0) // work))
    with_zero = groups.filter("terms > 0").selectExpr("lang", "at", "terms", f"{share('0', 'total', 'terms')} AS zero", "sources")
    slices = F.expr(f"explode(sequence(0, CAST((CAST(sources AS LONG) * sources - 1) DIV {places} AS INT)))")
    named = index.filter("term <> ''").join(groups, ["lang", "source"]).selectExpr("lang", "term", "at", f"{share('n', 'total', 'terms')} AS p", "sources")
    rows = named.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), slices.alias("slice"), "term", "at", "p")
    peers = with_zero.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), slices.alias("slice"), F.col("at").alias("peer"), "terms", "zero")

    def of_block(key: tuple, postings: pa.Table, about: pa.Table) -> pa.Table:
        lang, number, part = (k.as_py() for k in key)
        count = about.num_rows
        cuts = -(-count * count // places)
        low, high = part * count // cuts, (part + 1) * count // cuts
        sums = accumulated(postings, about, number == 0, low, high)
        return pa.table({"lang": pa.array([lang] * sums.num_rows, pa.string()), **{c: sums[c] for c in ("at", "sums")}})

    key = ["lang", "block", "slice"]
    made = rows.groupBy(*key).cogroup(peers.groupBy(*key)).applyInArrow(of_block, "lang string, at int, sums array<long>")
    each = made.select("lang", "at", F.posexplode("sums").alias("other", "sum")).filter("at <> other")
    twice = each.groupBy("lang", F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b")).agg(F.sum("sum").alias("twice"))
    ways = F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("other")), F.struct(F.col("b").alias("at"), F.col("a").alias("other")))
    both = twice.select("lang", F.explode(ways).alias("w"), (F.expr("twice DIV 2")).alias("value")).select("lang", "w.at", "w.other", "value")
    source = groups.select("lang", "at", "source")
    item = groups.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    found = both.join(source, ["lang", "at"]).join(item, ["lang", "other"]).select("lang", "source", "item", "value")
    # languages without a kept term: all their groups are equal
    bare = groups.filter("terms = 0")
    same = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return found.unionByName(same)


def leaning_terms(index: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: terms that a group has more of than its language, by the difference; ranks to ``top``."""
    rows = index.filter("term <> ''").join(groups, ["lang", "source"])
    rows = rows.selectExpr("lang", "source", "term AS item", f"{share('n', 'total', 'terms')} - {share('lang_n', 'lang_total', 'terms')} AS value").filter("value > 0")
    return ranked(rows).filter(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def audit(docs: DataFrame, *, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language stands to the others, and its leading terms.

    ``docs`` has text, lang and source; each null counts as an empty string. A
    group without any term still stands against its peers; in a language that
    keeps no term all distances are 0. Texts are read whole, of any length, and
    repeated rows count each time; equal values are ranked by the bytes of their
    item. An empty table gives no rows; other columns are ignored.
    """
    index = stored(index_of(docs, least), "term-index")
    groups = stored(groups_of(index), "term-groups")
    pairs = ranked(distances(index, groups)).withColumn("part", F.lit("pair"))
    terms = leaning_terms(index, groups, top).withColumn("part", F.lit("term"))
    out = stored(pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "divergence")
    discard(index, groups)
    return out


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: every pair of sources within a language, and each source's 50 leading terms."""
    return audit(table(spark, sf_dir, "documents"))


_SHARE = "1 + ((({n} + 5)::HUGEINT * 1000000000) // ({total} + 5 * v))"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
vocabulary AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="g.total")} AS p, {_SHARE.format(n="k.n", total="vo.total")} AS q
  FROM groups g JOIN vocabulary vo ON g.lang = vo.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= {TOP}
"""
