"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Each version of a path is content-addressed by the SHA-256 of its text. The
ledger remembers which (blob, rules version) pairs were scanned and what they
held, so a run scans the blobs that no earlier run saw and joins the findings
back to every path that holds the blob, however many there are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, text_of


def either_case(word: str) -> str:
    """``word`` as a pattern in which each letter has either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, the group whose length counts, the least length. The first three are the base; the order of kinds breaks ties.
RULES = (
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("login", r"[a-z][a-z0-9+]*://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@", 0, 1),
)
BASE = ("assign", "access", "hex")
#: Goes up when a rule changes: blobs are then scanned anew.
RULES_VERSION = 1
LEDGER = "blob string, rules_version int, spans array<struct<start:int,ord:int,kind:string,end:int>>"


def spans_of(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array of (start, ord, kind, end) in code points, for matches whose group is long enough.

    The text splits into what stands between matches; lengths of both, summed, give positions.
    """
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.slice(F.split(text, pattern, -1), 1, F.regexp_count(text, F.lit(pattern))).alias("gap"),
    )
    none = F.lit(None).cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    first = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["hit"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.char_length(part["value"]) >= least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, first, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>"))


#: Sieves for kinds whose own pattern also matches where their length fails.
SIEVES = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}


def may_hold(text: Column, rules: tuple = RULES) -> Column:
    """Whether a rule may find something: a sieve before positions are worked out."""
    return reduce(lambda a, b: a | b, [text.rlike(SIEVES.get(kind, pattern)) for kind, pattern, _, _ in rules])


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, rules: tuple = RULES, version: int = RULES_VERSION) -> DataFrame:
    """The ledger's new rows: ``blob, rules_version, spans`` for unseen blobs of ``versions``.

    ``versions`` has a column text; null counts as empty, which is a blob like
    any other, and texts of any length are scanned whole. Copies are reduced to
    one where they are read, before the shuffle. Matches of one kind don't
    overlap; those of different kinds may, and of equal starts the kind that RULES
    lists first comes first. Blobs without a finding get an empty array. Extra
    columns are ignored; an empty table adds nothing.
    """
    text = text_of()
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rules_version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    spans = F.array_sort(F.concat(*[spans_of(F.col("text"), k, i, p, g, n) for i, (k, p, g, n) in enumerate(rules)]))
    nothing = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    return once.select("blob", F.lit(version).alias("rules_version"), F.when(may_hold(F.col("text"), rules), spans).otherwise(nothing).alias("spans"))


def updated_ledger(versions: DataFrame, path: str, *, rules: tuple = RULES, version: int = RULES_VERSION) -> DataFrame:
    """The ledger kept at ``path``, after what ``versions`` adds to it.

    The first run makes it. A later one scans only (blob, version) pairs that it
    lacks and appends them; nothing that is in it changes. A run that fails adds
    nothing, so it can be repeated. One run may write at a time.
    """
    spark = versions.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    new = scan(versions, spark.read.schema(LEDGER).parquet(path) if there else None, rules=rules, version=version)
    new.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, *, version: int = RULES_VERSION, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans`` of each row of ``versions``; the same blob under many paths is one key that AQE may split.

    Only blobs with a finding take part in the join, so a common text without
    one costs nothing.
    """
    found = ledger.filter((F.col("rules_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), "spans")
    paths = versions.select(*keep, F.sha2(text_of(), 256).alias("_of"))
    joined = paths.join(found, paths["_of"] == found["_blob"], "left").drop("_of", "_blob")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")))


def written(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, by start, then by the order of kinds."""
    some = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in each document; the ledger is a new one, in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    ledger = updated_ledger(docs, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings_by_path(docs, ledger).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(written(F.col("spans"), BASE), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def without_secrets(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """``docs`` with each found span replaced by its kind in angle brackets; rows and columns stay, n_chars follows the text.

    Of spans that overlap, what an earlier one covers isn't replaced again. A null
    text stays null; ids don't matter, so rows may share one or have none; an
    empty table stays empty. The ledger at ``path`` is used and added to; without
    one it starts empty.
    """
    ledger = updated_ledger(docs, path or f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}")
    # columns travel packed, so none can clash with those of the ledger
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = findings_by_path(packed, ledger, keep=("row",))
    text = F.col("row")["text"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.greatest(s["start"] - acc["at"], F.lit(0))
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap), F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    hit = F.size("spans") > 0
    done = found.withColumn("masked", F.when(hit, masked).otherwise(text))
    new = {"text": F.col("masked"), "n_chars": F.when(hit, F.char_length("masked")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return done.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row")[f.name]).alias(f.name) for f in docs.schema.fields])


def _sql_spans(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, n, {order} AS ord, '{kind}' AS kind,
      (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0))::BIGINT AS s,
      length(hits[i]) AS len, length(vals[i]) AS vlen, {least} AS least
    FROM (SELECT doc_id, n, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS vals,
                 string_split_regex(t, '{p}') AS gaps, unnest(range(1, 1 + len(regexp_extract_all(t, '{p}', 0)))) AS i
          FROM d WHERE regexp_matches(t, '{SIEVES.get(kind, p)}'))"""


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(i, k, p, g, m) for i, (k, p, g, m) in enumerate(RULES))}),
good AS (SELECT *, kind || ':' || s || ':' || (s + len) AS w FROM found WHERE vlen >= least),
per AS (SELECT n, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c,
  string_agg(w, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(w, ',' ORDER BY s, ord) AS spans FROM good GROUP BY n)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (n)
"""
