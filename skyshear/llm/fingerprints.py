"""Document fingerprints by threshold-scaled sketches, in DataFrame functions alone.

A fingerprint keeps every hash of the text's five-word shingles that lies below
a fixed fraction of all hashes. What is kept depends on the hash alone, so two
fingerprints hold the same share of what their texts have in common, however
unequal these are in length: resemblance and containment follow from counting,
and the fingerprint of several texts together is the union of theirs.

A text with words whose hashes all miss the fraction keeps its least hash, so
that short texts can be told apart too. It drops out of a union with any hash
below the fraction, so unions still equal what the joined sets would give.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

#: Words of a shingle; the share of all hashes that a fingerprint keeps.
SHINGLE, FRACTION = 5, 0.25
#: Rows of a run of ids, and runs at most: their first ids, 8 bytes each, are broadcast.
RUN, RUNS = 512, 1 << 18


def hashes(text: Column, k: int = SHINGLE) -> Column:
    """A 64-bit hash of each k-word shingle; fewer words make one shingle, none make none. Words are hashed once each."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    codes = F.transform(words, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, every).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(codes), shingled), 0)  # the array is one element of another, so it is computed once


def limit_of(fraction: float) -> int:
    """Hashes from 0 to below this are that fraction of all 2^64."""
    if not 0 < fraction <= 0.5:
        raise ValueError("the fraction must be above 0 and at most a half")
    return int(fraction * 2**64)


def kept(found: Column, limit: int) -> Column:
    """The hashes from 0 to below ``limit``, or, without any, the least one (as an unsigned number); sorted, each once."""

    def chosen(h: Column) -> Column:
        low = F.filter(h, lambda x: (x >= 0) & (x < F.lit(limit)))
        least = F.coalesce(F.array_min(F.filter(h, lambda x: x >= 0)), F.array_min(h))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(least)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(found), chosen), 0)


def sketch(text: Column, *, fraction: float = FRACTION, k: int = SHINGLE) -> Column:
    """array<bigint>: the fingerprint of a text, empty for one without words.

    A null text gives null, so callers choose what it counts as. Texts of any
    length are read whole; repeated shingles count once; letters of either case
    are equal.
    """
    return kept(hashes(text, k), limit_of(fraction))


def merged(a: Column, b: Column, *, fraction: float = FRACTION) -> Column:
    """The fingerprint of both shingle sets together."""
    return kept(F.array_union(a, b), limit_of(fraction))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def resemblance(a: Column, b: Column) -> Column:
    """The estimated share of both texts' shingles that both have; 1 for two empty fingerprints, 0 for one."""
    both = shared(a, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(shared(a, b) / F.size(a))


def written(a: Column) -> Column:
    """The hashes in hexadecimal, 16 digits each, ascending."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def followed(docs: DataFrame, *, fraction: float = FRACTION) -> DataFrame:
    """``doc_id, text, mark, next_text, next_mark``: each document with its fingerprint and those of the next one by descending doc_id; the first follows the last.

    Ids are dealt into runs of equal width, RUN rows each on average, and texts
    move once, to their run. The first document of a run is also sent to the run
    above it, as what follows the last there. Where ids are very uneven a run is
    longer; its task then sorts and spills more. doc_id is a number. Rows of one
    doc_id follow each other by text; a null doc_id comes last; a null text is
    empty. A single document follows itself; an empty table stays empty. Other
    columns are ignored.
    """
    low, high, count = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    runs = min(max(1, -(-count // RUN)), RUNS)
    width = max((float(high) - float(low)) / runs, math.ulp(1.0)) if low is not None else 1.0
    top = F.lit(float(high if high is not None else 0))
    run = F.coalesce(F.least(F.floor((top - F.col("doc_id").cast("double")) / width), F.lit(runs - 1)), F.lit(runs)).cast("long")
    firsts = docs.groupBy(run.alias("_run")).agg(F.max("doc_id").alias("_first"))
    order = Window.orderBy("_run")  # over RUNS rows at most
    above = F.coalesce(F.lag("_run").over(order), F.max("_run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = F.broadcast(firsts.select("_first", above.alias("_above")))
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"), sketch(text, fraction=fraction).alias("mark"), run.alias("_own"))
    rows = rows.join(ends, rows["doc_id"].eqNullSafe(ends["_first"]), "left")
    places = F.array(F.struct(F.col("_own").alias("run"), F.lit(False).alias("sent")), F.struct(F.col("_above").alias("run"), F.lit(True).alias("sent")))
    dealt = rows.select("doc_id", "text", "mark", F.explode(F.filter(places, lambda p: p["run"].isNotNull())).alias("_at"))
    dealt = dealt.select("doc_id", "text", "mark", F.col("_at.run").alias("_run"), F.col("_at.sent").alias("_sent"))
    within = Window.partitionBy("_run").orderBy("_sent", F.col("doc_id").desc_nulls_last(), "text")
    ahead = dealt.select("doc_id", "text", "mark", "_sent", F.lead("text").over(within).alias("next_text"), F.lead("mark").over(within).alias("next_mark"))
    return ahead.filter(~F.col("_sent")).drop("_sent")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last third of code points, rounded down, replaced by the first as many (or all) of ``other``."""
    n = F.char_length(text)
    part = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - part), F.substring(other, F.lit(1), part))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    near_edited and near_next are resemblances; the containments say which share
    of the document's shingles the other text has.
    """
    rows = followed(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    # the new text is taken out of the row once, as one element of an array, for its digest and its fingerprint
    rows = rows.withColumn("new", F.get(F.transform(F.array("changed"), lambda t: F.struct(F.sha2(t, 256).alias("sha"), sketch(t).alias("mark"))), 0))
    old, new, after = F.col("mark"), F.col("new.mark"), F.col("next_mark")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.col("new.sha").alias("edited_sha256"), written(old).alias("fingerprint"), written(new).alias("edited_fingerprint"),
        resemblance(old, new).alias("near_edited"), resemblance(old, after).alias("near_next"), containment(old, new).alias("in_edited"), containment(old, after).alias("in_next"),
    )
