"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of all words. Each of its documents is taken whole,
so many times for certain as the target holds the source whole; what remains of
the target is filled by a sample without replacement. A document's chance p of
that extra copy grows with its measure x, the root of its length, so that long
documents bring most of the words and short ones aren't crowded out:

    p = min(1, rate * x),        rate such that the expected words are the remainder,

and where p reaches 1 the extra copy is certain too. Every other document draws
a random number u in (0, 1) from a hash of its id and is ranked by

    (u / (1 - u)) / (p / (1 - p)),

the random odds divided by the inclusion odds. Documents are taken in that order
until the words that they bring come nearest to the remainder: the sample's size
in words is fixed, and its cut lies near 1 as in any Pareto sample.

No source is sorted as a whole. Words are first summed in ``BINS`` bins of the
rank, so one bin of each source holds the cut, and only its rows are ordered.
The table of targets has one row a source and is worked out in one task, which
suits up to some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
CAP = 3
#: Bins of the rank; the cut's bin holds about one in BINS of a source's rows.
BINS = 4096
#: Up to this many sources the table of targets (under 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 10_000
#: Hexadecimal digits of the hash that make the random number.
DIGITS = 13


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words of each source, from (source, source_size).

    The weights share all words; a source stops at ``cap`` times its size and
    the others share its excess by weight. With sources in order of
    cap / weight the capped ones come first, so two running sums find them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("turn", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("turn") + 1).cast("int"))
    )
    by_ratio = Window.orderBy((F.col("source_size") * cap) / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    limit = F.col("source_size") * cap
    run = (
        weighed.withColumn("words", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped_words", F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("at_cap", limit * (F.col("weights") - F.col("capped_weight")) <= F.col("weight") * (F.col("words") - F.col("capped_words")))
    )
    left_words = F.first("words").over(everything) - F.coalesce(F.sum(F.when(F.col("at_cap"), limit)).over(everything), F.lit(0))
    left_weight = F.first("weights").over(everything) - F.coalesce(F.sum(F.when(F.col("at_cap"), F.col("weight"))).over(everything), F.lit(0))
    return run.select(
        "source",
        "source_size",
        F.when(F.col("at_cap"), limit.cast("double")).otherwise(F.col("weight") * left_words / F.nullif(left_weight, F.lit(0))).alias("target"),
    )


def chance(key: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from a hash of ``key``: the same in each run and on each executor."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(16**DIGITS))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, *, name: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for each row of ``docs``.

    Null or empty texts have size 0 and no extra copy. A null source is a source
    of its own, the last; a source without words takes nothing. Rows with the
    same id share a random number and are ranked by chance, then size; equal rows
    are alike, so either may be the last one taken. An empty table gives an empty
    result. Columns other than doc_id, text, source are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), chance(F.col("doc_id")).alias("u"))
    sized = stored(sized.withColumn("x", F.ceil(F.sqrt("size"))), f"{name}-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    goal = (
        stored(goal, f"{name}-targets")
        .withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of")
    )
    goal = stored(goal.join(rates(sized, goal), F.col("of").eqNullSafe(F.col("rated")), "left").drop("rated"), f"{name}-rates")
    goal = F.broadcast(goal) if goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else goal
    p = F.least(F.lit(1.0), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("x"))
    odds = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = sized.join(goal, sized["source"].eqNullSafe(goal["of"])).withColumn("p", p).withColumn("odds", odds).drop("of", "rate")
    ranked = ranked.withColumn("bin", F.coalesce(F.floor(F.col("odds") / (1 + F.col("odds")) * BINS), F.lit(BINS)))

    along = Window.partitionBy("source").orderBy("bin")
    bins = ranked.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(along))
    bins = stored(bins.withColumn("from", F.col("upto") - F.col("words")), f"{name}-bins")
    #: One row a source: bins before cut_bin are taken, later ones aren't.
    cut = bins.filter(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", "from")).alias("cut"))
    cut = cut.select(F.col("source").alias("of"), F.col("cut.bin").alias("cut_bin"), F.col("cut.from").alias("cut_from"))
    cut = F.broadcast(cut) if goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else cut
    placed = ranked.join(cut, ranked["source"].eqNullSafe(cut["of"]), "left").drop("of")
    at_cut = F.col("bin").eqNullSafe(F.col("cut_bin"))
    clear = placed.filter(~at_cut).withColumn("extra", F.when((F.col("p") > 0) & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))), 1).otherwise(0))
    inside = Window.partitionBy("source", "bin").orderBy("odds", F.col("doc_id").asc_nulls_last(), "size")
    close = placed.filter(at_cut).withColumn("upto", F.col("cut_from") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    start, end, rest = F.col("upto") - F.col("size"), F.col("upto"), F.col("rest")
    nearest = (end <= rest) | ((start < rest) & (start + end <= 2 * rest))
    close = close.withColumn("extra", F.when((F.col("p") > 0) & nearest, 1).otherwise(0))
    kept = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies")]
    return clear.select(*kept).unionByName(close.select(*kept))


def rates(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """``rated, rate``: for each source the factor by which min(1, rate * x) expects the words ``rest``.

    Measures go down from the largest: those whose chance would pass 1 are
    certain, and the first that doesn't gives the rate. Sums are whole numbers.
    """
    down = Window.partitionBy("source").orderBy(F.col("x").desc())
    levels = sized.filter("x > 0").groupBy("source", "x").agg(F.sum("size").alias("words"))
    levels = levels.withColumn("certain", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = levels.withColumn("measured", F.sum(F.col("x") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    levels = levels.join(goal.select("of", "rest"), F.col("source").eqNullSafe(F.col("of")))
    left = F.col("rest") - F.col("certain")
    fits = levels.filter(left * F.col("x") <= F.col("measured"))
    return fits.groupBy(F.col("source").alias("rated")).agg(F.max_by(left / F.col("measured"), "x").alias("rate"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat(docs: DataFrame, *, name: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns stay.

    doc_id must tell rows apart here: rows that share an id get the largest
    number of copies that one of them has. A row without id is taken as often as
    any of these is.
    """
    copies = mix(docs, name=name).groupBy("doc_id").agg(F.max("copies").alias("copies")).filter("copies > 0")
    # columns travel packed, so none can clash with those of the mix
    packed = docs.select(F.col("doc_id").alias("of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = packed.join(copies, packed["of"].eqNullSafe(copies["doc_id"]))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])


OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         (CAST('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:{DIGITS}] AS BIGINT) + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE AS u
  FROM documents),
measured AS (SELECT *, ceil(sqrt(size))::BIGINT AS x FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM per),
run AS (
  SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER w, 0) AS capped_words, coalesce(sum(weight) OVER w, 0) AS capped_weight
  FROM weighed
  WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 3 * source_size * (weights - capped_weight) <= weight * (words - capped_words) AS at_cap FROM run),
goal AS (
  SELECT source, source_size,
    CASE WHEN at_cap THEN (3 * source_size)::DOUBLE
      ELSE (weight * (words - coalesce(sum(CASE WHEN at_cap THEN 3 * source_size END) OVER (), 0)))::DOUBLE
        / nullif(weights - coalesce(sum(CASE WHEN at_cap THEN weight END) OVER (), 0), 0)::DOUBLE END AS target
  FROM capped),
parts AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM goal),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
levels AS (
  SELECT source, x, sum(size)::BIGINT AS words FROM measured WHERE x > 0 GROUP BY source, x),
sums AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS certain,
    (sum(x * words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS total
  FROM levels),
rates AS (
  SELECT s.source, arg_max((rest - certain) / total, x) AS rate
  FROM sums s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE (rest - certain) * x <= total GROUP BY s.source),
chances AS (
  SELECT s.doc_id, s.size, s.u, r.*, least(1e0, coalesce(t.rate, 0e0) * s.x) AS p
  FROM measured s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN rates t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, CASE WHEN p >= 1 THEN 0e0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM chances),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM odds)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN p > 0 AND (upto <= rest OR (upto - size < rest AND 2 * upto - size <= 2 * rest)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""
