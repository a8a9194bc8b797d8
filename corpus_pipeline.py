"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, and each works on all rows that the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skyshear.llm import bpe, jaccard, mixing, quality, secrets
from skyshear.llm.common import discard, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rule keep.

    Null and empty texts and those under 50 words go; a null language is one of
    its own. Rows are judged one by one: repeated ones and rows without id fare
    like any other. Texts of any length are judged whole; other columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    A text without words is no copy of anything and stays; rows without id stay.
    Of rows that share the least id one stays for each different text. Other
    columns stay as they are; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by its kind.

    A null text stays null, and n_chars follows the text. Rows may share an id or
    have none. Other columns stay as they are; an empty table stays empty.
    """
    return secrets.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never.

    A text without words is taken as often as its source is for certain; a null
    source is one of its own. Rows that share an id are taken as often as the one
    of them that is taken most; so are rows without id. Ties in rank go to the
    smaller id. Other columns stay as they are; an empty table stays empty.
    """
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row, copies included; a null text is empty, and an empty table gives no rows."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mix", mix),
    ("encode", encode),
]

#: SQL can't express the divergence rule's references nor the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
