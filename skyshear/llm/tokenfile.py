"""Token ids in Parquet list columns, written in document order and read back by part.

One row a document: its place, its id count and its ids. Ids are dictionary or
delta encoded, row groups and pages are small, and the page index lets a reader
fetch the ids of some documents or no ids at all. Documents are dealt by range
of doc_id before they are encoded, so files follow each other in that order and
the first id of a document is its file's start plus its start within the file;
the files' starts come from counts alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, tokenizer_path
from .common import ranges, shared_dir, table

#: The id that ends each document.
END = 0
#: How files are laid out: row groups of 16 MB, pages of 128 KB or 2,000 documents with an index,
#: a dictionary of up to 1 MB of ids and, where it is too small, delta encoding.
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
}
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, to: str, path: str | None = None, *, end: int | None = END, files: int | None = None) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to the folder ``to``, by ascending doc_id.

    A null text is empty: only the end id. Null ids come first; rows that share
    an id follow each other in the order of their texts' hashes. Texts are whole, and
    an empty table makes files without rows. Extra columns are ignored. There are
    ``files`` files, as a rule so many that each takes 128 MB of the input at most.
    """
    path = path or tokenizer_path()
    n = files or ranges(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = codec(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, ids, counts in own.stretches(batch, 1):
                if end is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                values = pa.array(ids.view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), pa.array(counts), pa.ListArray.from_arrays(offsets, values)],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                at += int(counts.sum())

    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(to)


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids before each file, one row a file; reads counts, no ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_index(spark: SparkSession, at: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of each document, without reading ids."""
    files = spark.read.schema(SCHEMA).parquet(at)
    return files.join(F.broadcast(part_starts(files)), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """``doc_id, part, start_in_part, n_tokens, ids`` as written; filters on doc_id reach the page index."""
    return spark.read.schema(SCHEMA).parquet(at)


def crc_of_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            offsets = ids.offsets.to_numpy() * 4
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(part_starts(files)), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads each one's place, count and checksum back."""
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), to)
    return crc_of_ids(read_tokens(spark, to))
