"""Token-id files: Parquet list columns in document order, readable by document and by column."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.tables import parallelism
from terraloom.llm.text import parts
from terraloom.llm.tokens import coder, tokenizer_path
from terraloom.session import materialize, ship_package
from terraloom.sources.files import scratch

#: Row groups of 16 MB and pages of at most 512 documents with column and offset indexes: a filter on doc_id reads few pages.
#: Ids are dictionary-encoded (bit-packed indexes), the ascending doc_id and the counts as deltas (version 2 pages).
FORMAT = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20),
    "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.column.index.enabled#doc_id": "true",
}


#: Bytes of text that a worker encodes at once; its copies, word tables and ids, and the batch that the JVM holds, go with it.
ENCODED_AT_ONCE = 4_000_000


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, tokens) of batches (doc_id, text), in their order."""
    encoder = coder(path, True, end_id)
    for batch in batches:
        for s, e in parts(batch.column(1), ENCODED_AT_ONCE):
            ids = encoder.encode(batch.column(1).slice(s, e - s))
            sizes = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(sizes), lists], ["doc_id", "n_tokens", "tokens"])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, options: dict[str, str] | None = None) -> None:
    """Encode every text and write (doc_id, n_tokens, tokens) in ascending doc_id order over numbered files.

    The order of files and of rows in them is the order of documents: a null doc_id comes first, rows of one doc_id follow
    by a hash of the text. Null text encodes as the end id alone; an empty table gives files without rows.
    """
    ship_package(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_order", F.xxhash64("text")).repartitionByRange(parallelism(docs), "doc_id", "_order").sortWithinPartitions("doc_id", "_order")
    coded = rows.select("doc_id", "text").mapInArrow(lambda batches: token_batches(batches, path, end_id), "doc_id bigint, n_tokens bigint, tokens array<int>")
    coded.write.options(**{**FORMAT, **(options or {})}).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Selected columns of selected documents; the filter reaches row groups and page indexes, unread columns stay on disk."""
    df = spark.read.schema("doc_id bigint, n_tokens bigint, tokens array<int>").parquet(folder)
    if where is not None:
        df = df.where(where)
    return df.select(*(columns or df.columns))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files.

    start adds the totals of the earlier files (one row per file) to a running sum inside the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(lists) else np.zeros(0, np.int64)
            body, starts = memoryview(flat.tobytes()), np.append(0, ends)[:-1]
            sums = [zlib.crc32(body[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)],
                                             ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    files = read_tokens(spark, folder)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    rows = files.select("doc_id", "tokens", number.alias("file"), F.col("_metadata.row_index").alias("row")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file bigint, row bigint")
    rows = materialize(rows)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, **settings) -> DataFrame:
    """Write the files to shared storage and return their index."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    write_tokens(docs, folder, **settings)
    return token_index(spark, folder)
