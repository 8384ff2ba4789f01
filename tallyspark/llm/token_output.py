"""Token-ID output: Parquet list columns of ids, dictionary or delta encoded, read back selectively.

A file holds ``doc_id``, ``start`` (ids before the document within its part), ``n_tokens``, ``part`` and
the list ``ids``, in ascending ``doc_id`` order over the parts. ``ids`` is dictionary encoded, the integer
columns are delta encoded (writer version 2), row groups and pages are bounded in bytes and rows, and the
writer's page indexes let a read of a range of ids skip pages. Metadata reads never touch ``ids``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import sliced, small_batches
from .tokens import encoder, gathered

SCHEMA = "doc_id long, start long, n_tokens long, part int, ids array<int>"

#: Settings of the Parquet writer.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
}


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids with the end id, in ascending order of ``id_col``.

    Null and empty texts give the end id alone. Null ids come first. Rows of equal id are ordered by a
    hash of their text; repeated rows stay. An empty table gives files without rows. Columns other than
    the two named are ignored. The rows are dealt by ranges of (id, text hash), so that a third of all
    rows under one id still spreads.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]

    def encode(batches):
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in gathered(batches, "text"):
            ids, counts = enc.encode_batch(batch.column("text"), end_id)
            ends = np.cumsum(counts)
            starts, start = start + ends - counts, start + int(ends[-1]) if len(ends) else start
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view("<i4")))
            part_of = pa.array(np.full(len(counts), part, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(counts), part_of, lists], ["doc_id", "start", "n_tokens", "part", "ids"])

    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    with small_batches(docs.sparkSession):
        dealt.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """The files as written; filters on ``doc_id`` reach the page indexes, unread columns stay on disk."""
    return spark.read.schema(SCHEMA).parquet(path)


def part_offsets(table: DataFrame) -> DataFrame:
    """Ids before each part: one row for each file, from the integer columns alone."""
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files at ``path``."""

    def digest(batches):
        for batch in sliced(batches):
            lists = batch.column("ids")
            offsets = lists.offsets.to_pylist()
            raw = memoryview(lists.values.cast(pa.int32()).buffers()[1] or b"") if offsets[-1] else memoryview(b"")
            base = lists.values.offset
            crcs = [zlib.crc32(raw[4 * (a + base) : 4 * (b + base)]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens", "part")), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "part", "ids_crc32"])

    table = read_token_table(spark, path)
    rows = table.mapInArrow(digest, "doc_id long, start long, n_tokens long, part int, ids_crc32 long")
    found = rows.join(part_offsets(table), "part")
    return found.select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
