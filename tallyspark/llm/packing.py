"""Best-fit packing of token documents into sequences of a fixed length, in bulk-synchronous sweeps.

Lengths are integers of at most ``limit``, so pieces of one length, and gaps of one size, are
interchangeable: the range-sorted documents and gaps are held as runs (length, count), at most one for
each length and never a row for each document. A sweep goes down the lengths; the pieces of a length
look up their successor, the smallest gap that holds them, in bulk; where pieces and gaps of a run
conflict, rank decides (the k-th piece of the run takes the k-th gap); the gaps are updated and the
sweep repeats until each piece has a place. The plan that results, runs of ranks mapped to runs of
sequences, is bounded by the number of lengths, not by the corpus. The rows then find their place by
their rank among pieces of their length, counted in parallel over the parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encoder, gathered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
#: Text bytes encoded together: less than could be, as the stage before may have left the executor's heap full.
TOGETHER = 4 << 20
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def best_fit_plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that place ``counts`` pieces of each length.

    Longer pieces go first; each run of pieces takes the smallest gaps that hold it, and new sequences
    only where no gap does.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # runs (first sequence, number) by gap
    sizes: list[int] = []  # the gaps in order
    made = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-(end - rank) // (limit // length))
                first, made, gap = made, made + n, limit
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                if n > end - rank:
                    add(gap, first + end - rank, n - (end - rank))
                    n = end - rank
            n = min(n, end - rank)
            plan.append((length, rank, rank + n, first, limit - gap))
            rank += n
            add(gap - length, first, n)
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every whole text; of a document that is cut, the first piece takes what is left over."""

    def cut(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in gathered(batches, "text", TOGETHER):
            ids, totals = enc.encode_batch(batch.column("text"), end_id)
            first = (totals - 1) % limit + 1
            numbers = 1 + (totals - first) // limit
            doc = np.repeat(np.arange(len(totals)), numbers)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
            length = np.where(piece == 0, first[doc], limit)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * limit)
            raw, at = memoryview(ids).cast("B"), 4 * ((np.cumsum(totals) - totals)[doc] + start)
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            # Ranks among the pieces of one length that this part has seen.
            order = np.argsort(length, kind="stable")
            sorted_lengths = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(sorted_lengths, sorted_lengths) + seen[sorted_lengths]
            seen += np.bincount(length, minlength=limit + 1)
            columns = piece.astype(np.int32), start, length, crcs, np.full(len(doc), part, np.int32), rank
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(c, k) for c, k in zip(columns, kinds))], NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document with its sequence and its offset there.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is the
    end id alone; null and repeated ids are documents of their own; an empty table gives no rows; other
    columns are ignored. Equal lengths are ranked by part and place in it, so ties need no order of rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer, end_id, limit, id_col, text_col), "pieces")
    tallies = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    plan = spark.createDataFrame(best_fit_plan(counts, limit), "length long, rank_from long, rank_to long, first_sequence long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = tallies.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("local_rank") + F.col("base"))
    runs = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank_from", "first_sequence", "offset"))).alias("runs"))
    # The last run that starts at or before the rank; a length has few runs, and there are at most `limit` lengths.
    run = F.element_at(F.filter("runs", lambda r: r.rank_from <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(runs), "length").withColumn("run", run)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.first_sequence") + F.col("rank") - F.col("run.rank_from")).alias("sequence_id"), F.col("run.offset").alias("offset"))
