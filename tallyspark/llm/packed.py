"""Which marks of a corpus occur more than once, with the marks packed in binary columns.

A mark is a 64-bit value that stands for a short stretch of a document. There is one for every few bytes
of the corpus, so they travel as packed arrays, one row for each batch of documents and shard of the mark
space, never a row for each mark. Marks repeated within a batch are settled there: all their documents
hear of it at once, and one entry goes on to tell other batches. A shard so gets at most one entry of a
mark from each batch, however many documents of the corpus hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced

#: Text bytes for each shard of marks.
SHARD_BYTES = 32 << 20

MARKS = "shard int, key_id long, key_hash long, marks binary, ids binary, hashes binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shards_for(docs: DataFrame, text_col: str) -> int:
    """Shards such that each holds the marks of a bounded share of the text."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first().n or 0
    return max(24, -(-size // SHARD_BYTES))


def by_shard(values: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that ``values`` touch, with the indices of its values, in order."""
    shard = (mix(values ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    for s, rows in zip(found.tolist(), np.split(order, first[1:])):
        yield s, rows


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.nonzero(sorted_values[1:] != sorted_values[:-1])[0] + 1])
    return first, np.diff(np.append(first, len(sorted_values)))


def unpack(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def by_document(marks: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``(key_id, key_hash, marks)`` for each document among the parallel arrays."""
    order = np.lexsort((hashes, ids))
    m, i, h = marks[order], ids[order], hashes[order]
    if not len(m):
        return
    first = np.concatenate([[0], np.nonzero((i[1:] != i[:-1]) | (h[1:] != h[:-1]))[0] + 1, [len(m)]])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield int(i[a]), int(h[a]), m[a:b].tobytes()


def repeated_marks(keyed: DataFrame, marks_of: Callable[[bytes], np.ndarray], shards: int, scratch: Scratch) -> DataFrame:
    """``key_id, key_hash, marks`` of each document with a mark that occurs twice or more.

    ``keyed`` has ``key_id, key_hash, text`` (binary, or null); ``marks_of`` gives the marks of a text,
    repeats included. ``marks`` is a list of packed little-endian unsigned 64-bit values.
    """

    def gather(batches):
        for batch in sliced(batches):
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key_id", "key_hash"))
            found = [marks_of(t or b"") for t in batch.column("text").to_pylist()]
            marks = np.concatenate([np.zeros(0, np.uint64), *found])
            doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
            order = np.argsort(marks, kind="stable")
            marks, doc = marks[order], doc[order]
            first, length = runs(marks)
            again = np.repeat(length > 1, length)
            rows = [(-1, i, h, m, None, None) for i, h, m in by_document(marks[again], ids[doc[again]], hashes[doc[again]])]
            marks, doc = marks[first], doc[first]
            for s, at in by_shard(marks, shards):
                at = at[np.argsort(doc[at], kind="stable")]
                rows.append((s, None, None, marks[at].tobytes(), ids[doc[at]].tobytes(), hashes[doc[at]].tobytes()))
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["shard", "key_id", "key_hash", "marks", "ids", "hashes"])

    def confirm(table: pa.Table) -> pa.Table:
        marks, ids, hashes = unpack(table["marks"], "<u8"), unpack(table["ids"], "<i8"), unpack(table["hashes"], "<i8")
        order = np.argsort(marks, kind="stable")
        _, length = runs(marks[order])
        again = order[np.repeat(length > 1, length)]
        rows = list(by_document(marks[again], ids[again], hashes[again]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["key_id", "key_hash", "marks"])

    packed = scratch.write(keyed.mapInArrow(gather, MARKS), "marks")
    settled = packed.filter("shard < 0").select("key_id", "key_hash", "marks")
    others = packed.filter("shard >= 0").select("shard", "marks", "ids", "hashes").groupBy("shard").applyInArrow(confirm, "key_id long, key_hash long, marks binary")
    out = scratch.write(settled.union(others).groupBy("key_id", "key_hash").agg(F.collect_list("marks").alias("marks")), "repeated")
    scratch.drop("marks")
    return out
