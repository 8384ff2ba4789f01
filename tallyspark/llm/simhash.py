"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code, a product of repetition codes of odd block lengths: every
fingerprint has exactly one nearest anchor, found block by block by majority, within the covering radius.
If x and y differ in at most ``distance`` bits, the anchor of x lies within covering radius plus distance
of y. Of the anchors at that range only those can be the nearest of such an x whose cell is reached by
turning at most ``distance`` bits of y, so y is replicated to these and no others. Pairs are compared per
anchor, x at home and y visiting; as each fingerprint has one home, each link is found once.

The code is chosen by the number of distinct fingerprints, so that few are at home at one anchor whatever
the corpus; equal fingerprints are one before anything is replicated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, fresh, sliced
from .tokens import forget

#: Distinct fingerprints at home at one anchor, on average.
AT_HOME = 32


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles, repeats included; zero without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and the six white-space bytes alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s - 1 for s in starts[width:]] + [len(joined)]
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)]
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        block = np.array(hashes[k : k + 65536], dtype="<u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def code_blocks(n: int) -> list[int]:
    """Odd block lengths of the covering code for ``n`` distinct fingerprints, 64 bits at most in all."""
    number = min(64, max(6, math.ceil(math.log2(max(n, 1) / AT_HOME + 1))))
    length = (64 // number - 1) | 1
    blocks = [length] * number
    for k in range((64 - length * number) // 2):
        blocks[k % number] += 2
    return blocks


def anchors(prints: np.ndarray, blocks: list[int], distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each print; and all anchors that it visits, as (index of print, anchor).

    Turning a block's majority costs (length + 1) / 2 bits less those already against it; the print visits
    every anchor reached at a cost of ``distance`` (at most 2) or less, its home included.
    """
    assert 0 <= distance <= 2
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    home, cost, at = np.zeros(len(prints), dtype=np.int64), [], 0
    for k, length in enumerate(blocks):
        ones = bits[:, at : at + length].sum(axis=1, dtype=np.int64)
        home |= (2 * ones > length).astype(np.int64) << k
        cost.append((length + 1) // 2 - np.minimum(ones, length - ones))
        at += length
    who, where = [np.arange(len(prints))], [home]
    for k in range(len(blocks)):
        for j in range(k, len(blocks)):
            total = cost[k] if j == k else cost[k] + cost[j]
            turned = np.int64((1 << k) | (1 << j) if (1 << k) | (1 << j) < 1 << 63 else ((1 << k) | (1 << j)) - (1 << 64))
            (rows,) = np.nonzero(total <= distance)
            who.append(rows)
            where.append(home[rows] ^ turned)
    return home, np.concatenate(who), np.concatenate(where)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, fp)``: the fingerprint of each whole text."""
    def run(batches):
        forget()
        for batch in sliced(batches):
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints.view(np.int64))], ["doc_id", "row", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def links(nodes: DataFrame, n: int, distance: int) -> DataFrame:
    """Each unordered pair ``(a, b)`` of distinct fingerprints ``fp`` within ``distance`` bits, once."""
    blocks = code_blocks(n)

    def at_home(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchors(prints.view(np.uint64), blocks, 0)[0]), batch.column("fp")], ["anchor", "a"])

    def visiting(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            _, who, where = anchors(prints.view(np.uint64), blocks, distance)
            for k in range(0, len(who), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(where[k : k + 100_000]), pa.array(prints[who[k : k + 100_000]])], ["anchor", "b"])

    homes = nodes.select("fp").mapInArrow(at_home, "anchor long, a long")
    visits = nodes.select("fp").mapInArrow(visiting, "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # Spark takes the visits to be as large as the prints that make them, some fifty for each; as a broadcast they fill the driver.
    return homes.join(visits.hint("merge"), "anchor").filter(near).select("a", "b")


def simhash_components(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Scratch]:
    """``(doc_id, row, fp, component_id, keeper)`` for every row; ``row`` is a hash of id and text.

    ``component_id`` is the least id in the row's component (null only if all its ids are null), ``keeper``
    the ``row`` of one document of it: least id first, nulls last, then least hash. Texts without words,
    null and empty ones among them, have fingerprint zero and link like any other; equal fingerprints
    link, so repeated rows and ties share a component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    # Merge joins: a table with a row for each print or component may pass as small by its packed files, and fill the driver as a broadcast.
    rows = scratch.write(fingerprints(docs, id_col, text_col), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = scratch.write(rows.groupBy("fp").agg(first), "nodes")
    found = scratch.write(links(nodes, nodes.count(), distance), "links")
    stars = scratch.write(connected_components(found, scratch), "stars")
    rooted = scratch.write(nodes.join(stars.hint("merge"), nodes.fp == stars.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = scratch.write(rooted.join(least.hint("merge"), "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keeper")), "named")
    return rows.join(named.hint("merge"), "fp"), scratch


def simhash_near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; see ``simhash_components``."""
    found, _ = simhash_components(docs, distance, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all its columns unchanged, whatever their names.

    Null and empty texts are of one component; of rows repeated whole one stays; an empty table stays empty.
    """
    found, scratch = simhash_components(docs, distance, id_col, text_col)
    keepers = scratch.write(found.filter(F.col("row") == F.col("keeper")).select(F.struct("doc_id", "row").alias("of")), "keepers")
    kept, (of, ours, n) = keepers.distinct(), fresh(docs, "of", "ours", "n")
    kept = kept.withColumnRenamed("of", of)
    name = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"))
    held = docs.withColumn(ours, name).join(kept.hint("merge"), F.col(ours) == F.col(of), "left_semi")
    if keepers.count() > kept.count():  # rows repeated whole, id and text
        held = held.withColumn(n, F.row_number().over(Window.partitionBy(ours).orderBy(F.lit(0)))).filter(F.col(n) == 1).drop(n)
    return held.drop(ours)
