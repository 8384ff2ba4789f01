"""Shards balanced in bytes, tokens and rows at once, by vector bin packing of groups of equal texts.

The items to place are few whatever the corpus: groups of equal texts above a share of all bytes, of which
there can be at most ``shards * GRAIN``, and bundles of the smaller groups, by hash, ``shards * BUNDLES``
of them. Items go largest first to the shard where the dot product of the item with the residual capacity
is highest, the vectors being in shares of all bytes, tokens (blanks and one) and rows. Only groups above the
mean bytes of a shard are cut by row, as none could hold a third of the corpus and stay near the others in bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: A group above 1 / GRAIN of a shard's bytes, a grain, is an item of its own; above WHOLE grains, a shard's mean
#: bytes, no shard could hold it under the law, and it is cut into grains.
GRAIN, WHOLE = 64, 64
#: Bundles of smaller groups for each shard.
BUNDLES = 512


def place_items(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row (bytes, tokens, rows) of ``items``, placed largest first.

    The law is that of bytes, so an item goes to the shard of highest dot product among those whose bytes
    stay within the mean plus half the item, or to the shard of fewest bytes if there is none.
    """
    totals = np.maximum(items.sum(axis=0), 1).astype(float)
    share = items / totals * shards
    left, bytes_left = np.ones((shards, 3)), np.ones(shards)
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -items[:, 0])):
        fits = bytes_left >= share[i, 0] / 2
        scores = np.where(fits, left @ share[i], -np.inf)
        best = int(np.argmax(scores if fits.any() else bytes_left))
        out[i] = best
        left[best] -= share[i]
        bytes_left[best] -= share[i, 0]
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, under the law ``bytes``.

    Size is the text's UTF-8 bytes plus 8; a null text counts as empty. Equal texts share a shard unless
    their group is above the mean bytes of a shard. Null and repeated ids are rows of their own; other columns are
    ignored; an empty table gives no rows. Slots follow a hash of the row within each shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        (F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long").alias("tokens"),
    )
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    total = rows.agg(F.sum("size").alias("n"), F.count("*").alias("rows")).first()
    grain = max(1, -(-(total.n or 0) // (shards * GRAIN)))
    n_bundles = shards * BUNDLES
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = scratch.write(rows.groupBy("group").agg(*sums), "groups")
    # At most shards * GRAIN groups hold more than a grain each, so both tables of items are bounded.
    large = groups.filter(F.col("size") > grain).withColumn("chunks", F.when(F.col("size") > WHOLE * grain, F.ceil(F.col("size") / grain)).otherwise(F.lit(1)))
    bundle = F.pmod("group", F.lit(n_bundles))
    small = groups.filter(F.col("size") <= grain).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    chunk_of = F.pmod(F.xxhash64("row"), F.col("chunks"))
    cut = rows.join(F.broadcast(large.select("group", "chunks")), "group").groupBy("group", chunk_of.alias("chunk")).agg(*sums)
    items = [(r.group, r.chunk, r.size, r.tokens, r.n) for r in cut.collect()] + [(r.bundle, -1, r.size, r.tokens, r.n) for r in small.collect()]
    items.sort()
    shard = place_items(np.array([x[2:] for x in items] or np.zeros((0, 3)), dtype=np.int64).reshape(-1, 3), shards)
    places = spark.createDataFrame([(int(a), int(b), int(s)) for (a, b, *_), s in zip(items, shard)], "item long, chunk long, shard int")

    known = rows.join(F.broadcast(large.select("group", "chunks")), "group", "left")
    cold = F.col("chunks").isNull()
    keyed = known.withColumn("item", F.when(cold, bundle).otherwise(F.col("group"))).withColumn("chunk", F.when(cold, F.lit(-1)).otherwise(chunk_of))
    placed = keyed.join(F.broadcast(places), ["item", "chunk"]).select("doc_id", "size", "text_crc32", "shard", "row", F.lit(1).alias("one"))
    return number_slots(placed, shards, total.rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number_slots(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """``slot``: gapless from 0 in each shard, counted in cells of some 2,000 rows, never a shard in one task."""
    cells = max(8, -(-n // (shards * 2000)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row")) - 1
    return rows.withColumn("local", local).join(bases, ["shard", "cell"]).withColumn("slot", F.col("local") + F.col("base"))
