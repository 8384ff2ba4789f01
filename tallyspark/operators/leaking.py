"""Passages printed inside texts, found without a join of every text with every passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import let

#: Words of an anchor, where a passage has as many inside.
WIDE = 5
#: Bytes of passages that are broadcast together.
BLOCK_BYTES = 16 << 20


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _grams(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return F.when(F.size(words) >= width, let(hashes, runs))


def _anchor(inside: Column) -> Column:
    """Width and hash of a passage's anchor: the words around its longest inner word; width 0 if it has none."""

    def place(width: int) -> Column:
        long = F.array_max(F.transform(inside, lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"))))["i"]
        start = F.greatest(F.lit(0), F.least(long - width // 2, F.size(inside) - width))
        return F.struct(F.lit(width).alias("width"), F.element_at(_grams(F.slice(inside, start + 1, width), width), 1).alias("gram"))

    none = F.struct(F.lit(0).alias("width"), F.lit(None).cast("long").alias("gram"))
    return F.when(F.size(inside) >= WIDE, place(WIDE)).when(F.size(inside) >= 1, place(1)).otherwise(none)


def passages_in(texts: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str) -> DataFrame:
    """``key`` and ``item`` of the least passage that each text holds letter by letter.

    Words inside a passage, between its first and its last, are whole words of any text that holds it. So texts
    and passages meet by an equal run of them, and only such pairs are compared by letters. Passages of two words
    or fewer have none; they pass all texts in blocks of bounded bytes. Null texts and passages take no part; the
    empty passage is in every text. Equal passages count as the least of their items.
    """
    docs = texts.filter(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("print")).alias("doc"), F.col(text).alias("text"))
    wanted = passages.filter(F.col(passage).isNotNull()).groupBy(F.col(passage).alias("passage")).agg(F.min(item).alias("item")).withColumn("pid", F.xxhash64("passage"))
    inside = F.when(F.size(_words(F.col("passage"))) > 2, F.slice(_words(F.col("passage")), 2, F.greatest(F.size(_words(F.col("passage"))) - 2, F.lit(0)))).otherwise(F.expr("CAST(array() AS array<string>)"))
    wanted = wanted.withColumn("inside", inside).select("passage", "item", "pid", _anchor(F.col("inside")).alias("anchor")).select("passage", "item", "pid", "anchor.*")
    sizes = {r.width: r.bytes for r in wanted.groupBy("width").agg(F.sum(F.octet_length("passage")).alias("bytes")).collect()}
    found = []
    for width in sorted(sizes):
        some = wanted.filter(F.col("width") == width)
        if width:
            grams = docs.select("doc", F.explode(F.array_distinct(_grams(_words(F.col("text")), width))).alias("gram"))
            pairs = grams.join(some.select("gram", "pid"), "gram").select("doc", "pid").distinct()
            found.append(pairs.join(some.select("pid", "item", "passage"), "pid").join(docs.distinct(), "doc").filter(F.contains("text", "passage")).select("doc", "item"))
        else:
            blocks = 1 + sizes[width] // BLOCK_BYTES
            for b in range(blocks):
                block = some.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b).select("item", "passage")
                found.append(docs.join(F.broadcast(block), F.contains("text", "passage")).select("doc", "item"))
    if not found:
        found = [docs.select("doc", F.lit(None).cast(wanted.schema["item"].dataType).alias("item")).limit(0)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(F.col("doc.id").alias(key)).agg(F.min("item").alias(item))
