"""Suffix-array dedup of byte strings that occur twice.

Every string of ``length`` bytes has an anchor, the least of its short grams by a hash, so that equal
strings have the same anchor at the same place. Anchors that occur once are done with (``packed``). The
others are known by their context, the bytes of all strings that have them (compared by the 64 bits of the
anchor and 64 of a hash of the context). Where all contexts of an anchor are alike, all their strings are
repeated. The differing contexts of an anchor go to one shard, are clipped to the bytes that each shares
with another of its anchor, a suffix array is induced over what is left of the shard's contexts, and runs
of suffixes whose permuted common prefixes reach ``length`` are the repeated strings; a run counts if it
holds two places of the corpus. The contexts of an anchor that has more than ``HOT`` would be one shard of
unbounded size, as when a third of all documents share a passage; they are settled over all tasks by
128-bit hashes of their strings, of stretches of strings first, instead of induced sorting.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import mix, repeated_marks, shards_for
from .phrases import least_of_each
from .scratch import Scratch, fresh, quoted, row_key, sliced
from .suffixes import permuted_common_prefixes, suffix_array

#: Bytes of a gram.
GRAM = 32
#: Different contexts of one anchor beyond which no shard is given it, and contexts for each shard.
HOT, SHARD_CONTEXTS = 1000, 2000
#: Strings that start one after another and are first looked at as one stretch.
STRETCH = 16
#: Bytes looked at together; texts are gone through in such blocks, so memory does not follow their length.
BLOCK = 4 << 20


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit value of the ``GRAM`` bytes from each byte on, by doubling."""
    out, factor, width = text.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while width < GRAM:
        out = out[: max(0, len(out) - width)] * factor + out[width:]
        factor, width = np.uint64(int(factor) ** 2 % 2**64), width * 2
    return mix(out)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of ``text``: places, values, and the first and last start of the strings that have them."""
    n = len(text) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    raw, places, values = np.frombuffer(text, np.uint8), [], []
    for a in range(0, n, BLOCK):
        value = grams(raw[a : a + BLOCK + length - 1])
        at = least_of_each(value, length - GRAM + 1)
        places.append(at + a)
        values.append(value[at])
    place, value = np.concatenate(places), np.concatenate(values)
    first = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]
    return place[first], value[first], first, np.append(first[1:], n) - 1


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))


def repeated_in_shard(contexts: list[bytes], places: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its strings of ``length`` bytes stand at two places or more in the shard.

    ``places`` numbers the place of each context's first byte in the corpus.
    """
    parts = []
    for c in contexts:
        parts += [np.frombuffer(c, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
    t = np.concatenate([*parts, np.zeros(1, np.int64)])
    sa = suffix_array(t)
    shared = permuted_common_prefixes(t, sa, length)[sa] >= length
    first = np.nonzero(~shared)[0]
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    place = np.zeros(len(t), dtype=np.uint64)
    for s, n, p in zip(starts.tolist(), sizes.tolist(), places):
        place[s : s + n] = np.uint64(p) + np.arange(n, dtype=np.uint64)
    inside = place[sa]
    many = np.minimum.reduceat(inside, first) != np.maximum.reduceat(inside, first)
    found = np.zeros(len(t), dtype=bool)
    found[sa] = np.repeat(many, np.diff(np.append(first, len(sa))))
    return [found[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), sizes.tolist())]


def _shared(keys: list[bytes], head: int, most: int) -> np.ndarray:
    """For each key the bytes after its ``head`` that it shares with another key of the same head, up to ``most``."""
    width = head + most
    keys = [k[:width] for k in keys]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    rows = np.frombuffer(b"".join([keys[k].ljust(width, b"\0") for k in order.tolist()]), np.uint8).reshape(-1, width)
    sizes = np.array([len(keys[k]) for k in order.tolist()], dtype=np.int64)
    apart = rows[1:] != rows[:-1]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    common = np.maximum(np.minimum(common, np.minimum(sizes[1:], sizes[:-1])) - head, 0)
    out = np.zeros(len(keys), dtype=np.int64)
    out[order] = np.maximum(np.append(0, common), np.append(common, 0))
    return out


def clips(anchors_: list[int], contexts: list[bytes], lefts: list[int], length: int) -> list[tuple[int, int]]:
    """For each context the part, from and to, outside of which it shares nothing with another of its anchor.

    A string that stands in two contexts of an anchor stands at the same place of both, so it ends within
    the bytes that some other context shares on the right of the anchor, and starts within those that some
    other shares on its left. Where the two together are shorter than a string, the part is empty.
    """
    if not contexts:
        return []
    heads = [a.to_bytes(8, "big", signed=True) for a in anchors_]
    right = _shared([h + c[n:] for h, c, n in zip(heads, contexts, lefts)], 8, length)
    left = _shared([h + c[:n][::-1] for h, c, n in zip(heads, contexts, lefts)], 8, length)
    return [(n - a, n + b) if a + b >= length else (0, 0) for n, a, b in zip(lefts, left.tolist(), right.tolist())]


def _place(key_id: int, key_hash: int, at: int) -> int:
    """A number for byte ``at`` of a row, consecutive within the row."""
    head = mix(mix(np.array([key_id], dtype=np.int64).view(np.uint64)) ^ np.array([key_hash], dtype=np.int64).view(np.uint64))
    return (int(head[0]) + at) % 2**63


ROWS = "doc_id long, key_id long, key_hash long, n_bytes long, kept_sha256 string, text binary, found array<struct<anchor:long,context:long,at:long,left:int,right:int>>"
FOUND = pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("right", pa.int32())]))


def _find(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """The texts without any repeated anchor, done; and the spans to remove from the others."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    shards = shards_for(docs, text_col)
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    key = ["key_id", "key_hash"]
    repeated = repeated_marks(keyed.select(*key, "text"), lambda text: anchors(text, length)[1], shards, scratch)

    def locate(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, key_id, key_hash, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key_id", "key_hash", "text", "marks"))):
                text = text or b""
                if marks is None:
                    rows.append((doc_id, key_id, key_hash, len(text), hashlib.sha256(text).hexdigest(), None, None))
                    continue
                at, value, first, last = anchors(text, length)
                known = np.isin(value, np.frombuffer(b"".join(marks), "<u8"))
                found = []
                for p, v, a, b in zip(at[known].tolist(), value[known].view(np.int64).tolist(), first[known].tolist(), last[known].tolist()):
                    left, right = p - a, b + length - p
                    context = xxhash.xxh64_intdigest(text[p - left : p + right], left)
                    found.append({"anchor": v, "context": context - (context >> 63 << 64), "at": p, "left": left, "right": right})
                rows.append((doc_id, key_id, key_hash, len(text), None, text, found))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), FOUND
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["doc_id", "key_id", "key_hash", "n_bytes", "kept_sha256", "text", "found"])

    stream = scratch.write(keyed.join(repeated, key, "left").mapInArrow(locate, ROWS), "stream")
    scratch.drop("repeated")
    pending = stream.filter(F.col("text").isNotNull())
    places = pending.select(*key, F.explode("found").alias("o")).select(*key, "o.*")
    # One row for each anchor and context, with its number of places and one of them.
    one = F.min(F.struct("key_id", "key_hash", "at", "left", "right")).alias("one")
    contexts = scratch.write(places.groupBy("anchor", "context").agg(F.count("*").alias("n"), one), "contexts")
    numbers = contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts"))
    known = scratch.write(contexts.join(numbers, "anchor").select("anchor", "context", "n", "n_contexts", "one.*"), "known")
    # Contexts at two places are repeated whole. The bounds are string starts, relative to the anchor.
    whole = known.filter("n > 1").select("anchor", "context", F.array(F.struct((-F.col("left")).alias("from"), (F.col("right") - length).alias("to"))).alias("spans"))
    unlike = known.filter("n_contexts > 1")
    ranges = whole
    n_unlike = unlike.count()
    if n_unlike:
        ranges = whole.union(_unlike_contexts(pending, unlike, n_unlike, length, scratch))
    ranges = scratch.write(ranges, "ranges")
    spans = places.join(ranges, ["anchor", "context"]).select(*key, F.expr(f"transform(spans, s -> struct(at + s.from AS a, at + s.to + {length} AS b))").alias("s"))
    spans = scratch.write(spans.groupBy(*key).agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")
    return stream, spans, scratch


def _unlike_contexts(pending: DataFrame, unlike: DataFrame, n: int, length: int, scratch: Scratch) -> DataFrame:
    """``anchor, context, spans`` of contexts that differ from another of their anchor."""
    key = ["key_id", "key_hash"]
    shards = max(24, -(-n // SHARD_CONTEXTS))
    wanted = unlike.groupBy(*key).agg(F.collect_list(F.struct("anchor", "context", "n", "n_contexts", "at", "left", "right")).alias("wanted"))

    def extract(batches):
        for batch in sliced(batches):
            rows = []
            for key_id, key_hash, text, want in zip(*(batch.column(c).to_pylist() for c in ("key_id", "key_hash", "text", "wanted"))):
                for w in want:
                    value = np.array([w["anchor"]], dtype=np.int64).view(np.uint64)
                    shard = -1 if w["n_contexts"] > HOT else int(mix(value)[0] % np.uint64(shards))
                    rows.append((shard, w["anchor"], w["context"], w["n"] > 1, _place(key_id, key_hash, w["at"] - w["left"]), w["left"], text[w["at"] - w["left"] : w["at"] + w["right"]]))
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["shard", "anchor", "context", "many", "place", "left", "bytes"])

    def induce(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["anchor"], r["context"]))
        parts = clips([r["anchor"] for r in rows], [r["bytes"] for r in rows], [r["left"] for r in rows], length)
        kept = [(r, a, b) for r, (a, b) in zip(rows, parts) if b > a]
        flags = repeated_in_shard([r["bytes"][a:b] for r, a, b in kept], [r["place"] + a for r, a, b in kept], length) if kept else []
        out = []
        for (r, at, _), repeated in zip(kept, flags):
            if not r["many"] and repeated.any():
                out.append((r["anchor"], r["context"], [{"from": at + a - r["left"], "to": at + b - r["left"]} for a, b in runs_of(repeated)]))
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), span))], ["anchor", "context", "spans"])

    found = scratch.write(pending.select(*key, "text").join(wanted, key).mapInArrow(extract, "shard int, anchor long, context long, many boolean, place long, left int, bytes binary"), "unlike")
    sorted_out = found.filter("shard >= 0").groupBy("shard").applyInArrow(induce, "anchor long, context long, spans array<struct<from:int,to:int>>")
    hot = found.filter("shard < 0")
    return sorted_out if not hot.take(1) else sorted_out.union(_hot_contexts(hot, length, scratch))


def _hot_contexts(hot: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``anchor, context, spans`` of the contexts of anchors that no shard takes.

    A context is looked at in stretches, ``STRETCH`` strings that start one after another at a fixed
    distance from the anchor. All strings of a stretch have its core in common: where no other context has
    that core, none of them is repeated. Where another has the whole stretch, all are. What is left, the
    edges of shared passages, is compared string by string.
    """

    def stretch(batches):
        for batch in sliced(batches):
            rows = []
            for anchor, context, many, place, left, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "many", "place", "left", "bytes"))):
                last = len(text) - length - left  # the start of the last string, relative to the anchor
                for number in range(-left // STRETCH, last // STRETCH + 1):
                    a, b = number * STRETCH, number * STRETCH + STRETCH - 1
                    core = xxhash.xxh3_128_digest(text[b + left : a + length + left], number % 2**32)
                    a, b = max(a, -left), min(b, last)
                    part = text[a + left : b + length + left]
                    rows.append((core + anchor.to_bytes(8, "little", signed=True), xxhash.xxh3_128_digest(part, (b - a) % 2**32) + (a % 256).to_bytes(1, "little"), anchor, context, many, place + a + left, a, b, part))
            kinds = pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], ["core", "whole", "anchor", "context", "many", "place", "a", "b", "part"])

    def strings(batches):
        for batch in sliced(batches):
            rows = []
            for core, anchor, context, sure, place, a, part in zip(*(batch.column(c).to_pylist() for c in ("core", "anchor", "context", "sure", "place", "a", "part"))):
                rows += [(xxhash.xxh3_128_digest(part[o : o + length]), anchor, context, sure, place + o, a + o) for o in range(len(part) - length + 1)]
            kinds = pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["hash", "anchor", "context", "sure", "place", "at"])

    pieces = scratch.write(hot.mapInArrow(stretch, "core binary, whole binary, anchor long, context long, many boolean, place long, a int, b int, part binary"), "pieces")
    wholes = scratch.write(pieces.groupBy("core", "whole").agg(((F.count("*") > 1) | F.max("many")).alias("sure"), F.min("place").alias("first_place")), "wholes")
    shared = scratch.write(wholes.groupBy("core").agg(F.count("*").alias("n_wholes")).filter("n_wholes > 1"), "shared")
    marked = pieces.join(wholes, ["core", "whole"])
    sure = marked.filter("sure AND NOT many").select("anchor", "context", F.struct(F.col("a").alias("from"), F.col("b").alias("to")).alias("span"))
    edges = marked.filter((F.col("place") == F.col("first_place")) & ~F.col("many") | F.col("sure") & (F.col("place") == F.col("first_place"))).join(shared, "core")
    each = scratch.write(edges.select("core", "anchor", "context", "sure", "place", "a", "part").mapInArrow(strings, "hash binary, anchor long, context long, sure boolean, place long, at int"), "strings")
    again = scratch.write(each.groupBy("hash").agg((F.max("sure") | (F.min("place") != F.max("place"))).alias("found")).filter("found").select("hash"), "again")
    late = each.filter("NOT sure").join(again, "hash").select("anchor", "context", F.struct(F.col("at").alias("from"), F.col("at").alias("to")).alias("span"))
    return sure.union(late).groupBy("anchor", "context").agg(F.collect_list("span").alias("spans"))


def _kept(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of ``text``, the bytes removed, and the maximal runs removed."""
    if not spans:
        return text, 0, 0
    gone = sorted((s["a"], s["b"]) for s in spans)
    merged = [list(gone[0])]
    for a, b in gone[1:]:
        if a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    parts, at = [], 0
    for a, b in merged:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), sum(b - a for a, b in merged), len(merged)


def dedup_substrings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each whole text, as UTF-8 bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same document
    or another; strings are judged on the input, and every copy goes. Null and empty texts, and those under
    ``length`` bytes, stay as they are. Repeated rows are copies of each other. Null ids are ids like any
    other; an empty table gives no rows; other columns are ignored.
    """
    stream, spans, _ = _find(docs, length, id_col, text_col)

    def digest(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                kept, removed, n = _kept(text, gone)
                rows.append((doc_id, len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    zero = F.lit(0).cast("long")
    done = stream.filter(F.col("text").isNull()).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256")
    pending = stream.filter(F.col("text").isNotNull()).join(spans, ["key_id", "key_hash"], "left").select("doc_id", "text", "spans")
    return done.union(pending.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def drop_repeated_substrings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the text of each row less its repeated strings; bytes cut out of a character go with it.

    All other columns are unchanged, but ``n_chars_col``, where there is such a column, counts anew. Null
    texts stay null. See ``dedup_substrings`` for what is removed.
    """
    _, spans, _ = _find(docs, length, id_col, text_col)
    ident, digest = row_key(id_col, text_col)
    key_id, key_hash, a, b, gone_col = fresh(docs, "key_id", "key_hash", "a", "b", "spans")
    keyed = docs.withColumns({key_id: ident, key_hash: digest})
    spans = spans.select(F.col("key_id").alias(a), F.col("key_hash").alias(b), F.col("spans").alias(gone_col))
    joined = keyed.join(spans, (F.col(key_id) == F.col(a)) & (F.col(key_hash) == F.col(b)), "left").select(*map(quoted, docs.columns), gone_col)
    text_at, names = docs.columns.index(text_col), docs.columns

    def cut(batches):
        for batch in sliced(batches):
            texts, gone = batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()
            kept = [t if not g else _kept(t.encode(), g)[0].decode(errors="ignore") for t, g in zip(texts, gone)]
            arrays = [batch.column(k) for k in range(len(names))]
            arrays[text_at] = pa.array(kept, arrays[text_at].type)
            yield pa.RecordBatch.from_arrays(arrays, plain)

    # Python workers see columns by place, so names may hold any sign.
    plain = [f"c{k}" for k in range(len(names))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema)])
    out = joined.toDF(*plain, "spans").mapInArrow(cut, schema).toDF(*names)
    if n_chars_col in names:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out
