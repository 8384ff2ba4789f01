"""Substring dedup by repeated-phrase automata.

Phrases of a few words are drawn from each text so that every window of ``width`` words holds at least
one, the same one wherever the window stands (the least of its phrases by a hash). Phrases that occur
twice or more in the corpus are confirmed (``packed``) and sent back to their documents; the documents
are then streamed, batch by batch, through Aho-Corasick automata compiled from the confirmed phrases of
each batch, a shard of bounded size. Every occurrence that an automaton locates makes the windows around
it candidates, and candidates are compared over the corpus: a window goes if its words also start in a
document of a smaller id.

A phrase is held as the codes of its words, CODE_BITS bits of a hash each, and automata run over codes;
what they find beyond the true phrases costs candidates, never a wrong removal, as windows are compared
by a 64-bit hash of their words' 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import by_document, by_shard, mix, repeated_marks, runs, shards_for, unpack
from .scratch import Scratch, row_key, sliced

#: Words of a phrase, and bits of a word's code; a phrase is one 64-bit mark.
PHRASE, CODE_BITS = 5, 12

ROWS = "kind int, shard int, key_id long, key_hash long, doc_id long, n_words long, kept_sha256 string, text binary, windows binary, ids binary, hashes binary, starts binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
KINDS = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in ROWS.split(", ")]


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def phrases(hashes: np.ndarray) -> np.ndarray:
    """The phrase that starts at each word, as a mark."""
    codes = hashes & np.uint64((1 << CODE_BITS) - 1)
    n = max(0, len(codes) - PHRASE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(PHRASE):
        out = (out << np.uint64(CODE_BITS)) | codes[k : k + n]
    return out


def least_of_each(marks: np.ndarray, among: int) -> np.ndarray:
    """For every ``among`` marks in a row the position of the least, by hash and then place."""
    n = len(marks)
    if n < among:
        return np.zeros(0, np.int64)
    low = mix(marks) & ~np.uint64(0xFFFFFFF) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= among:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < among:
        low = np.minimum(low[: n - among + 1], low[among - span : among - span + n - among + 1])
    return (low & np.uint64(0xFFFFFFF)).astype(np.int64)


def chosen(marks: np.ndarray, among: int) -> np.ndarray:
    """The distinct positions among them."""
    return np.unique(least_of_each(marks, among))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each word on."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)


def automaton(marks: np.ndarray) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton of the phrases ``marks``, over strings of one character for each word."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    letters = np.stack([(marks >> np.uint64(CODE_BITS * k)) & np.uint64((1 << CODE_BITS) - 1) for k in reversed(range(PHRASE))], axis=1).astype("<u4") + 1
    text = letters.tobytes().decode("utf-32-le")
    for k in range(0, len(text), PHRASE):
        out.add_word(text[k : k + PHRASE])
    out.make_automaton()
    return out


def starts_in_reach(found: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Starts of the windows that hold a phrase found at one of the given places."""
    mark = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(mark, np.maximum(found - (width - PHRASE), 0), 1)
    np.add.at(mark, found + 1, -1)
    return np.nonzero(np.cumsum(mark)[: max(0, n_words - width + 1)] > 0)[0]


def dedup_passages(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: words left of each whole text.

    A word goes if a window of ``width`` words that covers it also starts in a document of a smaller id.
    Windows are judged on the input. A null text has no words; an empty or short one has no windows. A
    null id counts as larger than all others; rows of one id do not remove each other's words, so repeated
    rows all stay; an empty table gives no rows; other columns are ignored.
    """
    cut, _ = _cut(docs, width, id_col, text_col)
    return cut


def _cut(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, Scratch]:
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    shards = shards_for(docs, text_col)
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    among = width - PHRASE + 1

    def marks_of(text: bytes) -> np.ndarray:
        words = text.split()  # of bytes: at the six white-space bytes
        if len(words) < width:
            return np.zeros(0, np.uint64)
        all_marks = phrases(word_hashes(words))
        return np.unique(all_marks[chosen(all_marks, among)])

    repeated = repeated_marks(keyed.select("key_id", "key_hash", "text"), marks_of, shards, scratch)

    def locate(batches):
        for batch in sliced(batches):
            rows, windows, owner, at, keys = [], [], [], [], []
            told = [None if m is None else np.frombuffer(b"".join(m), "<u8") for m in batch.column("marks").to_pylist()]
            heard = [m for m in told if m is not None]
            machine = automaton(np.unique(np.concatenate(heard))) if heard else None
            for key_id, key_hash, doc_id, text, marks in zip(*(batch.column(c).to_pylist() for c in ("key_id", "key_hash", "doc_id", "text")), told):
                words = (text or b"").split()
                starts = np.zeros(0, np.int64)
                if marks is not None:
                    hashes = word_hashes(words)
                    coded = ((hashes & np.uint64((1 << CODE_BITS) - 1)).astype("<u4") + 1).tobytes().decode("utf-32-le")
                    found = np.array([end - PHRASE + 1 for end, _ in machine.iter(coded)], dtype=np.int64)
                    starts = starts_in_reach(found, len(words), width)
                if not len(starts):
                    rows.append((0, None, None, None, doc_id, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None, None, None, None, None))
                    continue
                rows.append((1, None, key_id, key_hash, doc_id, None, None, text, None, None, None, None))
                windows.append(window_hashes(hashes, width)[starts])
                owner.append(np.full(len(starts), len(keys)))
                at.append(starts)
                keys.append((key_id, key_hash))
            if keys:
                w, o, s = np.concatenate(windows), np.concatenate(owner), np.concatenate(at)
                ids, hashes = (np.array(x, dtype=np.int64) for x in zip(*keys))
                order = np.lexsort((ids[o], w))
                first, length = runs(w[order])
                least = np.repeat(ids[o[order]][first], length)
                gone = np.empty(len(w), dtype=bool)
                gone[order] = ids[o[order]] > least
                for i, h, m in by_document(s[gone].astype("<i4"), ids[o[gone]], hashes[o[gone]]):
                    rows.append((3, None, i, h, None, None, None, None, None, None, None, m))
                w, o, s = w[~gone], o[~gone], s[~gone]
                for shard, pick in by_shard(w, shards):
                    rows.append((2, shard, None, None, None, None, None, None, w[pick].tobytes(), ids[o[pick]].tobytes(), hashes[o[pick]].tobytes(), s[pick].astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)

    def settle(table: pa.Table) -> pa.Table:
        w, ids = unpack(table["windows"], "<u8"), unpack(table["ids"], "<i8")
        hashes, starts = unpack(table["hashes"], "<i8"), unpack(table["starts"], "<i4")
        order = np.lexsort((ids, w))
        first, length = runs(w[order])
        gone = order[ids[order] > np.repeat(ids[order][first], length)]
        rows = list(by_document(starts[gone], ids[gone], hashes[gone]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["key_id", "key_hash", "starts"])

    def cut(batches):
        for batch in sliced(batches):
            out = [[], [], [], []]
            for doc_id, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts"))):
                words = text.split()
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                if gone:
                    starts = np.frombuffer(b"".join(gone), "<i4")
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + width, -1)
                keep = np.cumsum(mark)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k]
                for column, value in zip(out, (doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    key = ["key_id", "key_hash"]
    stream = scratch.write(keyed.join(repeated, key, "left").mapInArrow(locate, ROWS), "stream")
    scratch.drop("repeated")
    removed = stream.filter("kind = 3").select(*key, "starts").union(stream.filter("kind = 2").select("shard", "windows", "ids", "hashes", "starts").groupBy("shard").applyInArrow(settle, "key_id long, key_hash long, starts binary"))
    removed = scratch.write(removed.groupBy(*key).agg(F.collect_list("starts").alias("starts")), "removed")
    pending = stream.filter("kind = 1").select(*key, "doc_id", "text").join(removed, key, "left")
    done = stream.filter("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return done.union(pending.select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")), scratch
