"""Whole-text encoding by the ``tokenizers`` library, batch by batch, each distinct word of a batch once.

Both kinds of byte-level BPE split a text before they merge, and never across the start of a run of
white space that follows other characters, nor between a word of letters and the signs after it. So the
texts of a batch are cut there by Arrow, their words dictionary encoded, each distinct word is encoded by
the library once, and the ids of all words are gathered from the dictionary. The result is that of
encoding the whole text, and the tests compare the two. Tokenizers of another make, and texts that hold
one of the tokenizer's added tokens or unusual white space, are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .scratch import give_back

#: Words that an encoder keeps with their ids, and letters of a word that skips the pretokenizer.
KNOWN_WORDS, LETTERS_ALONE = 1_000_000, 64
#: Text bytes that are cut and gathered together.
SLICE_BYTES = 8 << 20

#: Signs that no rule of the pretokenizers joins to the letters before them; the apostrophe begins short forms.
SIGNS = "".join(c for c in string.punctuation if c != "'")
#: Before the first word of a text, and white space with rules of its own, for Arrow's regular expressions.
_FIRST = "\x02"
_UNUSUAL = r"[\x02\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_GAPS = r"[ \n][ \n]|\A[ \n]|[ \n]\z"

# Fixed value: the pattern of the vocabulary files whose words lie between white space and stand alone.
WORDS_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level BPE writes each byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Known:
    """Ids by word, in Arrow arrays; what a slice asked for last is kept when they are full."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.list_(pa.int32()))

    def find(self, words: pa.Array) -> pa.Array:
        return pc.index_in(words, value_set=self.words)

    def add(self, words: list[str], ids: list[list[int]]) -> None:
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.array(list(itertools.chain.from_iterable(ids)), pa.int32())
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(pa.array(ends), flat)])

    def forget(self, but: pa.Array) -> None:
        if len(self.words) > KNOWN_WORDS:
            self.words, self.ids = self.words.take(but), self.ids.take(but)


class Encoder:
    """Encodes texts (null: no ids) without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.added = [t["content"] for t in made["added_tokens"]]
        pre, norm = made["pre_tokenizer"] or {}, made["normalizer"]
        steps, forms = pre.get("pretokenizers", []), (norm or {}).get("normalizers", [])
        leading = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm
        dropping = (
            [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": WORDS_ALONE}
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and [s["type"] for s in forms] == ["NFC", "Replace", "Lowercase"]
            and (forms[1]["pattern"], forms[1]["content"]) == ({"Regex": r"\s+"}, " ")
        )
        self.kind = "leading" if leading else "dropping" if dropping else "whole"
        self.letters = _byte_letters()
        self.known = _Known()
        self.line_end = self.whole("\n") if leading else []

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _ids(self, word: str) -> list[int]:
        """The ids of a word as Arrow cut it; words of letters go straight to the model, written as the
        pretokenizer writes them."""
        head, before = [], ""
        if word[:1] in (_FIRST, "\n"):
            head, word = self.line_end if word[0] == "\n" else [], word[1:]
        elif self.kind == "leading":
            before = " "
        if not word and not before:
            return head
        plain = word.lower() if self.kind == "dropping" else word
        if not plain.isalpha() or max(plain) >= "ɐ" or len(plain) > LETTERS_ALONE:
            return head + self.whole(before + word)
        if plain.isascii():
            written = self.letters[32] + plain if before else plain
        else:
            written = "".join(map(self.letters.__getitem__, (before + plain).encode()))
        return head + [t.id for t in self.library.model.tokenize(written)]

    def _learn(self, words: list[str]) -> list[int]:
        """The places of ``words`` among the known ones, to which they are added; signs after letters are
        words of their own."""
        base, signed, made = len(self.known.words), [], {}
        for w in words:
            stem = w.rstrip(SIGNS)
            if len(stem) < len(w) <= len(stem) + 16 and stem.lstrip(_FIRST + "\n").isalpha():
                signed.append((w, stem))
            else:
                made[w] = self._ids(w)
        if signed:
            places = self.known.find(pa.array([stem for _, stem in signed], pa.large_string())).to_pylist()
            ends, flat = self.known.ids.offsets.to_numpy(), self.known.ids.values.to_numpy()
            signs: dict[str, list[int]] = {}
            for (w, stem), at in zip(signed, places):
                mark = w[len(stem) :]
                if mark not in signs:
                    signs[mark] = self.whole(mark)
                if at is not None:
                    made[w] = flat[ends[at] : ends[at + 1]].tolist() + signs[mark]
                else:
                    if stem not in made:
                        made[stem] = self._ids(stem)
                    made[w] = made[stem] + signs[mark]
        self.known.add(list(made), list(made.values()))
        number = dict(zip(made, range(base, base + len(made))))
        return [number[w] for w in words]

    def _usual(self, texts: pa.Array) -> pa.Array:
        """Which texts can be cut into words."""
        if self.kind == "whole":
            return pa.array([False] * len(texts))
        odd = pc.match_substring_regex(texts, _UNUSUAL + ("|" + _GAPS if self.kind == "leading" else ""))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return pc.invert(odd)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of usual texts, one after another, and the number of each."""
        if self.kind == "leading":
            texts = pc.binary_join_element_wise(*(pa.scalar(s, pa.large_string()) if isinstance(s, str) else s for s in (_FIRST, pc.replace_substring(texts, "\n", " \n"), "")))
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        places = self.known.find(coded.dictionary)
        if places.null_count:
            new = self._learn(coded.dictionary.filter(places.is_null()).to_numpy(zero_copy_only=False).tolist())
            at = places.fill_null(0).to_numpy().copy()
            at[places.is_null().to_numpy(zero_copy_only=False)] = new
            places = pa.array(at)
        found = self.known.ids.take(places.take(coded.indices))
        self.known.forget(but=places)
        at = found.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return found.flatten().to_numpy().view("<u4"), np.diff(at).astype(np.int64)

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, each with ``end_id`` after it, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        counts, parts = np.zeros(len(texts), np.int64), []
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            piece = texts.slice(at, to - at)
            usual = self._usual(piece).to_numpy(zero_copy_only=False)
            ids, numbers = self._cut(piece.filter(pa.array(usual)))
            n = np.zeros(len(piece), np.int64)
            n[usual] = numbers
            others = {k: np.array(self.whole(piece[k].as_py()), "<u4") for k in np.nonzero(~usual)[0].tolist()}
            for k, found in others.items():
                n[k] = len(found)
            ends = np.cumsum(n + 1)
            out, mine = np.empty(ends[-1], "<u4"), np.ones(ends[-1], bool)
            for k, found in others.items():
                out[ends[k] - 1 - len(found) : ends[k] - 1] = found
                mine[ends[k] - 1 - len(found) : ends[k] - 1] = False
            out[ends - 1] = end_id
            mine[ends - 1] = False
            out[mine] = ids
            parts.append(out)
            counts[at:to] = n + 1
            at = to
            give_back()
        return np.concatenate([np.zeros(0, "<u4"), *parts]), counts

    def encode(self, text: str | None) -> bytes:
        """The bytes of the ids of one text."""
        return self.encode_batch(pa.array([text], pa.string()), 0)[0][:-1].tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def forget() -> None:
    """Drop the encoders of this worker: a stage without a tokenizer has other uses for the memory."""
    encoder.cache_clear()
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of some ``most`` bytes of the text ``column``, or of one batch."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
