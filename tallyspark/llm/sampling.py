"""SentencePiece sampling without replacement: Gumbel top-k by perturbed A-star search over the lattice.

The lattice of a text has a node before each character and an edge for each piece of the vocabulary that
spells the characters from there, or the bytes of a character that no piece spells. White space starts a
word, a run of it one word, and no piece spans two, so lattices are built once for each distinct word of a batch and chained. An
edge weighs by the rank of its piece, as under Zipf's law, to the power ``alpha``; sums over all paths to
the end of the word make the weights of a node's edges a distribution.

Each segmentation's log-probability is perturbed by a Gumbel variable, and the ``k`` largest perturbed
values are a sample of ``k`` distinct segmentations without replacement. The search holds, for each node
that a path has passed, the largest perturbed value among the paths that leave it by another edge: drawn
as a Gumbel variable truncated at the value of the path, from the mass of those edges, so that no path is
spelled out before it is wanted. The node of the largest value is taken next, the path branches there and
goes on to the end. Many texts take each step together. The value after the k-th is the
threshold by which a segmentation's inclusion is scored.

Draws are hashes of the row's key, the sample, the word and the step: a row has the same samples wherever
and whenever it is read.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import mix
from .scratch import sliced
from .tokens import forget

#: Scores at or below this mark pieces that the model never merges to; one character needs no merge.
NEVER = -1e8
GAP = "▁"
#: Texts that share the lattices of their words.
BATCH = 1800
#: Words whose lattices are built together, few enough for their arrays to stay in a processor's cache.
WORDS = 8192
#: Texts that take their steps together, for the same reason.
TOGETHER = 150


class Vocabulary:
    """The pieces of a model as a trie in arrays: sorted keys (node, character) and the nodes they lead to."""

    def __init__(self, path: str, alpha: float):
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        blank = {i for i in plain if not sp.id_to_piece(i).strip(GAP)}  # the encoder finds these whole, without merges
        plain = [i for i in plain if sp.get_score(i) > NEVER or len(sp.id_to_piece(i)) == 1 or i in blank]
        plain = [i for i in plain if GAP not in sp.id_to_piece(i)[1:] or i in blank]
        ranks = np.array([min(-sp.get_score(i), size) for i in plain])
        norm = math.log(sum(1 / (r + 2.7) for r in range(size)))
        self.worst = alpha * (-math.log(size + 2.7) - norm)
        nodes: dict[tuple[int, int], int] = {}
        piece, weight = [-1], [0.0]
        for i, w in zip(plain, alpha * (-np.log(ranks + 2.7) - norm)):
            at = 0
            for c in sp.id_to_piece(i):
                key = at, ord(c)
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                at = nodes[key]
            piece[at], weight[at] = i, float(w)
        keys = np.array([a << 21 | c for a, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.piece, self.weight = np.array(piece, dtype=np.int64), np.array(weight)
        self.roots = np.full(0x110000, -1, dtype=np.int64)  # the step from node 0
        first = self.keys < 1 << 21
        self.roots[self.keys[first]] = self.to[first]
        self.spelled = pa.array([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(GAP, " ").encode() for i in range(size) for p in [sp.id_to_piece(i)]], pa.large_binary())
        self.pairs = {p[k : k + 2] for i in plain for p in [sp.id_to_piece(i)] for k in range(len(p) - 1)}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after each ``char``, or -1."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


    def decode(self, ids: np.ndarray) -> str:
        """The text that ``ids`` spell, without the blank that the model sets before it."""
        _, offsets, data = self.spelled.take(pa.array(ids)).buffers()
        end = int(np.frombuffer(offsets, np.int64, len(ids) + 1)[-1])
        return str(memoryview(data)[:end] if end else b"", "utf-8", "replace").removeprefix(" ")

    def round_trip(self, ids: np.ndarray, text: str) -> bool:
        """Whether ``ids`` decode to ``text``; where the plain spelling differs, the library decides."""
        return self.decode(ids) == text or self.model.decode(ids.tolist()) == text


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """The lattices of distinct words: nodes before each character, and the edges of each node in order.

    ``share`` is an edge's probability at its node, ``rest`` the log of that of the node's other edges;
    ``after`` is the node that an edge leads to, or -1 at the end of the word.
    """

    def __init__(self, vocab: Vocabulary, words: list[str]):
        some = [_Some(vocab, words[k : k + WORDS]) for k in range(0, max(len(words), 1), WORDS)]
        nodes, edges = (np.cumsum([0, *(len(x) for x in own)]) for own in ([x.count for x in some], [x.piece for x in some]))
        for x, node, edge in zip(some, nodes.tolist(), edges.tolist()):
            x.start += node
            x.first += edge
            x.source += node
            x.after[x.after >= 0] += node
        for name in ("start", "count", "first", "source", "piece", "after", "logp", "share", "rest"):
            setattr(self, name, np.concatenate([x.__dict__.pop(name) for x in some]))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its share; a node's edges are few, and gone through in order."""
        edge, last = self.first[node], self.first[node] + self.count[node] - 1
        u = u - self.share[edge]
        (more,) = np.nonzero((u >= 0) & (edge < last))
        while len(more):
            edge[more] += 1
            u[more] -= self.share[edge[more]]
            more = more[(u[more] >= 0) & (edge[more] < last[more])]
        return edge


class _Some:
    """The lattices of some words, nodes and edges numbered from 0."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        left = np.repeat(self.start + lengths, lengths) - np.arange(len(chars))
        n = len(chars)
        where, at, ids, weights, spans = np.arange(n), np.zeros(n, dtype=np.int64), [], [], []
        from_, k = [], 0
        while len(where):
            at = vocab.step(at, chars[where + k]) if k else vocab.roots[chars]
            good = at >= 0
            where, at = where[good], at[good]
            ends = vocab.piece[at] >= 0
            from_.append(where[ends])
            ids.append(vocab.piece[at[ends]])
            weights.append(vocab.weight[at[ends]])
            k += 1
            spans.append(np.full(len(from_[-1]), k))
            more = left[where] > k
            where, at = where[more], at[more]
        spelled = np.zeros(n, dtype=bool)
        if spans:
            spelled[from_[0]] = True
        (raw,) = np.nonzero(~spelled)  # characters without a piece of their own are spelled in bytes
        n_bytes = 1 + (chars[raw] > 0x7F) + (chars[raw] > 0x7FF) + (chars[raw] > 0xFFFF)
        from_.insert(0, raw)
        ids.insert(0, -1 - chars[raw])
        weights.insert(0, n_bytes * vocab.worst)
        spans.insert(0, np.ones(len(raw), dtype=np.int64))
        source, piece, weight, span = (np.concatenate(x) for x in (from_, ids, weights, spans))
        del from_, ids, weights, spans, where, at
        order = np.argsort(source, kind="stable")  # runs by span, each in order, so edges come by node and then span
        self.source, self.piece, weight, span = source[order], piece[order], weight[order], span[order]
        self.count = np.bincount(source, minlength=n)
        del source, piece, order
        self.first = np.cumsum(self.count) - self.count
        self.after = np.where(span == left[self.source], -1, self.source + span)
        # Sums over all ways to the end of the word, nearest nodes first.
        beyond = np.zeros(n + 1)  # the last stands for the end of the word
        to = np.where(self.after < 0, n, self.after)
        near_end, levels = left[self.source], np.arange(1, (left.max() if n else 0) + 2)
        by_left = np.argsort(near_end, kind="stable")
        bounds = np.searchsorted(near_end[by_left], levels)
        total = np.empty(len(weight))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            edges = by_left[a:b]
            nodes = self.source[edges]
            begin = np.nonzero(np.append(True, nodes[1:] != nodes[:-1]))[0]
            nodes = nodes[begin]
            value = weight[edges] + beyond[to[edges]]
            total[edges] = value
            top = np.maximum.reduceat(value, begin)
            beyond[nodes] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, self.count[nodes])), begin))
        self.logp = np.minimum(total - beyond[self.source], 0.0)
        # Log of the share of a node's other edges, summed without its likeliest where that is nearly all.
        self.share = np.exp(self.logp)
        with np.errstate(divide="ignore"):
            self.rest = np.log(-np.expm1(np.minimum(self.logp, -1e-300)))
            if n:
                likely = np.maximum.reduceat(self.logp, self.first)[self.source]
                others = np.where(self.logp < likely, self.share, 0.0)
                near = self.logp > -0.5
                self.rest[near] = np.log(np.add.reduceat(others, self.first)[self.source])[near]
        self.rest[self.count[self.source] == 1] = -np.inf
        self.source, self.piece, self.after = (x.astype(np.int32) for x in (self.source, self.piece, self.after))


def uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit seeds."""
    return ((mix(seed) >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52


class _Parts:
    """The numbers of the parts of words: a mark at a word's end that no piece joins to what is before is a part."""

    def __init__(self, vocab: Vocabulary):
        self.pairs, self.known = vocab.pairs, {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        cut = len(word) - (word[-2:] not in self.pairs if len(word) > 1 else 0)
        known = self.known
        if cut == len(word):
            return (known.setdefault(word, len(known)),)
        return known.setdefault(word[:cut], len(known)), known.setdefault(word[cut:], len(known))

    def of(self, normals: list[str]) -> list[np.ndarray]:
        """For each text in normal form the numbers of its parts; distinct words are looked at once."""
        plain = [n[:1] == GAP and GAP + GAP not in n and n[-1:] != GAP for n in normals]
        words = pc.split_pattern(pa.array([n[1:] for n, p in zip(normals, plain) if p], pa.large_string()), GAP)
        coded = words.flatten().dictionary_encode()
        found = [self._of_word(GAP + w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        first, second = np.array([f[0] for f in found], dtype=np.int64), np.array([f[1] if len(f) > 1 else -1 for f in found], dtype=np.int64)
        index = coded.indices.to_numpy()
        both = np.stack([first[index], second[index]], axis=1).ravel()
        ends = words.offsets.to_numpy() * 2
        texts = iter([both[a:b][both[a:b] >= 0] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
        return [next(texts) if p else np.array([x for w in _words(n) for x in self._of_word(w)], dtype=np.int64) for n, p in zip(normals, plain)]


class Paths:
    """One path for each of some texts: its edges in order of text, and for each the value of leaving there."""

    def __init__(self, text, word, edge, before, value, begin):
        self.text, self.word, self.edge, self.before, self.value, self.begin = text, word, edge, before, value, begin
        self.excluded: dict[int, list[int]] = {}

    def best(self, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the largest value of leaving its path, and where."""
        value, at = np.full(n_texts, -np.inf), np.zeros(n_texts, dtype=np.int64)
        if len(self.text):
            first = np.nonzero(np.append(True, self.text[1:] != self.text[:-1]))[0]
            texts, counts = self.text[first], np.diff(np.append(first, len(self.text)))
            value[texts] = np.maximum.reduceat(self.value, first)
            (hits,) = np.nonzero(self.value == np.repeat(value[texts], counts))
            at[texts] = hits[np.searchsorted(hits, first)]
        return value, at


def _truncated(mass: np.ndarray, at_most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable of location ``mass`` (a log), given that it is at most ``at_most``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = mass - np.log(np.exp(np.minimum(mass - at_most, 700.0)) - np.log(u))
    return np.where(np.isneginf(mass), -np.inf, np.minimum(out, at_most))


def _go_on(lattice: Lattice, text, word, node, seed, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draw edges from each node on to the end of its word; ``(text, word, edge)`` in order, as texts and words are."""
    taken, lengths = [], np.zeros(len(node), dtype=np.int64)
    step = 0
    alive = np.arange(len(node))
    while len(alive):
        u = uniform(seed[alive] ^ mix(np.full(1, sample << 32 | step, dtype=np.uint64)))
        edge = lattice.draw(node[alive], u)
        taken.append((alive, edge))
        lengths[alive] += 1
        node = node.copy() if step == 0 else node
        node[alive] = lattice.after[edge]
        alive = alive[node[alive] >= 0]
        step += 1
    first = np.cumsum(lengths) - lengths
    edges = np.empty(int(lengths.sum()), dtype=np.int64)
    for step, (alive, edge) in enumerate(taken):
        edges[first[alive] + step] = edge
    return np.repeat(text, lengths), np.repeat(word, lengths), edges


def _mass_left(lattice: Lattice, edges: list[int]) -> float:
    """Log of the share of a node's edges other than ``edges``."""
    node = lattice.source[edges[0]]
    others = [e for e in range(lattice.first[node], lattice.first[node] + lattice.count[node]) if e not in edges]
    if not others:
        return -math.inf
    top = max(lattice.logp[e] for e in others)
    return top + math.log(sum(math.exp(lattice.logp[e] - top) for e in others))


def sample_batch(vocab: Vocabulary, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[list[int], float, float, float]]]:
    """For each text up to ``k`` distinct ``(ids, log-probability, perturbed value, log of inclusion)``."""
    parts = _Parts(vocab)
    slots = parts.of([vocab.model.normalize(text) if text else "" for text in texts])
    lattice = Lattice(vocab, list(parts.known))
    out = []
    for a in range(0, len(texts), TOGETHER):
        out += _sample_some(vocab, lattice, slots[a : a + TOGETHER], seeds[a : a + TOGETHER], k)
    return out


def _sample_some(vocab: Vocabulary, lattice: Lattice, slots: list[np.ndarray], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``sample_batch`` for texts of the words ``slots`` of ``lattice``."""
    n = len(slots)
    slot, text_of = np.concatenate([np.zeros(0, np.int64), *slots]), np.repeat(np.arange(n), [len(x) for x in slots])
    first_word = np.searchsorted(text_of, np.arange(n + 1))
    ordinal = np.arange(len(slot)) - first_word[text_of]
    word_seed = mix(seeds[text_of] + (ordinal.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    gumbel = -np.log(-np.log(uniform(seeds)))
    found: list[list[tuple]] = [[] for _ in range(n)]
    paths: list[Paths] = []
    bound = gumbel.copy()
    text, word, edge = _go_on(lattice, text_of, np.arange(len(slot)), lattice.start[slot] if len(slot) else slot, word_seed, 0)
    fresh, alive = np.zeros(len(edge), dtype=bool), np.ones(n, dtype=bool)
    for sample in range(k):
        # The path of each text that is still alive: where it is new, what may leave it is worth a draw.
        logp = lattice.logp[edge]
        begin, end = np.searchsorted(text, np.arange(n)), np.searchsorted(text, np.arange(n), side="right")
        before, total = np.zeros(len(edge)), np.zeros(n)
        for i in np.nonzero(alive)[0].tolist():  # text by text, so that no sum depends on the batch
            sums = np.cumsum(logp[begin[i] : end[i]])
            before[begin[i] + 1 : end[i]] = sums[:-1]
            total[i] = sums[-1] if len(sums) else 0.0
        step = (np.arange(len(edge)) - begin[text]).astype(np.uint64)
        draws = uniform(seeds[text] + mix((step << np.uint64(16)) + np.uint64(2 * sample + 1)))
        value = np.where(fresh, -np.inf, _truncated(before + lattice.rest[edge], bound[text], draws))
        paths.append(Paths(text, word, edge, before, value, begin))
        for i in np.nonzero(alive)[0].tolist():
            found[i].append((begin[i], end[i], sample, float(total[i]), float(bound[i])))
        values, places = zip(*(p.best(n) for p in paths))
        chosen = np.argmax(np.stack(values), axis=0)
        bound = np.max(np.stack(values), axis=0)
        alive &= np.isfinite(bound)
        if sample == k - 1 or not alive.any():
            break
        # Each text leaves one of its paths: the part before is shared, an edge not taken yet comes next.
        kept_text, kept_word, kept_edge, new_node, new_text, new_word = [], [], [], [], [], []
        for i in np.nonzero(alive)[0].tolist():
            p, at = paths[chosen[i]], int(places[chosen[i]][i])
            taken = p.excluded.setdefault(at, [int(p.edge[at])])
            node = int(lattice.source[p.edge[at]])
            others = [e for e in range(lattice.first[node], lattice.first[node] + lattice.count[node]) if e not in taken]
            share = np.cumsum(np.exp(lattice.logp[others] - lattice.logp[others].max()))
            a = int(p.begin[i])
            seed = seeds[i : i + 1] ^ mix(np.array([sample + 1 << 40 | at - a], dtype=np.uint64))
            pick = others[min(int(np.searchsorted(share, uniform(seed)[0] * share[-1], side="right")), len(others) - 1)]
            taken.append(pick)
            mass = np.array([p.before[at] + _mass_left(lattice, taken)])
            p.value[at] = _truncated(mass, bound[i : i + 1], uniform(mix(seed)))[0]
            kept_text.append(np.full(at - a + 1, i))
            kept_word.append(p.word[a : at + 1])
            kept_edge.append(np.append(p.edge[a:at], pick))
            later = np.arange(p.word[at] + 1, first_word[i + 1])
            rest_of_word = int(lattice.after[pick] >= 0)
            new_node += [lattice.after[pick : pick + 1]] * rest_of_word + [lattice.start[slot[later]]]
            new_word += [p.word[at : at + 1]] * rest_of_word + [later]
            new_text.append(np.full(len(later) + rest_of_word, i))
        a = np.concatenate(new_word)
        text2, word2, edge2 = _go_on(lattice, np.concatenate(new_text), a, np.concatenate(new_node), word_seed[a], sample + 1)
        shared = np.concatenate(kept_text)
        text, word, edge = np.concatenate([shared, text2]), np.concatenate([np.concatenate(kept_word), word2]), np.concatenate([np.concatenate(kept_edge), edge2])
        fresh = np.arange(len(text)) < len(shared)
        order = np.argsort(text, kind="stable")
        text, word, edge, fresh = text[order], word[order], edge[order], fresh[order]
    threshold = bound
    out = []
    for i in range(n):
        rows = []
        for begin_, end_, sample, logp, perturbed in found[i]:
            odds = logp - threshold[i]
            inclusion = 0.0 if np.isneginf(threshold[i]) else odds if odds < -30 else math.log(-math.expm1(-math.exp(min(odds, 700.0))))
            rows.append((_ids(vocab, lattice.piece[paths[sample].edge[begin_:end_]]), logp, perturbed, inclusion))
        out.append(rows)
    return out


def _words(normal: str) -> list[str]:
    """``normal`` cut before each run of marks of white space."""
    return re.findall(f"{GAP}*[^{GAP}]+|{GAP}+", normal)


def _ids(vocab: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    """The ids of pieces; a negative one stands for a character spelled in bytes."""
    if not len(pieces) or pieces.min() >= 0:
        return pieces
    low = (pieces < 0) & (pieces >= -128)
    if low.any():
        pieces = np.where(low, vocab.byte_ids[np.where(low, -1 - pieces, 0)], pieces)
    (raw,) = np.nonzero(pieces < 0)
    if not len(raw):
        return pieces
    parts, at = [], 0
    for r in raw.tolist():
        data = chr(-1 - int(pieces[r])).encode("utf-8", "surrogatepass")
        parts += [pieces[at:r], vocab.byte_ids[list(data)]]
        at = r + 1
    return np.concatenate([*parts, pieces[at:]])


SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of every whole text, in the order drawn, with inclusion scores.

    ``doc_id, sample, n_pieces, ids_crc32`` (unsigned, of little-endian unsigned 32-bit ids), ``log_prob``,
    ``perturbed``, ``log_inclusion`` (log of the probability that the segmentation is among the sample, given
    the threshold), ``round_trip`` (the ids decode to the text) and, with
    ``with_ids``, ``ids``. A null or empty text has one segmentation, that of no pieces; a text with fewer
    than ``k`` has as many rows. Equal ids seed alike, null ids as one; repeated rows have the same rows
    each; an empty table gives none; other columns are ignored.
    """
    def run(batches):
        vocab = vocabulary(model, alpha)
        forget()
        for batch in sliced(batches, rows=BATCH):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            seeds = np.array([xxhash.xxh64_intdigest(str(i), seed) for i in ids], dtype=np.uint64)
            columns = [[] for _ in range(9)]
            for doc_id, text, rows in zip(ids, texts, sample_batch(vocab, texts, seeds, k)):
                for sample, (piece_ids, logp, perturbed, inclusion) in enumerate(rows):
                    values = doc_id, sample, len(piece_ids), zlib.crc32(piece_ids.astype("<u4")), logp, perturbed, inclusion, vocab.round_trip(piece_ids, text), piece_ids if with_ids else None
                    for column, value in zip(columns, values):
                        column.append(value)
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())
            names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"]
            keep = 9 if with_ids else 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds)], names[:keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
