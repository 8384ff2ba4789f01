"""Suffix arrays by induced sorting (SA-IS), and permuted common prefixes from them.

Suffixes are classed as smaller or larger than their successor; the leftmost smaller ones are sorted by
their substrings, by recursion where names of substrings repeat; all others follow by two inducing
passes. A pass goes bucket by bucket over arrays where buckets are large, as for bytes, and entry by
entry where they are small, as for the names of a recursion; both take linear time.
"""

from __future__ import annotations

import numpy as np

#: Mean bucket from which a pass goes by bucket.
LARGE_BUCKET = 400


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of ``t`` in order; ``t`` is of integers from 0, and ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    (differs,) = np.nonzero(t[:-1] != t[1:])
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = (t[differs] < t[differs + 1])[np.searchsorted(differs, np.arange(n - 1))]
    lms = np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1
    sizes = np.bincount(t)
    induce = _by_bucket if n / len(sizes) >= LARGE_BUCKET else _by_entry
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    by_substring = induce(t, smaller, sizes, lms)
    by_substring = by_substring[is_lms[by_substring]]
    fresh = _differs_from_previous(t, lms, by_substring)
    names = np.empty(n, dtype=np.int64)
    names[by_substring] = np.cumsum(fresh) - 1
    if not fresh.all():
        by_substring = lms[suffix_array(names[lms])]
    return induce(t, smaller, sizes, by_substring)


def _differs_from_previous(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the leftmost-smaller substrings, in order, differ from the one before."""
    ends = np.empty(len(t), dtype=np.int64)
    ends[lms] = np.append(lms[1:], len(t) - 1)
    a, b = ordered[:-1], ordered[1:]
    length = ends[a] - a
    out = np.ones(len(ordered), dtype=bool)
    (alike,) = np.nonzero((length == ends[b] - b) & (length > 0))
    k = 0
    while len(alike):
        alike = alike[t[a[alike] + k] == t[b[alike] + k]]
        whole = length[alike] == k
        out[alike[whole] + 1] = False
        alike, k = alike[~whole], k + 1
    return out


def _by_entry(t: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, text, small = len(t), t.tolist(), smaller.tolist()
    ends = np.cumsum(sizes)
    sa, tail = [-1] * n, ends.tolist()
    for p in reversed(lms.tolist()):
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = (ends - sizes).tolist()
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = text[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return np.array(sa, dtype=np.int64)


def _grouped(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``p`` by bucket, in order within each; the bucket of each, and its rank there."""
    c = t[p]
    order = np.argsort(c, kind="stable")
    c = c[order]
    first = np.nonzero(np.append(True, c[1:] != c[:-1]))[0] if len(c) else np.zeros(0, np.int64)
    rank = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    return p[order], c, rank


def _by_bucket(t: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, ends = len(t), np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, dtype=np.int64)
    p, c, rank = _grouped(t, lms)
    n_lms = np.bincount(t[lms], minlength=len(sizes))
    sa[ends[c] - n_lms[c] + rank] = p
    head = starts.copy()

    def put_larger(block: np.ndarray) -> None:
        p = block - 1
        p = p[p >= 0]
        p, c, rank = _grouped(t, p[~smaller[p]])
        sa[head[c] + rank] = p
        np.add.at(head, c, 1)

    for b in np.nonzero(sizes)[0].tolist():
        done = starts[b]
        while done < head[b]:
            to = head[b]
            put_larger(sa[done:to])
            done = to
        if n_lms[b]:
            put_larger(sa[ends[b] - n_lms[b] : ends[b]])
    tail = ends.copy()

    def put_smaller(block: np.ndarray) -> None:
        p = block - 1
        p = p[p >= 0]
        p, c, rank = _grouped(t, p[smaller[p]])
        sa[tail[c] - 1 - rank] = p
        np.subtract.at(tail, c, 1)

    for b in np.nonzero(sizes)[0][::-1].tolist():
        done = ends[b]
        while done > tail[b]:
            to = tail[b]
            put_smaller(sa[to:done][::-1])
            done = to
        put_smaller(sa[starts[b] : head[b]][::-1])
    return sa


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``t``, the symbols its suffix shares with the one before it in ``sa``, up to ``most``.

    All places go on together, four symbols at a time, and leave where their suffixes part. ``t`` has
    symbols below 2**16; those past its end differ from all.
    """
    n = len(t)
    padded = np.concatenate([t.astype("<u2"), np.zeros(most + 8, "<u2")])
    words = np.zeros(n + most + 4, dtype="<u8")
    for k in range(4):
        words |= padded[k : k + len(words)].astype("<u8") << np.uint64(16 * k)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int64)
    (at,) = np.nonzero(before >= 0)
    for k in range(0, most, 4):
        apart = words[at + k] ^ words[before[at] + k]
        (stop,) = np.nonzero(apart)
        if len(stop):
            low = apart[stop] & (~apart[stop] + np.uint64(1))
            out[at[stop]] = k + (np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 16)
            at = at[apart == 0]
    out[at] = most
    return np.minimum(out, most)
