"""Periodic runs of words: stretches in which a block of words repeats.

A run is a stretch of a document with smallest period q (words q apart are
equal) that no neighbouring word extends and that holds at least ``min_power``
periods and ``min_length`` words. They are found by the branching-tandem test on
an enhanced suffix array of the words:

1. words get numbers per document; the suffix array comes from prefix doubling,
   which also gives the inverse (``rank``) and the common-prefix lengths;
2. a stack scan lists the common-prefix intervals of each depth p, with the
   largest child of each;
3. for a suffix i of the smaller children, ``rank[i + p]`` or ``rank[i - p]``
   inside the interval shows a square of period p; it counts where the next word
   breaks the period (the branching one, the last of its run);
4. squares are rotated to the left until the period breaks, which gives the run;
   multiples of a run's period end at the same word and are merged into it.

There are no tree nodes, only arrays; all documents of a batch share one suffix
array, since their numbers differ. Words that cannot lie in any run are left out
before: each pair of neighbouring words of a run occurs ``min_power - 1`` times
in it, so only stretches made of such pairs are indexed. That changes no result.

Cases: null and empty texts have no words and no runs; a text of any length is
taken whole (its words and some arrays of their number are in memory); repeated
rows and null ids keep their own result; extra columns are left out; an empty
table gives an empty result. Words are runs of bytes other than ASCII white space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_POWER = 4
#: documents are indexed together up to this many words (one document at least)
WORDS_AT_ONCE = 1 << 18
#: suffixes tested at once
TESTS_AT_ONCE = 1 << 20

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, rank, lcp) of whole numbers whose last one is unique.
    ``lcp[k]`` belongs to suffixes k - 1 and k; ``lcp[0]`` is 0."""
    n = len(t)
    slot = np.arange(n)
    sa = np.argsort(t, kind="stable")
    first = np.concatenate(([True], t[sa[1:]] != t[sa[:-1]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, slot, 0))
    # equal numbers in levels[j]: equal first 2 ** j words
    levels, h = [rank.astype(np.int32)], 1
    while not first.all():
        alone = first & np.append(first[1:], True)
        at = np.flatnonzero(~alone)
        i = sa[at]
        # suffixes that share h words end later than h words on: their last word is unique
        key = rank[i] * n + rank[i + h]
        by = np.argsort(key, kind="stable")
        sa[at], key = i[by], key[by]
        first[at[1:]] |= key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(first, slot, 0))
        rank[sa[at]] = start[at]
        levels.append(rank.astype(np.int32))
        h *= 2
    lcp = np.zeros(n, np.int64)
    a, b, length = sa[:-1].copy(), sa[1:].copy(), lcp[1:]
    for j in range(len(levels) - 1, -1, -1):
        step = (levels[j][a] == levels[j][b]).astype(np.int64) << j
        a += step
        b += step
        length += step
    return sa, rank, lcp


def intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """Rows (depth, first, end, first and end of the largest child) of the
    common-prefix intervals of at least ``least`` suffixes."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []            # depth, first, largest child, start of the open child
    for k, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = k - 1
        while stack and stack[-1][0] > depth:
            d, first, big, end, cut = stack.pop()
            if k - cut > end - big:
                big, end = cut, k
            if k - first >= least:
                out.append((d, first, k, big, end))
        if depth:
            if stack and stack[-1][0] == depth:
                node = stack[-1]
                if k - node[4] > node[3] - node[2]:
                    node[2], node[3] = node[4], k
                node[4] = k
            else:
                stack.append([depth, first, first, k, k])
    return np.array(out, np.int64).reshape(-1, 5)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1, one span after the other."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def branching_squares(t: np.ndarray, sa: np.ndarray, rank: np.ndarray, found: np.ndarray, power: int) -> np.ndarray:
    """Rows (end, period) of the squares whose next word breaks the period and
    that have ``power`` periods before that end."""
    out = []
    small = (found[:, 2] - found[:, 1]) - (found[:, 4] - found[:, 3])
    cuts = np.flatnonzero(np.diff(np.cumsum(small) // TESTS_AT_ONCE)) + 1
    for part in np.split(found, cuts):
        depth, lo, hi, big, end = part.T
        i = np.concatenate((sa[_spans(lo, big - lo)], sa[_spans(end, hi - end)]))
        own = np.concatenate((np.repeat(np.arange(len(part)), big - lo), np.repeat(np.arange(len(part)), hi - end)))
        p, lo, hi = depth[own], lo[own], hi[own]
        for back in (0, 1):
            # the square's first half starts at i or, seen from its second half, at i - p
            s = i - p * back
            other = i + p if not back else s
            ok = other >= 0
            ok[ok] = (rank[other[ok]] >= lo[ok]) & (rank[other[ok]] < hi[ok])
            ok[ok] = t[s[ok] + p[ok]] != t[s[ok] + 2 * p[ok]]
            for k in range(1, power - 1):
                ok &= s >= k * p
                ok[ok] = (rank[(s - k * p)[ok]] >= lo[ok]) & (rank[(s - k * p)[ok]] < hi[ok])
            out.append(np.stack((s[ok] + 2 * p[ok], p[ok]), 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _rotated(t: np.ndarray, end: int, p: int, power: int) -> int:
    """Where the run of period ``p`` that ends at ``end`` starts."""
    s, step = end - power * p, 64
    while s:
        a = max(0, s - step)
        broken = np.flatnonzero(t[a:s] != t[a + p:s + p])
        if len(broken):
            return a + int(broken[-1]) + 1
        s, step = a, 2 * step
    return s


def find_runs(t: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a number sequence, by start and period."""
    n = len(t)
    least = max(min_length, min_power)
    if n < least:
        return []
    # pairs of neighbours that occur min_power - 1 times, of numbers that occur min_power times
    often = np.bincount(t)[t] >= min_power
    at = np.flatnonzero(often[1:] & often[:-1])
    _, which, count = np.unique(t[at] * (int(t.max()) + 1) + t[at + 1], return_inverse=True, return_counts=True)
    live = np.zeros(n + 1, bool)
    live[at[count[which] >= min_power - 1] + 1] = True          # live[i + 1]: the pair (i, i + 1)
    turn = np.flatnonzero(live[1:] != live[:-1])
    if len(turn) % 2:
        turn = np.append(turn, n)
    first, size = turn[::2], turn[1::2] - turn[::2]
    first, size = first[size >= least - 1], size[size >= least - 1]
    if not len(first):
        return []
    # each stretch of live pairs, and a number of its own after it
    place = _spans(first, size + 2)
    cut = np.cumsum(size + 2) - 1
    place[cut] = -1
    _, seq = np.unique(np.where(place < 0, 0, t[place]), return_inverse=True)
    seq[cut] = seq.max() + 1 + np.arange(len(cut))
    sa, rank, lcp = suffix_array(seq)
    squares = branching_squares(seq, sa, rank, intervals(lcp, min_power), min_power)
    out, merged = [], defaultdict(list)
    for end, p in squares.tolist():
        # a run of period q that fills the square's half is the run of its multiple p too
        if any(p % q == 0 and end - start >= p for start, q in merged[end]):
            continue
        start = _rotated(seq, end, p, min_power)
        merged[end].append((start, p))
        if end - start >= min_length:
            out.append((int(place[start]), end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _indexed(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number a word, different from document to document, and the bounds."""
    edge = np.concatenate(([0], np.cumsum([len(w) for w in docs]))).astype(np.int64)
    t = np.empty(edge[-1], np.int64)
    for words, a, z in zip(docs, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        # the number of a word is the place of its first occurrence
        t[a:z] = np.fromiter(map({}.setdefault, words, range(a, z)), np.int64, z - a)
    return t, edge


def runs_of(docs: list[list[bytes]], min_length: int = MIN_LENGTH,
            min_power: int = MIN_POWER) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each word list."""
    t, edge = _indexed(docs)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for start, length, p in find_runs(t, min_length, min_power):
        d = int(np.searchsorted(edge, start, side="right")) - 1
        out[d].append((start - int(edge[d]), length, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that any run holds after
    its first period."""
    if not runs:
        return b" ".join(words)
    turn = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        turn[start + p] += 1
        turn[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(turn[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  min_power: int = MIN_POWER, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every document's runs as (start,
    length, period) by start and period, and its text without their repetitions.
    ``rewrite`` may change a document's words first."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b["id"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()
            held: list[list[bytes]] = []
            n, begin = 0, 0
            for k, raw in enumerate(texts):
                # bytes.split() cuts at the six ASCII white space bytes
                words = (raw or b"").split()
                held.append(rewrite(ids[k], words) if rewrite else words)
                n += len(held[-1])
                if n >= WORDS_AT_ONCE or k == len(texts) - 1:
                    found = runs_of(held, min_length, min_power)
                    kept = [collapse(w, r) for w, r in zip(held, found, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [b["id"].slice(begin, len(held)), pa.array([len(w) for w in held], pa.int64()),
                         pa.array([[{"start": s, "length": x, "period": p} for s, x, p in r] for r in found], run_type),
                         pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    held, n, begin = [], 0, k + 1

    return (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, "
                             "runs array<struct<start: long, length: long, period: long>>, collapsed string"))
