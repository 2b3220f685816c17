"""Repeated substrings across documents by common-prefix interval trees.

:func:`maximal_repeats` is the method, which :func:`remove_repeats` replaces by
grouping equal windows (see README); only tests call it: an enhanced suffix array (suffixes in
order, common prefixes of neighbours), scanned with a stack that opens and
closes common-prefix intervals; an interval whose suffixes have different left
neighbours cannot be extended to the left, so it is a maximal repeat, and it is
put out with all its occurrences.

At scale one suffix array over everything is out of reach, so the text is dealt
out by content. Every ``MIN_BYTES``-byte window has an anchor, the smallest hash
among its ``GRAM``-byte substrings; equal windows have equal anchors. A run of
windows with one anchor is a segment. Segments whose anchor occurs in two
documents meet in a bucket of that anchor's hash; there the suffix array of the
distinct segments, compared ``MIN_BYTES`` deep, groups equal windows and gives
each the smallest document id that has it. No repeat group is put out, and
neither the stack scan nor the left-extension test is run.

1. Texts go into chunks of about ``CHUNK_BYTES`` (whole documents), written once.
2. Each chunk sends its distinct anchors, packed, to buckets; a bucket answers
   with a bit for each: in another chunk too? A second bit marks hot anchors,
   whose distinct segments have more than ``HOT_BYTES`` in all chunks together:
   at the edges of a frequent passage every document has a segment of its own.
3. Each chunk sends its shared segments, each distinct one once with its
   smallest document id: a passage in a third of all documents is one row a
   chunk. Which occurrence has which segment stays with the chunk. Segments of
   hot anchors go as their distinct windows, dealt out to lanes by a second
   hash, of the whole window, so no group holds all that one anchor has.
4. Buckets answer with the windows' smallest ids; the chunk removes every byte
   covered by a window with a smaller id than its document's.

Number of buckets, lanes and chunks follow the input, so what a task holds does
not.

Cases: null texts are empty; texts under ``MIN_BYTES`` keep all; rows without an
id keep all and count for nobody; rows that share an id never remove each
other's text (their id is not smaller) but both lose what smaller ids have;
matches never cross documents; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .frames import written

MIN_BYTES = 50
GRAM = 24
CHUNK_BYTES = 4 << 20
#: text bytes that one bucket answers for
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 32
#: distinct segment bytes of one anchor beyond which its windows are dealt out one by one
HOT_BYTES = 256 << 10
#: segment bytes of hot anchors in one lane
LANE_BYTES = 1 << 20
_PIECE = 1 << 20


# ---------------------------------------------------------------- suffix array

def suffix_array(texts: list[bytes], least: int, depth: int | None = None):
    """Enhanced suffix array of ``texts``, of the suffixes with at least
    ``least`` bytes. Returns (lcp, text, off): the common prefix of each suffix
    with the one before (first 0), its text and its offset, in suffix order.
    Suffixes end with their text; with ``depth`` they are only compared, and
    common prefixes only counted, that far."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    text_of = np.repeat(np.arange(len(texts)), size)
    end = np.cumsum(size)[text_of]
    left = end - np.arange(n)

    # ranks of prefixes of 7, 14, 28, ... bytes; what lies beyond the text's end is smaller than any byte
    key = np.zeros(n, np.uint64)
    for k in range(7):
        byte = np.zeros(n, np.uint64)
        byte[:n - k] = data[k:].astype(np.uint64) + np.uint64(1)
        byte[left <= k] = 0
        key = key * np.uint64(257) + byte
    steps, ranks = [7], [np.unique(key, return_inverse=True)[1].astype(np.int64)]
    longest = min(int(size.max(initial=0)), depth or n)
    while steps[-1] < longest and ranks[-1].max(initial=0) < n - 1:
        step, rank = steps[-1], ranks[-1]
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        after[left <= step] = 0
        ranks.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        steps.append(2 * step)

    pos = np.flatnonzero(left >= least)
    pos = pos[np.argsort(ranks[-1][pos], kind="stable")]
    lcp = np.zeros(len(pos), np.int64)
    a, b = pos[:-1], pos[1:]
    most = np.minimum(np.minimum(left[a], left[b]), longest)
    got = np.zeros(len(a), np.int64)
    for step, rank in zip([1, *steps][::-1], [data, *ranks][::-1], strict=True):
        for _ in range(6 if step == 1 else 1):
            on = np.flatnonzero(got < most)
            on = on[rank[a[on] + got[on]] == rank[b[on] + got[on]]]
            got[on] += step
    lcp[1:] = np.minimum(got, most)
    return lcp, text_of[pos], pos - (end - size[text_of])[pos]


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, end, length) of the common-prefix intervals of at least
    ``least``, inner ones before those that hold them."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []          # (length, first suffix)
    for i, length in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > length:
            size, first = stack.pop()
            out.append((first, i, size))
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return out


def _outermost(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First suffix and end of the outermost intervals (single suffixes included)."""
    first = np.flatnonzero(lcp < least)
    return first, np.append(first[1:], len(lcp))


def maximal_repeats(texts: list[bytes], least: int = MIN_BYTES) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, offset), ...]) of all maximal repeats of at least
    ``least`` bytes, each with all its occurrences."""
    if not any(len(t) >= least for t in texts):
        return []
    lcp, text, off = suffix_array(texts, least)
    # the byte to the left of each suffix; at a text's start it differs from all others
    start = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    before = np.where(off > 0, data[start[text] + off - 1].astype(np.int64), -1 - np.arange(len(off)))
    turn = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    found = []
    for s, e in zip(*_outermost(lcp, least), strict=True):
        # an interval without left diversity holds none that has it: only the others are scanned
        if e - s > 1 and turn[e - 1] > turn[s]:
            for i, j, size in lcp_intervals(lcp[s:e], least):
                if turn[s + j - 1] > turn[s + i]:
                    where = zip(text[s + i:s + j].tolist(), off[s + i:s + j].tolist(), strict=True)
                    found.append((int(size), sorted(where)))
    return found


def window_minima(texts: list[bytes], owner: np.ndarray, least: int) -> list[np.ndarray]:
    """For each text the smallest ``owner`` among the texts that have each of
    its ``least``-byte windows.

    A window's occurrences are the suffixes of one outermost common-prefix
    interval, whichever maximal repeats hold it, so the intervals are read at
    that depth: the same tree, without walking the nested intervals that
    periodic text has by the thousand."""
    count = np.array([len(t) - least + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum(count)))
    lcp, text, off = suffix_array(texts, least, least)
    begin, end = _outermost(lcp, least)
    low = np.minimum.reduceat(owner[text], begin)
    out = np.empty(first[-1], np.int64)
    out[first[text] + off] = np.repeat(low, end - begin)
    return np.split(out, first[1:-1])


# --------------------------------------------------------------------- anchors

def window_anchors(data: np.ndarray, least: int, gram: int) -> np.ndarray:
    """The anchor of the window at each position: smallest hash of its grams."""
    n_win = len(data) - least + 1
    if n_win <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n_win, np.uint64)
    pw = tk.powers(gram + 1)
    for at in range(0, n_win, _PIECE):
        part = data[at:min(at + _PIECE, n_win) + least - 1]
        h, width = tk._BYTE_KEY[part], 1
        whole, done = None, 0
        size = gram
        while size:                       # hash of gram bytes from hashes of 1, 2, 4, ... bytes
            if size & 1:
                whole = h if whole is None else whole[:len(h) - done] * pw[width] + h[done:][:len(whole)]
                done += width
            size >>= 1
            if size:
                h = h[:-width] * pw[width] + h[width:]
                width *= 2
        low = tk.mix64(whole[:len(part) - gram + 1])
        width, need = 1, least - gram + 1
        while 2 * width <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < need:
            low = np.minimum(low[:len(low) - (need - width)], low[need - width:])
        out[at:at + len(low)] = low
    return out


def segments(data: np.ndarray, offs: np.ndarray, has_id: np.ndarray, least: int, gram: int):
    """(start, windows, key, doc) of the runs of windows with one anchor."""
    anchor = window_anchors(data, least, gram)
    starts = np.arange(len(anchor))
    doc = np.searchsorted(offs, starts, side="right") - 1
    ok = (offs[1:][doc] - starts >= least) & has_id[doc]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
    s = np.flatnonzero(new)
    size = np.diff(np.append(s, len(anchor)))
    keep = ok[s]
    return s[keep], size[keep], tk.mix64(anchor[s[keep]]), doc[s[keep]]


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Chunk:
    """Documents of one chunk row and their segments."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.has_id = np.frombuffer(row["has_id"], bool)
        self.offs = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int64))))
        raw = pa.decompress(row["text"], int(self.offs[-1]), codec="zstd", asbytes=True) if self.offs[-1] else b""
        self.data = np.frombuffer(raw, np.uint8)

    def shared(self, least: int, gram: int):
        """Segments, sorted distinct keys, each segment's key number, and for
        each key whether two documents of this chunk have it."""
        seg = segments(self.data, self.offs, self.has_id, least, gram)
        keys, inv = np.unique(seg[2], return_inverse=True)
        both = np.zeros(len(keys), bool)
        if len(keys):
            order = np.argsort(inv, kind="stable")
            edge = np.searchsorted(inv[order], np.arange(len(keys)))
            ids = self.ids[seg[3][order]]
            both = np.minimum.reduceat(ids, edge) != np.maximum.reduceat(ids, edge)
        return seg, keys, inv, both

    def volume(self, seg, n_keys: int, inv: np.ndarray, least: int) -> np.ndarray:
        """For each key a power of two (its exponent) that the bytes of its
        distinct segments do not exceed."""
        length = seg[1] + least - 1
        total = np.bincount(inv, length, n_keys).astype(np.int64)
        many = np.flatnonzero((total > 1024)[inv])
        if len(many):
            raw = self.data.tobytes()
            distinct: dict[int, set[bytes]] = {}
            for k, a, b in zip(inv[many].tolist(), seg[0][many].tolist(), (seg[0] + length)[many].tolist(), strict=True):
                distinct.setdefault(k, set()).add(raw[a:b])
            for k, texts in distinct.items():
                total[k] = sum(map(len, texts))
        return np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)


_CHUNK = "chunk long, bytes long, ids binary, has_id binary, sizes binary, text binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    for b in batches:
        data, offs = tk.text_buffer(b["text"])
        ids = b["id"].fill_null(0).to_numpy(zero_copy_only=False)
        has = b["id"].is_valid().to_numpy(zero_copy_only=False)
        for a, z in tk.slices(offs, CHUNK_BYTES):
            raw = data[offs[a]:offs[z]].tobytes()
            yield pa.RecordBatch.from_pylist([{
                "chunk": at, "bytes": len(raw), "ids": ids[a:z].astype(np.int64).tobytes(), "has_id": has[a:z].tobytes(),
                "sizes": np.diff(offs[a:z + 1]).tobytes(), "text": pa.compress(raw, "zstd", asbytes=True) if raw else b""}],
                schema=pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()),
                                  ("has_id", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())]))
            at += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b[n][i].as_py() for n in b.schema.names}


def _bucket_edges(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(_bucket(keys, n).astype(np.int64), np.arange(n + 1))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_PART = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
_PART_SQL = "bucket long, chunk long, blob binary"


_BITS = _PART.append(pa.field("hot", pa.int64()))


def _send_keys(n: int, least: int, gram: int):
    """Step 2: the low 48 bits of each chunk's distinct keys and their volume, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            seg, keys, inv, _ = c.shared(least, gram)
            edge = _bucket_edges(keys, n)
            low = keys.view(np.uint8).reshape(-1, 8)[:, :6]
            volume = c.volume(seg, len(keys), inv, least)
            yield _batch([(k, row["chunk"], low[edge[k]:edge[k + 1]].tobytes() + volume[edge[k]:edge[k + 1]].tobytes())
                          for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist()], _PART)
    return run


def _shared_bits(hot_bytes: int):
    def run(t: pa.Table) -> pa.Table:
        """Step 2, in a bucket: one bit for each key, set if two chunks have it,
        and, if there are any, one for each key set if it is hot."""
        blobs = t["blob"].to_pylist()
        n = np.array([len(b) // 7 for b in blobs])
        wide = np.zeros((n.sum(), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(b[:6 * k] for b, k in zip(blobs, n, strict=True)), np.uint8).reshape(-1, 6)
        key = wide.view(np.uint64).ravel()
        volume = np.frombuffer(b"".join(b[6 * k:] for b, k in zip(blobs, n, strict=True)), np.uint8)
        volume = np.int64(1) << volume.astype(np.int64)
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        first = np.flatnonzero(new)
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        on = (np.diff(np.append(first, len(key))) > 1)[of]
        hot = (np.add.reduceat(volume[order], first) > hot_bytes)[of]
        edge = np.concatenate(([0], np.cumsum(n)))
        rows = [(b, c, np.packbits(on[i:j]).tobytes() + (np.packbits(hot[i:j]).tobytes() if hot[i:j].any() else b""),
                 int(volume[i:j][hot[i:j]].sum()))
                for b, c, i, j in zip(t["bucket"].to_pylist(), t["chunk"].to_pylist(), edge[:-1], edge[1:], strict=True)
                if on[i:j].any() or hot[i:j].any()]
        return pa.Table.from_batches([_batch(rows, _BITS)])
    return run


def _pack(*arrays: np.ndarray) -> bytes:
    """Lengths and bytes of some arrays, compressed."""
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    raw = head + b"".join(a.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    size = np.frombuffer(raw[:8 * len(kinds)], np.int64)
    at = 8 * len(kinds) + np.concatenate(([0], np.cumsum(size)))
    return [np.frombuffer(raw[at[i]:at[i + 1]], k) for i, k in enumerate(kinds)]


class Shared:
    """The shared segments of a chunk: distinct ones numbered by key (so by
    bucket), ``at``: first number of each bucket; ``start``, ``doc`` and ``of``
    (number) of every occurrence.

    Of hot keys the windows: distinct ones numbered by lane in ``windows``,
    ``lane_at``: first number of each lane; ``hot_start``, ``hot_doc`` and
    ``hot_of`` (number) of every occurrence."""

    def __init__(self, row: dict, n: int, lanes: int, least: int, gram: int):
        self.chunk = c = Chunk(row)
        (start, size, _, doc), keys, inv, on = c.shared(least, gram)
        edge = _bucket_edges(keys, n)
        hot = np.zeros(len(keys), bool)
        for part in row["bits"] or []:
            i, j = edge[part["bucket"]], edge[part["bucket"] + 1]
            wide = -(-(j - i) // 8)
            bits = np.frombuffer(part["blob"], np.uint8)
            on[i:j] |= np.unpackbits(bits[:wide], count=j - i).astype(bool)
            if len(bits) > wide:
                hot[i:j] = np.unpackbits(bits[wide:], count=j - i).astype(bool)
        raw = c.data.tobytes()
        self._deal_windows(raw, start, size, doc, np.flatnonzero((on & hot)[inv]), lanes, least)
        pick = np.flatnonzero((on & ~hot)[inv])
        pick = pick[np.argsort(inv[pick], kind="stable")]
        self.start, self.doc = start[pick], doc[pick]
        number: dict[tuple[int, bytes], int] = {}
        self.of = np.fromiter((number.setdefault((key, raw[s:e]), len(number)) for s, e, key in
                               zip(self.start.tolist(), (self.start + size[pick] + least - 1).tolist(),
                                   inv[pick].tolist(), strict=True)), np.int64, len(pick))
        key_of = np.fromiter((k for k, _ in number), np.int64, len(number))
        self.key, self.text = keys[key_of], [t for _, t in number]
        self.at = np.searchsorted(key_of, edge)

    def _deal_windows(self, raw: bytes, start, size, doc, pick, lanes: int, least: int) -> None:
        self.hot_start = np.repeat(start[pick], size[pick])
        self.hot_start += np.arange(len(self.hot_start)) - np.repeat(np.cumsum(size[pick]) - size[pick], size[pick])
        self.hot_doc = np.repeat(doc[pick], size[pick])
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(raw[s:s + least], len(number)) for s in self.hot_start.tolist()),
                         np.int64, len(self.hot_start))
        lane = np.fromiter((zlib.crc32(w) % lanes for w in number), np.int64, len(number))
        order = np.argsort(lane, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        windows = list(number)
        self.windows, self.hot_of = [windows[k] for k in order.tolist()], place[of]
        self.lane_at = np.searchsorted(lane[order], np.arange(lanes + 1))


def _send_segments(n: int, lanes: int, least: int, gram: int):
    """Step 3: distinct shared segments with their smallest ids, by bucket, and
    the distinct windows of hot ones, by lane (numbered after the buckets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Shared(row, n, lanes, least, gram)
            low = np.full(len(s.text), np.iinfo(np.int64).max)
            np.minimum.at(low, s.of, s.chunk.ids[s.doc])
            length = np.array([len(t) for t in s.text], np.int32)
            yield _batch([(k, row["chunk"], _pack(s.key[i:j], length[i:j], low[i:j],
                                                  np.frombuffer(b"".join(s.text[i:j]), np.uint8)))
                          for k in np.flatnonzero(s.at[1:] > s.at[:-1]).tolist() for i, j in [(s.at[k], s.at[k + 1])]], _PART)
            low = np.full(len(s.windows), np.iinfo(np.int64).max)
            np.minimum.at(low, s.hot_of, s.chunk.ids[s.hot_doc])
            yield _batch([(n + k, row["chunk"], _pack(low[i:j], np.frombuffer(b"".join(s.windows[i:j]), np.uint8)))
                          for k in np.flatnonzero(s.lane_at[1:] > s.lane_at[:-1]).tolist()
                          for i, j in [(s.lane_at[k], s.lane_at[k + 1])]], _PART)
    return run


def _answer_windows(t: pa.Table, least: int) -> pa.Table:
    """Step 4, in a lane: the smallest id of every window of every chunk."""
    parts = [_unpack(b, np.int64, np.uint8) for b in t["blob"].to_pylist()]
    number: dict[bytes, int] = {}
    of = []
    for ids, data in parts:
        raw = data.tobytes()
        of.append(np.array([number.setdefault(raw[i:i + least], len(number)) for i in range(0, len(raw), least)], np.int64))
    owner = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owner, np.concatenate(of), np.concatenate([ids for ids, _ in parts]))
    rows = [(b, c, _pack(owner[o])) for b, c, o in zip(t["bucket"].to_pylist(), t["chunk"].to_pylist(), of, strict=True)]
    return pa.Table.from_batches([_batch(rows, _PART)])


def _answer(n: int, least: int):
    def run(t: pa.Table) -> pa.Table:
        """Step 4, in a bucket: runs of windows with one smallest id, for every
        segment of every chunk."""
        if t["bucket"][0].as_py() >= n:
            return _answer_windows(t, least)
        parts = [_unpack(b, np.uint64, np.int32, np.int64, np.uint8) for b in t["blob"].to_pylist()]
        number: dict[tuple[int, bytes], int] = {}
        of, low = [], []
        for key, length, ids, data in parts:
            raw, edge = data.tobytes(), np.concatenate(([0], np.cumsum(length))).tolist()
            of.append(np.array([number.setdefault((k, raw[i:j]), len(number)) for k, i, j in
                                zip(key.tolist(), edge[:-1], edge[1:], strict=True)], np.int64))
            low.append(ids)
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, np.concatenate(of), np.concatenate(low))
        text = [x for _, x in number]
        # a key with one segment has nothing to compare: all its windows have that segment's smallest id
        key = np.fromiter((k for k, _ in number), np.uint64, len(number))
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        upto = [np.array([len(x) - least + 1], np.int64) for x in text]
        lows = [np.array([o], np.int64) for o in owner]
        many = np.flatnonzero(count[inv] > 1)
        if len(many):
            for k, w in zip(many.tolist(), window_minima([text[k] for k in many], owner[many], least), strict=True):
                last = np.flatnonzero(np.append(w[1:] != w[:-1], True))
                upto[k], lows[k] = last + 1, w[last]
        rows = []
        for b, c, o in zip(t["bucket"].to_pylist(), t["chunk"].to_pylist(), of, strict=True):
            rows.append((b, c, _pack(np.array([len(upto[k]) for k in o], np.int32),
                                     np.concatenate([upto[k] for k in o]).astype(np.int32),
                                     np.concatenate([lows[k] for k in o]))))
        return pa.Table.from_batches([_batch(rows, _PART)])
    return run


def _removed(row: dict, n: int, lanes: int, least: int, gram: int) -> tuple[Chunk, np.ndarray]:
    """The chunk and a mark on every byte to remove."""
    if not row["answers"]:
        c = Chunk(row)
        return c, np.zeros(len(c.data), bool)
    sh = Shared(row, n, lanes, least, gram)
    c = sh.chunk
    step = np.zeros(len(c.data) + 1, np.int64)
    none = np.zeros(0, np.int64)
    runs, upto, low, window_low = np.zeros(len(sh.text), np.int64), [none], [none], [none]
    for part in sorted(row["answers"], key=lambda p: p["bucket"]):
        if part["bucket"] >= n:
            window_low += _unpack(part["blob"], np.int64)
            continue
        a, b, m = _unpack(part["blob"], np.int32, np.int32, np.int64)
        runs[sh.at[part["bucket"]]:sh.at[part["bucket"] + 1]] = a
        upto.append(b)
        low.append(m)
    upto, low = np.concatenate(upto).astype(np.int64), np.concatenate(low)
    first = np.concatenate(([0], np.cumsum(runs)))
    begin = np.concatenate(([0], upto))[:len(upto)]
    begin[first[:-1]] = 0
    # every occurrence with each of its segment's runs
    times = runs[sh.of]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[:-1][sh.of], times)
    gone = low[at] < np.repeat(c.ids[sh.doc], times)
    s = np.repeat(sh.start, times)[gone]
    np.add.at(step, s + begin[at[gone]], 1)
    np.add.at(step, s + upto[at[gone]] + least - 1, -1)
    s = sh.hot_start[np.concatenate(window_low)[sh.hot_of] < c.ids[sh.hot_doc]]
    np.add.at(step, s, 1)
    np.add.at(step, s + least, -1)
    return c, np.cumsum(step[:-1]) > 0


def _finish(n: int, lanes: int, least: int, gram: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c, gone = _removed(row, n, lanes, least, gram)
            turn = gone.copy()
            turn[1:] &= ~gone[:-1]
            turn[c.offs[:-1][c.offs[:-1] < len(gone)]] |= gone[c.offs[:-1][c.offs[:-1] < len(gone)]]
            n_gone = np.concatenate(([0], np.cumsum(gone)))
            n_span = np.concatenate(([0], np.cumsum(turn)))
            keep = [c.data[a:b][~gone[a:b]].tobytes() for a, b in zip(c.offs[:-1], c.offs[1:], strict=True)]
            out = {"doc_id": pa.array(c.ids, pa.int64(), mask=~c.has_id), "n_bytes": pa.array(np.diff(c.offs)),
                   "n_removed": pa.array(n_gone[c.offs[1:]] - n_gone[c.offs[:-1]]),
                   "n_spans": pa.array(n_span[c.offs[1:]] - n_span[c.offs[:-1]]),
                   "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in keep], pa.string())}
            if with_text:
                out["kept"] = pa.array(keep, pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_BYTES, gram: int = GRAM,
                   with_text: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): every
    document without the bytes covered by a ``least``-byte string that also
    starts in a document with a smaller id. ``kept``: the remaining bytes."""
    if not 1 <= gram <= least:
        raise ValueError("gram must be between 1 and least")
    chunks = written(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
                     .mapInArrow(_chunks, _CHUNK), "repeats-chunks", codec="none")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    n = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    by_chunk = lambda df, name, *more: df.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "blob")).alias(name), *more)
    bits = written(by_chunk(chunks.mapInArrow(_send_keys(n, least, gram), _PART_SQL).groupBy("bucket")
                            .applyInArrow(_shared_bits(hot_bytes), _PART_SQL + ", hot long"), "bits",
                            F.sum("hot").alias("hot")), "repeats-bits")
    lanes = max(1, -(-(bits.agg(F.sum("hot")).first()[0] or 0) // LANE_BYTES))
    bits = bits.drop("hot")
    # a chunk's shared segments are found again in the last step: cheaper than keeping them
    answers = written(by_chunk(chunks.join(bits.hint("shuffle_hash"), "chunk", "left")
                               .mapInArrow(_send_segments(n, lanes, least, gram), _PART_SQL)
                               .groupBy("bucket").applyInArrow(_answer(n, least), _PART_SQL), "answers"),
                      "repeats-answers", codec="none")
    replies = answers.join(bits, "chunk", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (chunks.join(replies.hint("shuffle_hash"), "chunk", "left")
            .mapInArrow(_finish(n, lanes, least, gram, with_text), schema + (", kept binary" if with_text else "")))
