"""Byte-level text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 buffer of an Arrow string column: a batch is cut
into slices of whole documents (about ``SLICE_BYTES`` each, one document at
least), and words are found and hashed with numpy passes over the slice. Null
texts are treated as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text handled at once inside a task (temporaries take about 60 x)
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240611)
_BYTE_KEY = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _char_table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: words are runs of anything but ASCII white space
NON_SPACE = _char_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words are runs of digits, lower-case ASCII letters and non-ASCII characters
ALNUM = _char_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


#: tokens are runs of one kind: letters (non-ASCII included), digits, other marks
KINDS = np.array([0 if not NON_SPACE[b] else 1 if chr(b).isalpha() and b < 0x80 or b >= 0x80
                  else 2 if 0x30 <= b <= 0x39 else 3 for b in range(256)], np.uint8)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null takes no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents holding about ``max_bytes`` together."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """_STEP ** 0 .. n-1 modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.multiply.accumulate(np.full(n - 1, _STEP, np.uint64))
    return out


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Words of every document of a slice.

    ``table`` gives each byte a kind, 0 for separators; a word is a run of one
    kind. ``data``: bytes, ``offs``: document offsets into it (first 0). Returns
    (start, end, hash, doc): byte positions, a 64-bit hash of the word's bytes
    and the document's index, in text order. Words never cross documents.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return empty, empty, np.zeros(0, np.uint64), empty
    kind = table[data]
    inside = kind if kind.dtype == bool else kind > 0
    turn = kind[1:] != kind[:-1]
    start, stop = inside.copy(), inside.copy()      # first and last byte of a word
    start[1:] &= turn
    stop[:-1] &= turn
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = inside[cuts]
    stop[cuts - 1] = inside[cuts - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(stop) + 1
    if len(s) == 0:
        return s, e, np.zeros(0, np.uint64), empty
    length = e - s
    pw = powers(int(length.max()))
    at = np.flatnonzero(inside)
    word_of = np.repeat(np.arange(len(s)), length)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(at)) - first[word_of]
    part = _BYTE_KEY[data[at]] * pw[place]
    h = mix64(np.add.reduceat(part, first) + length.astype(np.uint64))
    doc = np.searchsorted(offs, s, side="right") - 1
    return s, e, h, doc


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Row offsets of each document in a doc-sorted index array."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
