"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces longer
than C/(j+1) and at most C/j, and every bin of class j takes exactly j pieces,
so a bin is chosen by the length alone and each worker packs its own documents
without a shuffle. A document is cut so that its pieces meet class limits
exactly: whole sequences first, then the largest C//j that still fits, again
and again, until at most ``TAIL`` tokens are left; that tail goes to its own
class as it is. Bins of exact pieces are full (up to C mod j tokens); a bin of
tails of class j leaves at most C/(j+1), so under ``TAIL`` tokens. What is
left in the open bins of a worker (at most one bin a class) is laid end to
end, cut at C, and its last part at powers of two, where sequences need no
padding.

Cases: a null or empty text is the closing id alone; repeated rows are packed
each on their own; very long texts become many whole sequences; an empty table
gives no sequences; extra columns are ignored. A worker holds its open bins
only: at most C tokens for each of some 160 classes.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import give_back

CAPACITY = 4096
TAIL = 128
CLOSING_ID = 2
#: a tokenizer's memos of chunks and of pieces are emptied at this many entries each (about
#: 130 bytes an entry), and when a task ends
MEMO = 300_000

# The pattern by which the tokenizer file splits lower-cased text (fixed value of that file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Memo(dict):
    """Results of a function by its argument."""

    def __init__(self, fn: Callable[[str], bytes]):
        super().__init__()
        self.fn = fn

    def __missing__(self, key: str) -> bytes:
        out = self[key] = self.fn(key)
        return out


class WordTokenizer:
    """Token ids of a text by a public word-BPE file, remembered by chunk.

    The file's pre-tokenizer never joins characters across a space, tab or
    line end, so the ids of a text are those of its chunks, one after the
    other. A chunk of Latin-1 characters is split into pieces by the file's
    own pattern and each new piece goes to the tokenizer's model; any other
    chunk, and those that hold a special token, go through ``encode``."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.split = regex.compile(SPLIT)
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        """Empty the memos."""
        self.chunks = Memo(self._chunk)
        self.pieces = Memo(self._piece)

    @staticmethod
    def _bytes(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, p: str) -> bytes:
        text = p if p.isascii() else self.level.pre_tokenize_str(p)[0][0]
        return self._bytes([t.id for t in self.tok.model.tokenize(text)])

    def _chunk(self, c: str) -> bytes:
        if not c:
            return b""
        pieces = self.pieces
        simple = c.isascii() or (max(c) < "Ā" and unicodedata.is_normalized("NFC", c))
        if simple and c.isprintable() and "<|" not in c:
            low = c.lower()
            if low.isalpha():
                return pieces[low]
            if c.isascii() and low[:-1].isalpha() and low[-1] in ".,;:!?":
                return pieces[low[:-1]] + pieces[low[-1]]
            return b"".join([pieces[p] for p in self.split.findall(low)])
        return self._bytes(self.tok.encode(c, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.chunks) > MEMO:
            self.chunks = Memo(self._chunk)
        if len(self.pieces) > MEMO:
            self.pieces = Memo(self._piece)
        return b"".join(map(self.chunks.__getitem__, parts))


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file (read once in each Python worker)."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def cut_lengths(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left > tail:
        j = -(-capacity // left)
        while capacity // j > left:
            j += 1
        out.append((capacity // j, j))
        left -= capacity // j
    if left:
        # tails keep apart from exact pieces of the same class
        out.append((left, -(capacity // left)))
    return out


Piece = tuple  # (doc_id, start, ids bytes, doc_tokens)


class Packer:
    """Open bins of one worker."""

    def __init__(self, worker: int, capacity: int):
        self.open: dict[int, list[Piece]] = defaultdict(list)
        self.next_id = worker << 33
        self.capacity = capacity
        self.rows: list[tuple] = []

    def _close(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes, tail: int) -> None:
        total, at = len(ids) // 4, 0
        for n, j in cut_lengths(total, self.capacity, tail):
            bin_ = self.open[j]
            bin_.append((doc, at, ids[4 * at:4 * (at + n)], total))
            at += n
            if len(bin_) == abs(j):
                self._close(bin_)
                del self.open[j]

    def finish(self) -> None:
        """Lay the open bins end to end; no padding."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        left = sum(len(p[2]) // 4 for p in rest)
        self.open.clear()
        bin_, room = [], self._size(left)
        for doc, start, ids, total in rest:
            while ids:
                part, ids = ids[:4 * room], ids[4 * room:]
                n = len(part) // 4
                bin_.append((doc, start, part, total))
                start, room, left = start + n, room - n, left - n
                if not room:
                    self._close(bin_)
                    bin_, room = [], self._size(left)

    def _size(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << left.bit_length() - 1 if left else 0


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def packed(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, tail: int = TAIL, closing_id: int = CLOSING_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one
    row a piece."""
    end = closing_id.to_bytes(4, "little")

    def emit(p: Packer) -> Iterator[pa.RecordBatch]:
        if p.rows:
            cols = list(zip(*p.rows, strict=True))
            p.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)],
                                             schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, p = tokenizer(tokenizer_path), Packer(TaskContext.get().partitionId(), capacity)
        try:
            for b in batches:
                for doc, t in zip(b["__id"].to_pylist(), b["__text"], strict=True):
                    p.add(doc, tok.ids(t.as_py() or "") + end, tail)
                    if len(p.rows) >= 20_000:
                        yield from emit(p)
            p.finish()
            yield from emit(p)
        finally:
            tok.forget()
            give_back()

    return (docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
            .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                             "sequence_id long, offset long"))
