"""Benchmark decontamination with a generalised suffix automaton.

The word sequences of all benchmark items go into one suffix automaton. The
words of a document are streamed through it; after each word the state stands
for the longest suffix of the document so far that occurs in some item, and its
length is the matching length. A window (``WINDOW`` consecutive item words, or
a whole shorter item) ends at a word when the matching length reaches it, so
the words it covers are hit; the items are those recorded at the window's
state (reached over suffix links).

Words outside the items' vocabulary reset the automaton, so only runs of
vocabulary words at least as long as the shortest window are streamed; the
rest is passed over by vectorised lookups.

The automaton is broadcast. Items are split by hash into blocks of at most
``BLOCK_BYTES`` of text (measured by a count before anything is collected);
with more than one block documents pass the blocks one after the other, each
pass adding its hits, written in between. A block is collected and built when
its pass begins and released after it. Cut documents pass all blocks again
until none hits, as windows can form where the parts meet.

Cases: items without an id are hit but not reported; null or empty texts and items have no words; repeated rows keep their
own result; ties between items all count; without items nothing is hit; extra
columns are not returned by :func:`contamination` but survive
:func:`decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .frames import written

WINDOW = 10
#: text of one automaton's items (a broadcast of some hundred bytes a word)
BLOCK_BYTES = 1 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        for _, seq in items:
            last = 0
            at = []
            for c in seq:
                last = self._extend(last, c)
                at.append(last)
            ends.append(at)
        #: windows recorded at their states: state -> {window length: items}
        self.windows: dict[int, dict[int, set[str]]] = {}
        for (item, seq), at in zip(items, ends, strict=True):
            size = min(window, len(seq))
            for state in at[size - 1:] if seq else []:
                while self.length[self.link[state]] >= size and state:
                    state = self.link[state]
                self.windows.setdefault(state, {}).setdefault(size, set()).update([] if item is None else [item])
        self.shortest = min((s for w in self.windows.values() for s in w), default=0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, window length, items) of every window occurrence, and through
        it the longest hit ending at each word."""
        nxt, link, length, windows = self.next, self.link, self.length, self.windows
        state, size = 0, 0
        for i, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(c, 0)
            size = size + 1 if state else 0
            at = state
            while at > 0 and length[at] >= self.shortest:
                for w, items in windows.get(at, {}).items():
                    if w <= size:
                        yield i + 1, w, items
                at = link[at]


class Items:
    """Vocabulary and automaton of a block of items; pickles as one object."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        seqs = []
        for item, text in items:
            data = tk.lower_ascii(np.frombuffer(text.encode(), np.uint8))
            seqs.append((item, tk.words(data, np.array([0, len(data)]), tk.ALNUM)[2]))
        self.vocab = np.unique(np.concatenate([h for _, h in seqs] or [np.zeros(0, np.uint64)]))
        self.seen = np.zeros(1 << 20, bool)      # one-bit prefilter of the vocabulary
        self.seen[self.vocab >> np.uint64(44)] = True
        self.automaton = SuffixAutomaton(
            [(i, np.searchsorted(self.vocab, h).tolist()) for i, h in seqs], window)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word hash, -1 for other words."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        if len(maybe):
            at = np.searchsorted(self.vocab, h[maybe])
            at[at == len(self.vocab)] = 0
            ok = self.vocab[at] == h[maybe]
            out[maybe[ok]] = at[ok]
        return out

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(first word, end word, items) of the occurrences in a slice."""
        least = self.automaton.shortest
        if not least or not len(ids):
            return []
        known = ids >= 0
        edge = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]), [True])))
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if known[a] and b - a >= least:
                out += [(a + end - w, a + end, items) for end, w, items in self.automaton.stream(ids[a:b].tolist())]
        return out


class Blocks:
    """The items in ``n`` blocks of a checked size; :meth:`build` makes the automaton of one."""

    def __init__(self, items: DataFrame, item_id: str, text: str, window: int, block_bytes: int = BLOCK_BYTES):
        self.window = window
        self.rows = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        total = self.rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.n = max(1, -(-total // block_bytes))

    def build(self, k: int) -> Items:
        own = self.rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == k)
        return Items([(r.i, r.t) for r in own.collect()], self.window)


def _scan(shared, final: bool, limit: float | None, alone: bool):
    """One pass: (id, text, hits so far) with this block's hits added.

    ``hits`` is a list of (first word, end word); ``items`` the item ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            data, offs = tk.text_buffer(b["text"])
            hits: list[list[list[int]]] = [list(x or []) for x in b["hits"].to_pylist()]
            found = [set(x or []) for x in b["items"].to_pylist()]
            n_words = np.zeros(b.num_rows, np.int64)
            cut: list[str | None] = [None] * b.num_rows
            for a, z in tk.slices(offs):
                own = offs[a:z + 1] - offs[a]
                s, e, h, doc = tk.words(tk.lower_ascii(data[offs[a]:offs[z]]), own, tk.ALNUM)
                first = tk.doc_bounds(doc, z - a)
                n_words[a:z] = np.diff(first)
                for i, j, items in block.hits(block.ids(h), doc):
                    d = int(doc[i])
                    hits[a + d].append([int(i - first[d]), int(j - first[d])])
                    found[a + d] |= items
                if final and limit is not None:
                    for d in range(z - a):
                        if hits[a + d]:
                            raw = data[offs[a + d]:offs[a + d + 1]]
                            w = slice(first[d], first[d + 1])
                            cut[a + d] = _without(raw, s[w] - own[d], e[w] - own[d], merged(hits[a + d]), block if alone else None)
            hits = [merged(x) for x in hits]
            out = {"id": b["id"], "n_words": pa.array(n_words), "hits": pa.array(hits, pa.list_(pa.list_(pa.int64()))),
                   "items": pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
            if not final or limit is not None:
                out["text"] = b["text"]
                if final:
                    new = [t if c is None else c for t, c in zip(b["text"].to_pylist(), cut, strict=True)]
                    out["text"] = pa.array(new, pa.string())
                for c in b.schema.names:
                    if c.startswith("keep_"):
                        out[c] = b[c]
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(list, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _without(raw: np.ndarray, s: np.ndarray, e: np.ndarray, spans: list[list[int]], block: Items | None) -> str:
    """The text without the spans, nor (given a block) windows that form where its parts meet."""
    while spans:
        keep = np.ones(len(raw), bool)
        for i, j in spans:
            keep[s[i]:e[j - 1]] = False
        raw = raw[keep]
        if block is None:
            break
        s, e, h, doc = tk.words(tk.lower_ascii(raw), np.array([0, len(raw)]), tk.ALNUM)
        spans = merged([[i, j] for i, j, _ in block.hits(block.ids(h), doc)])
    return raw.tobytes().decode()


_HITS = "id long, n_words long, hits array<array<bigint>>, items array<string>"


def _passes(docs: DataFrame, blocks: Blocks, schema_of_text: str, limit: float | None) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    for k in range(blocks.n):
        final = k == blocks.n - 1
        schema = _HITS + (schema_of_text if not final or limit is not None else "")
        shared = sc.broadcast(blocks.build(k))
        docs = docs.mapInArrow(_scan(shared, final, limit, blocks.n == 1), schema)
        if not final:
            docs = written(docs, "decontam")
            shared.destroy()
    return docs


def _start(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"),
                       F.lit(None).cast("array<array<bigint>>").alias("hits"),
                       F.lit(None).cast("array<string>").alias("items"),
                       *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): hit word spans and the items
    with occurring windows, one row a document."""
    blocks = Blocks(items, item_id, item_text, window, block_bytes)
    out = _passes(_start(docs, doc_id, text, []), blocks, ", text string", None)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "items", F.col("hits").alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of a contamination report."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the hit spans; documents with more than ``max_coverage``
    of their words hit go as a whole. Columns are those of ``docs``."""
    blocks = Blocks(items, item_id, item_text, window, block_bytes)
    keep = [c for c in docs.columns if c not in (text,)]
    types = dict(docs.dtypes)
    extra = ", text string, " + ", ".join(f"keep_{i} {types[c]}" for i, c in enumerate(keep))
    out = _passes(_start(docs, doc_id, text, keep), blocks, extra, max_coverage)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    out = out.where((n_hit == 0) | (n_hit <= F.lit(max_coverage) * F.col("n_words")))
    if blocks.n > 1:
        # cut documents pass again until no block hits
        out = written(out, "decontam")
        done = out.where(F.size("hits") == 0)
        cut = out.where(F.size("hits") > 0)
        while not cut.isEmpty():
            start = cut.withColumns({"hits": F.lit(None).cast("array<array<bigint>>"),
                                     "items": F.lit(None).cast("array<string>")})
            out = written(_passes(start, blocks, extra, max_coverage), "decontam")
            done = done.unionByName(out.where(F.size("hits") == 0))
            cut = out.where(F.size("hits") > 0)
        out = done
    back = {c: F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)} | {text: F.col("text").alias(text)}
    return out.select(*[back[c] for c in docs.columns])


def item_list_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
