"""Masked pseudo-likelihood of documents.

A small network sees the words around a position (``REACH`` on each side, the
word itself hidden) and predicts it; the log-probabilities of all positions of
a document, each given both sides, are summed up.

Words are 64-bit hashes. The prediction is factorised: the network gives one of
``CLASSES`` word classes, and a word within its class has its share of the
class in the whole corpus. The most frequent words have a class of their own;
the others share the rest by hash.

Texts are hashed once (:func:`hashed`); all passes read the written hashes.

From the corpus: (1) the exact count of every word, a table that grows with the
vocabulary and stays in Spark: chunks of documents send their distinct words,
the join gives each its count; only class totals and the words with a class of
their own go to the driver; (2) the network's weights: every task trains on every
position of all its documents, starting from the same weights, and Spark
averages the tasks' weights by the positions they saw, ``ROUNDS`` times. The number of input embeddings follows the square root of the
vocabulary, ``CLASSES`` is fixed. Sums are of whole numbers, independent of
their order.

Cases: null and empty texts have no words and log-probability 0 (mean null);
one-word documents are predicted from padding; unseen words count as seen once;
repeated rows keep their own result; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .frames import written

REACH = 2
LEAST_IN_BITS = 12
CLASSES = 128
OWN = 63
WIDTH = 16
HIDDEN = 32
ROUNDS = 2
BATCH = 512
CHUNK_BYTES = 8 << 20   # text of one chunk, about
SAFE_EXP = 80.0         # exp of numbers between it and its negative, summed over the classes, is a float32
_FIXED = 1 << 24        # weights are summed as multiples of 1 / _FIXED
_ONES = np.ones(max(BATCH, CLASSES, HIDDEN), np.float32)
_ROWS = np.arange(BATCH) * CLASSES
_CONTEXT = [i for i in range(-REACH, REACH + 1) if i]


@dataclass
class Hashed:
    """Documents as word hashes, written once for all passes over them
    (:func:`hashed`); ``rows``: one row a chunk."""
    rows: DataFrame


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    schema = pa.schema([("chunk", pa.int64()), *((k, pa.binary()) for k in ("words", "at", "ids", "has_id", "sizes", "cuts"))])
    for b in batches:
        data, offs = tk.text_buffer(b["text"])
        ids = b["id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        has = b["id"].is_valid().to_numpy(zero_copy_only=False)
        parts, first = [], 0
        for a, z in tk.slices(offs):
            _, _, h, doc = tk.words(tk.lower_ascii(data[offs[a]:offs[z]]), offs[a:z + 1] - offs[a], tk.NON_SPACE)
            parts.append((h.view(np.int64), np.bincount(doc, minlength=z - a), z - a))
            if z < len(ids) and offs[z] - offs[first] < CHUNK_BYTES:
                continue
            words, at = np.unique(np.concatenate([h for h, _, _ in parts]), return_inverse=True)
            yield pa.RecordBatch.from_pylist([{
                "chunk": chunk, "words": words.tobytes(), "at": pa.compress(at.astype(np.uint32).tobytes(), "zstd", asbytes=True),
                "ids": ids[first:z].tobytes(), "has_id": has[first:z].tobytes(),
                "sizes": np.concatenate([n for _, n, _ in parts]).astype(np.int64).tobytes(),
                "cuts": np.array([n for _, _, n in parts], np.int64).tobytes()}], schema=schema)
            parts, first, chunk = [], z, chunk + 1


def hashed(docs: DataFrame, doc_id: str | None = None, text: str = "text") -> Hashed:
    """Chunks of documents: their distinct word hashes in order, the place of
    every word among them, and the documents' ids and numbers of words."""
    key = F.lit(None) if doc_id is None else F.col(doc_id)
    return Hashed(written(docs.select(key.cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _hash_chunks, "chunk long, words binary, at binary, ids binary, has_id binary, sizes binary, cuts binary"),
        "lm-chunks", codec="none"))


class Chunk:
    """The documents of one row of :class:`Hashed`."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.cuts = np.frombuffer(row["cuts"], np.int64)
        n = 4 * int(self.sizes.sum())
        self.at = np.frombuffer(pa.decompress(row["at"], n, codec="zstd", asbytes=True) if n else b"", np.uint32)

    def slices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, end, places of the words, document) by slice."""
        ends, seen = np.cumsum(self.cuts), 0
        for a, z in zip(ends - self.cuts, ends, strict=True):
            doc = np.repeat(np.arange(z - a), self.sizes[a:z])
            yield a, z, self.at[seen:seen + len(doc)], doc
            seen += len(doc)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b[n][i].as_py() if n != "counts" else b[n][i].values for n in b.schema.names}


def word_counts(docs: Hashed) -> DataFrame:
    """(word, n): exact occurrences of every word hash in all documents, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            c = Chunk(row)
            yield pa.RecordBatch.from_arrays([pa.array(c.words), pa.array(np.bincount(c.at, minlength=len(c.words)))], ["word", "n"])
    return written(docs.rows.select("words", "at", "sizes", "cuts").mapInArrow(run, "word long, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


class WindowNet:
    """Word classes, their totals and the weights of the network."""

    def __init__(self, top: np.ndarray, total: np.ndarray, vocabulary: int, seed: int = 3):
        """``top``: words with a class of their own; ``total``: occurrences by
        class; ``vocabulary``: number of distinct words."""
        self.rank = np.argsort(top)
        self.top = top[self.rank]
        seen = np.maximum(total, 1).astype(np.float64)
        self.log_total = np.log(seen)
        self.in_bits = max(LEAST_IN_BITS, round(np.log2(max(vocabulary, 1)) / 2) + 2)
        rng = np.random.default_rng(seed)
        pad = 1 << self.in_bits
        self.params = {
            "emb": rng.normal(0, 0.3, (pad + 1, WIDTH)).astype(np.float32),
            "w1": rng.normal(0, 0.12, (len(_CONTEXT) * WIDTH, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.05, (HIDDEN, CLASSES)).astype(np.float32),
            "b2": np.log(seen / seen.sum()).astype(np.float32),
        }

    def __setstate__(self, state: dict) -> None:
        # an unpickled array's dtype equals float32 but is another object: numpy then leaves the fast path of ufunc.at
        self.__dict__.update(state, params={k: v.view(np.float32) for k, v in state["params"].items()})

    def inputs(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(words, context) input numbers; beyond the document's ends: padding."""
        return self.windows(self.numbers(h), doc)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The input number of each word."""
        return (h >> np.uint64(64 - self.in_bits)).astype(np.int32)

    def windows(self, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """:meth:`inputs` of words that have these numbers."""
        pad = 1 << self.in_bits
        out = np.full((len(number), len(_CONTEXT)), pad, np.int32)
        for k, gap in enumerate(_CONTEXT):
            n = abs(gap)
            if len(number) > n:
                own, other = (slice(None, -n), slice(n, None)) if gap > 0 else (slice(n, None), slice(None, -n))
                out[own, k] = np.where(doc[own] == doc[other], number[other], pad)
        return out

    def targets(self, h: np.ndarray) -> np.ndarray:
        """The class of each word (hash)."""
        word = h.view(np.int64)
        out = OWN + word % (CLASSES - OWN)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, word), len(self.top) - 1)
            out = np.where(self.top[at] == word, self.rank[at], out)
        return out

    def _logits(self, e: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(h, z): the hidden layer and the classes' z, in ``out``. |h| is at most
        1, so the weights bound z; only where exp could leave float32 z is shifted."""
        p = self.params
        h = e @ p["w1"]
        h += p["b1"]
        np.tanh(h, out=h)
        z = np.matmul(h, p["w2"], out=out[:len(h)])
        z += p["b2"]
        if not np.sqrt(HIDDEN * (_ONES[:HIDDEN] @ (p["w2"] * p["w2"])).max()) + np.abs(p["b2"]).max() < SAFE_EXP:
            z -= z.max(1, keepdims=True)
        return h, z

    def log_prob(self, x: np.ndarray, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``cls``: the words' classes, ``n``: their occurrences in the corpus."""
        x = x.astype(np.intp)
        out = np.empty(len(x), np.float32)
        e, z = (np.empty((BATCH, k), np.float32) for k in (len(_CONTEXT) * WIDTH, CLASSES))
        for at in range(0, len(x), BATCH):
            xb, y = x[at:at + BATCH], cls[at:at + BATCH]
            np.take(self.params["emb"], xb, axis=0, out=e.reshape(BATCH, -1, WIDTH)[:len(xb)], mode="clip")
            _, zb = self._logits(e[:len(xb)], z)
            own = zb.reshape(-1)[_ROWS[:len(xb)] + y]
            out[at:at + BATCH] = own - np.log(np.exp(zb, out=zb) @ _ONES[:CLASSES])
        return out + np.log(n) - self.log_total[cls]

    def train(self, x: np.ndarray, cls: np.ndarray, rate: float) -> None:
        """Steps of ``BATCH`` positions; ``x``: :meth:`inputs` of whole documents.

        A word is an input of all positions around it, so what its embedding
        gets is summed by its own position first: one row a word to add, not one an input."""
        p, pad, halo = self.params, 1 << self.in_bits, 2 * REACH
        x = x.astype(np.intp)
        lost = np.flatnonzero(x == pad)
        lost_from = np.searchsorted(lost, np.arange(0, len(x) + BATCH, BATCH) * len(_CONTEXT))
        number = np.full(len(x) + halo, pad, np.intp)       # of the words that are inputs, in their places
        for k, gap in enumerate(_CONTEXT):
            np.copyto(number[REACH + gap:REACH + gap + len(x)], x[:, k], where=x[:, k] != pad)
        cells = number[:, None] * WIDTH + np.arange(WIDTH)
        around, z = (np.empty((BATCH, k), np.float32) for k in (len(_CONTEXT) * WIDTH, CLASSES))
        emb, step = p["emb"].reshape(-1), np.float32(rate / BATCH)
        for batch, at in enumerate(range(0, len(x), BATCH)):
            xb, y = x[at:at + BATCH], cls[at:at + BATCH]
            n = len(xb)
            e = around[:n]
            np.take(p["emb"], xb, axis=0, out=e.reshape(n, -1, WIDTH), mode="clip")
            h, d = self._logits(e, z)
            np.exp(d, out=d)
            total = d @ _ONES[:CLASSES]
            d.reshape(-1)[_ROWS[:n] + y] -= total       # times ``part``: the gradient
            part = (1 / total)[:, None]
            dh = d @ p["w2"].T
            dh *= part
            dh *= 1 - h * h
            de = dh @ np.ascontiguousarray(p["w1"].reshape(len(_CONTEXT), WIDTH, HIDDEN).transpose(0, 2, 1))
            de *= step * 20
            h *= part
            p["w2"] -= step * (h.T @ d)
            p["b2"] -= step * (part[:, 0] @ d)
            p["w1"] -= step * (e.T @ dh)
            p["b1"] -= step * (_ONES[:n] @ dh)
            place, k = np.divmod(lost[lost_from[batch]:lost_from[batch + 1]] - at * len(_CONTEXT), len(_CONTEXT))
            p["emb"][pad] -= de[k, place].sum(0)
            de[k, place] = 0
            g = np.zeros((n + halo, WIDTH), np.float32)
            for k, gap in enumerate(_CONTEXT):
                g[REACH + gap:REACH + gap + n] += de[k]
            np.subtract.at(emb, cells[at:at + n + halo].ravel(), g.ravel())


def _trained(docs: Hashed, net: WindowNet, rate: float) -> None:
    """One round: each part of the documents trains its own weights; they are averaged."""
    shared = docs.rows.sparkSession.sparkContext.broadcast(net)
    names = list(net.params)

    def fresh() -> WindowNet:
        own = copy.copy(shared.value)       # a reused worker keeps the broadcast object as it is
        own.params = {k: v.copy() for k, v in own.params.items()}
        return own

    def weights(own: WindowNet, seen: int) -> pa.RecordBatch:
        flat = np.concatenate([own.params[k].ravel() for k in names]).astype(np.float64)
        value = np.round(flat * _FIXED).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(value), pa.array(np.full(len(flat), seen))],
                                          ["i", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = fresh(), None, 0
        for row in _chunk_rows(batches):
            if part != row["chunk"] >> 32:      # a part of the documents trains by itself, however its chunks are read
                if seen:
                    yield weights(own, seen)
                own, part, seen = fresh(), row["chunk"] >> 32, 0
            c = Chunk(row)
            number, cls = own.numbers(c.words.view(np.uint64)), own.targets(c.words)
            for _, _, at, doc in c.slices():
                own.train(own.windows(number[at], doc), cls[at], rate)
                seen += len(at)
        if seen:
            yield weights(own, seen)
    weight = F.col("n").cast("decimal(18,0)")
    rows = (docs.rows.select("chunk", "words", "at", "sizes", "cuts").mapInArrow(run, "i long, v long, n long")
            .groupBy("i").agg(F.sum(F.col("v").cast("decimal(18,0)") * weight).alias("v"), F.sum(weight).alias("n"))
            .select("i", (F.col("v").cast("double") / F.col("n").cast("double") / _FIXED).alias("v")).toArrow())
    if rows.num_rows:
        flat = np.zeros(rows.num_rows)
        flat[rows["i"].to_numpy()] = rows["v"].to_numpy()
        at = 0
        for k in names:
            n = net.params[k].size
            net.params[k] = flat[at:at + n].reshape(net.params[k].shape).astype(np.float32)
            at += n


class Model:
    """The network and the table of exact word counts, which stays in Spark."""

    def __init__(self, net: WindowNet, words: DataFrame):
        self.net, self.words = net, words


def fit(docs: DataFrame | Hashed, text: str = "text", rounds: int = ROUNDS) -> Model:
    docs = docs if isinstance(docs, Hashed) else hashed(docs, text=text)
    words = word_counts(docs)
    top = [(r.word, r.n) for r in words.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    total = np.zeros(CLASSES, np.int64)
    vocabulary = 0
    for r in (words.groupBy(F.pmod("word", F.lit(CLASSES - OWN)).alias("cls"))
              .agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()):
        total[OWN + r.cls] = r.n
        vocabulary += r.words
    for k, (word, n) in enumerate(top):
        total[k] = n
        total[OWN + word % (CLASSES - OWN)] -= n
    net = WindowNet(np.array([w for w, _ in top], np.int64), total, vocabulary)
    for k in range(rounds):
        _trained(docs, net, 0.5 / (k + 1))
    return Model(net, words)


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _chunk_rows(batches):
        word = np.frombuffer(row["words"], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), row["chunk"])), pa.array(word)], ["chunk", "word"])


def score(docs: DataFrame | Hashed, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob), one row a document."""
    chunks = (docs if isinstance(docs, Hashed) else hashed(docs, doc_id, text)).rows
    shared = chunks.sparkSession.sparkContext.broadcast(model.net)
    counts = (chunks.select("chunk", "words").mapInArrow(_chunk_words, "chunk long, word long").join(model.words, "word", "left")
              .groupBy("chunk").agg(F.collect_list(F.struct("word", F.coalesce("n", F.lit(1)).alias("n"))).alias("counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for row in _chunk_rows(batches):
            c = Chunk(row)
            count = np.zeros(0, np.int64)
            if row["counts"] is not None:
                word, count = (row["counts"].field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                count = count[np.argsort(word)]         # as the chunk's words
            number, cls = net.numbers(c.words.view(np.uint64)), net.targets(c.words)
            ids, has_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["has_id"], bool)
            for a, z, at, doc in c.slices():
                lp = net.log_prob(net.windows(number[at], doc), cls[at], count[at]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:z], pa.int64(), mask=~has_id[a:z]), pa.array(c.sizes[a:z]),
                     pa.array(np.bincount(doc, lp, z - a))], ["doc_id", "n_words", "log_prob"])
    return (chunks.join(counts.hint("shuffle_hash"), "chunk", "left")
            .mapInArrow(run, "doc_id long, n_words long, log_prob double")
            .withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))))
