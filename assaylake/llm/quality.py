"""Quality scores from random-indexing word vectors and a two-layer network.

Tokens are runs of letters, digits or marks (case kept), hashed into ``VOCAB``
buckets. Every bucket has a sparse random index vector; the word vector of a
bucket is the sum, over all its occurrences in all documents, of the index
vectors of its neighbours up to ``REACH`` tokens away. Each task adds up its
documents and sends one row a bucket; Spark sums the rows (whole numbers, so
the order does not matter). A document is pooled as the frequency-weighted mean
and spread of its tokens' vectors, and a two-layer numpy network with a
temperature fitted on held-back training rows turns that into a probability.

The table of word vectors has ``VOCAB`` x ``DIMS`` numbers whatever the corpus,
so it may be broadcast. Training reads about ``TRAIN_ROWS`` labelled
documents (id hashes under a bound): a documented bound for fitting only.

Cases: null and empty texts are pooled to zeros and scored; labels that are
null or contradict each other are not learned from; with one label only (or
none) every score is that label's share (0.5 without labels); repeated rows
keep their own result; texts of any length are pooled whole; equal scores are
not ordered; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .nets import Adam

VOCAB_BITS = 14
VOCAB = 1 << VOCAB_BITS
DIMS = 32
NONZERO = 2
REACH = 2
TRAIN_ROWS = 12_000

_RNG = np.random.default_rng(77)
_PLACE = np.stack([_RNG.permutation(DIMS)[:NONZERO] for _ in range(VOCAB)])
_SIGN = _RNG.choice([-1.0, 1.0], (VOCAB, NONZERO))


def _buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, doc = tk.words(data, offs, tk.KINDS)
    return (h >> np.uint64(64 - VOCAB_BITS)).astype(np.int64), doc


def _add_contexts(total: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> None:
    for gap in range(1, REACH + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = bucket[:-gap][same], bucket[gap:][same]
        for own, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(own * DIMS + _PLACE[other, k], _SIGN[other, k], VOCAB * DIMS)


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(VOCAB x DIMS unit vectors, VOCAB weights) from all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(VOCAB * DIMS), np.zeros(VOCAB, np.int64)
        for b in batches:
            data, offs = tk.text_buffer(b["text"])
            for a, z in tk.slices(offs):
                bucket, doc = _buckets(data[offs[a]:offs[z]], offs[a:z + 1] - offs[a])
                _add_contexts(total, bucket, doc)
                count += np.bincount(bucket, minlength=VOCAB)
        used = np.flatnonzero(count)
        m = total.reshape(VOCAB, DIMS)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(c) for c in m.T]],
                                         ["bucket", "n", *[f"x{i}" for i in range(DIMS)]])

    names = [f"x{i}" for i in range(DIMS)]
    rows = (docs.select(F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "bucket long, n long, " + ", ".join(f"{c} long" for c in names))
            .groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow())
    vec, count = np.zeros((VOCAB, DIMS), np.float32), np.zeros(VOCAB)
    if rows.num_rows:
        at = rows["bucket"].to_numpy()
        count[at] = rows["n"].to_numpy()
        vec[at] = np.stack([rows[c].to_numpy() for c in names], 1)
        vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
    share = count / max(count.sum(), 1)
    return vec, (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, vec: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(documents, 2 * DIMS): weighted mean and spread of the token vectors."""
    bucket, doc = _buckets(data, offs)
    n = len(offs) - 1
    out = np.zeros((n, 2 * DIMS), np.float32)
    if not len(bucket):
        return out
    edge = tk.doc_bounds(doc, n)
    full = np.flatnonzero(edge[1:] > edge[:-1])
    w = weight[bucket]
    v = vec[bucket]
    mass = np.add.reduceat(w, edge[full])[:, None]
    mean = np.add.reduceat(v * w[:, None], edge[full]) / mass
    square = np.add.reduceat(v * v * w[:, None], edge[full]) / mass
    out[full, :DIMS], out[full, DIMS:] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Scorer:
    vec: np.ndarray
    weight: np.ndarray
    params: dict[str, np.ndarray] | None
    temperature: float = 1.0
    constant: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        h = np.tanh(((x - p["mean"]) / p["std"]) @ p["w1"] + p["b1"])
        return (h @ p["w2"] + p["b2"])[:, 0]

    def prob(self, x: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, vec: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60,
          seed: int = 9) -> Scorer:
    """Fit the network on four fifths of the rows, the temperature on the rest."""
    if len(y) == 0 or y.min() == y.max():
        return Scorer(vec, weight, None, constant=float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[:len(y) // 5], order[len(y) // 5:]
    p = {"w1": rng.normal(0, 0.15, (x.shape[1], hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32),
         "w2": rng.normal(0, 0.15, (hidden, 1)).astype(np.float32), "b2": np.zeros(1, np.float32)}
    stats = {"mean": x[fit].mean(0), "std": x[fit].std(0) + 1e-4}
    opt = Adam(p, 0.004)
    model = Scorer(vec, weight, p | stats)
    xs = (x - stats["mean"]) / stats["std"]
    for _ in range(epochs):
        for at in range(0, len(fit), 128):
            pick = rng.choice(fit, min(128, len(fit)))
            h = np.tanh(xs[pick] @ p["w1"] + p["b1"])
            z = (h @ p["w2"] + p["b2"])[:, 0]
            d = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[pick]) / len(pick)).astype(np.float32)[:, None]
            dh = (d @ p["w2"].T) * (1 - h * h)
            opt.step({"w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(0), "w1": xs[pick].T @ dh + 1e-4 * p["w1"],
                      "b1": dh.sum(0)})
    if len(held) and y[held].min() != y[held].max():
        z, grid = model.logit(x[held]), np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _features(docs: DataFrame, keep: str, keep_type: str, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, weight = shared.value
        for b in batches:
            data, offs = tk.text_buffer(b["text"])
            x = [pooled(data[offs[a]:offs[z]], offs[a:z + 1] - offs[a], vec, weight) for a, z in tk.slices(offs)]
            x = np.concatenate(x) if x else np.zeros((0, 2 * DIMS), np.float32)
            yield pa.RecordBatch.from_arrays([b["id"], b[keep], pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["id", keep, "x"])
    return docs.mapInArrow(run, f"id long, {keep} {keep_type}, x binary")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", train_rows: int = TRAIN_ROWS) -> Scorer:
    """Learn word vectors from all documents, and the network from the labels
    of the ids where ``allowed`` (a condition on ``doc_id``) holds."""
    vec, weight = word_vectors(docs, text)
    known = (labels.where(allowed & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).cast("long").alias("id"))
             .agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").drop("y2"))
    # about train_rows ids, by a bound on their hash: no sort, no task that sees them all
    share = min(1.0, train_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # about train_rows ids: a bounded broadcast
    rows = rows.join(F.broadcast(known), "id").select("id", F.col("y").cast("int").alias("y"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((vec, weight))
    got = _features(rows, "y", "int", shared).orderBy("id", "x").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, 2 * DIMS)
    return train(x, got["y"].to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64), vec, weight)


def score(docs: DataFrame, model: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offs = tk.text_buffer(b["text"])
            prob = [m.prob(pooled(data[offs[a]:offs[z]], offs[a:z + 1] - offs[a], m.vec, m.weight))
                    for a, z in tk.slices(offs)]
            prob = np.concatenate(prob).astype(np.float64) if prob else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(prob)], ["doc_id", "score"])
    return (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))
