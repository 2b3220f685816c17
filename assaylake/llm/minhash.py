"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

A document's set is its distinct word shingles (64-bit hashes). Circulant
MinHash needs two permutations only: the first scatters the shingles over
``UNIVERSE`` places (a bijection of the 64-bit hash, of which the leading bits
count); the second, shifted circularly by k places, gives coordinate k: the
smallest permuted value in the set. All coordinates of a shingle lie side by
side in the second permutation's table, so a signature is the minimum over one
window of the table for each shingle.

1. Equal sets are one class; the work goes on with one set a class.
2. ``BANDS`` bands of ``ROWS`` coordinates put classes into buckets. Two sets
   with Jaccard 0.8 miss each other in all of them with probability 3e-6.
3. In every bucket each class is compared with the bucket's smallest class;
   links are confirmed on the full sets, and components are formed.
4. Buckets that still hold several components are compared pair by pair across
   components, inside blocks of at most ``BLOCK`` classes, on longer signatures
   (``LONG`` coordinates; pairs under ``LEAST`` agreement, five standard
   deviations below 0.8, go) and then on the full sets; only links leave the
   block. So no link is lost to the shortcut of step 3, pairs within a component are never formed,
   and a pair is handled in the first bucket it shares only.

Cases: documents without words (null, empty, white space) have no shingle and
no link; rows without an id take no part (component null); rows that share an
id are the same document (smallest component of its texts); long texts are
read whole; ties go to smaller ids; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as tk
from .components import components
from .frames import drop_written, giving_back, written

UNIVERSE_BITS = 20
BANDS = 32
ROWS = 5
LONG = 1024
LEAST = 0.74
#: classes of one bucket that are compared in one block
BLOCK = 1024

_TABLES: dict[int, np.ndarray] = {}


def _windows(k: int) -> np.ndarray:
    """(UNIVERSE, k): the second permutation's values under k circular shifts."""
    if k not in _TABLES:
        pi = np.random.default_rng(41).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        _TABLES[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate((pi[1 - k:], pi)), k)
    return _TABLES[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of a non-empty set of 64-bit shingle hashes."""
    place = (tk.mix64(shingles) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    table, step = _windows(k), max(1, (1 << 20) // k)
    out = table[place[:step]].min(0)
    for at in range(step, len(place), step):
        out = np.minimum(out, table[place[at:at + step]].min(0))
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a slice."""
    _, _, h, doc = tk.words(tk.lower_ascii(data), offs, tk.NON_SPACE)
    edge = tk.doc_bounds(doc, len(offs) - 1)
    mult = np.uint64(0xD6E8FEB86659FD93)
    roll = h.copy()
    for _ in range(n_words - 1):
        roll = roll[:-1] * mult + h[len(h) - len(roll) + 1:] if len(roll) else roll
    roll = tk.mix64(roll + np.uint64(n_words))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= n_words:
            out.append(np.unique(roll[a:b - n_words + 1]))
        elif b > a:
            whole = h[a]
            for x in h[a + 1:b]:
                whole = whole * mult + x
            out.append(tk.mix64(np.array([whole + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int((tk.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = (rows * tk.powers(ROWS)).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return tk.mix64(key).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n_words: int):
    for b in batches:
        data, offs = tk.text_buffer(b["text"])
        for a, z in tk.slices(offs):
            with np.errstate(over="ignore"):
                yield b.slice(a, z - a), shingle_sets(data[offs[a]:offs[z]], offs[a:z + 1] - offs[a], n_words)


def signatures(docs: DataFrame, n_words: int) -> DataFrame:
    """(id, n, cls, bands): set size, class and bucket keys of every document;
    class and keys are null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, n_words):
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([_bands(signature(s, BANDS * ROWS)) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["id", "n", "cls", "bands"])
    return docs.mapInArrow(giving_back(run), "id long, n long, cls long, bands array<bigint>")


def _payload(docs: DataFrame, n_words: int) -> DataFrame:
    """(cls, shingles, long, keys): full sets and long signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, n_words):
            sigs = [signature(s, LONG).astype(np.uint8).tobytes() if len(s) else b"" for s in sets]
            keys = [_bands(signature(s, BANDS * ROWS)).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["cls"], pa.array([_class_of(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())],
                ["cls", "own", "shingles", "long", "keys"])
    return (docs.mapInArrow(giving_back(run), "cls long, own long, shingles binary, long binary, keys binary")
            .where("cls = own").drop("own"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((x, y))
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _confirmed(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                  for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    left = near.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = near.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(giving_back(run), "a long, b long")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of one block: classes in different components that share no
    earlier bucket, agree in at least LEAST of the long signatures and are
    similar enough on their full sets. Pairs never leave the block."""
    def block(key: int, cls, label, long, keys, shingles) -> tuple[list, list]:
        label = np.asarray(label)
        if (label == label[0]).all():
            return [], []
        cls = np.asarray(cls)
        sig = np.frombuffer(b"".join(long), np.uint8).reshape(len(cls), LONG)
        own = np.frombuffer(b"".join(keys), np.int64).reshape(len(cls), BANDS)
        band = int(np.flatnonzero(own[0] == key)[0])
        a, b = [], []
        for i in range(len(cls) - 1):
            j = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
            # a quarter of the coordinates first: at least 0.55 agreement is seven deviations below
            j = j[(sig[j, :LONG // 4] == sig[i, :LONG // 4]).mean(1) >= 0.55]
            j = j[(sig[j] == sig[i]).mean(1) >= LEAST]
            j = j[~(own[j, :band] == own[i, :band]).any(1)]
            mine = np.frombuffer(shingles[i], np.uint64)
            j = [k for k in j if linked(mine, np.frombuffer(shingles[k], np.uint64), percent)]
            a += [min(cls[i], cls[k]) for k in j]
            b += [max(cls[i], cls[k]) for k in j]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            a, b = [], []
            c = {n: t[n].to_pylist() for n in t.column_names}
            group = list(zip(c["key"], c["i"], c["j"], strict=True))
            start = [k for k in range(len(group)) if not k or group[k] != group[k - 1]] + [len(group)]
            for s, e in zip(start[:-1], start[1:], strict=True):
                if e - s > 1:
                    x, y = block(c["key"][s], *(c[n][s:e] for n in ("cls", "label", "long", "keys", "shingles")))
                    a += x
                    b += y
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            group = list(zip(*(b[n].to_pylist() for n in ("key", "i", "j")), strict=True))
            if last is not None and group[0] == last and group[-1] == last:
                held.append(b)
                continue
            # all rows of the batch's last group may not be here yet
            cut = group.index(group[-1])
            yield flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held, last = [b.slice(cut)], group[-1]
        if held:
            yield flush(pa.Table.from_batches(held))
    return rows.mapInArrow(giving_back(run), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sig = written(signatures(docs, n_words), "minhash-signatures", small_batches=True)
    full = sig.where(F.col("cls").isNotNull() & F.col("id").isNotNull())

    # buckets with more than one class
    one = full.groupBy("cls").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    rows = one.select("cls", "rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("centre")).where("m > 1")
    hits = written(rows.join(shared, "key"), "minhash-buckets")

    near = hits.groupBy("cls").agg(F.min("rep").alias("id"))
    near = written(_payload(docs.join(near.hint("shuffle_hash"), "id").select("cls", "text"), n_words)
                   .dropDuplicates(["cls"]), "minhash-sets", small_batches=True)

    stars = hits.where("cls > centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    links = written(_confirmed(stars, near, percent), "minhash-links", small_batches=True)
    label = components(links)

    # the same buckets, where components are left
    named = hits.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").select(
        "key", "m", "cls", F.coalesce("label", "cls").alias("label"))
    open_ = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
    n_blocks = F.ceil(F.col("m") / BLOCK)
    own = F.pmod(F.xxhash64("cls"), n_blocks)
    blocks = (named.join(open_, "key")
              .select("key", "cls", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("other"))
              .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "label")
              .join(near, "cls")
              .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls"))
    more = written(_across(blocks, percent), "minhash-more", small_batches=True)
    if not more.isEmpty():
        label = components(label.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
                           .unionByName(more))

    class_id = full.groupBy("cls").agg(F.min("id").alias("rep"))
    class_label = class_id.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left")
    lowest = class_label.where("label is not null").groupBy("label").agg(F.min("rep").alias("lowest"))
    final = written(class_label.join(lowest, "label", "left")
                    .select("cls", F.coalesce("lowest", "rep").alias("component_id")), "minhash-classes")
    drop_written(hits, near, links, more)
    out = sig.select("id", "n", "cls").join(final, "cls", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the
    smallest id. Rows without an id stay."""
    found = near_duplicates(docs, n_words, percent, doc_id, text)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")
