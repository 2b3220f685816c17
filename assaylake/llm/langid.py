"""Language identification with a byte convolutional network.

A text's UTF-8 bytes (A-Z lower-cased) are cut into consecutive windows of
``WINDOW`` bytes, the last one padded, so every byte of the text is read. Each
window passes one-hot byte convolutions of the widths ``WIDTHS``, a maximum
over its positions, and a linear layer; the mean of the windows' outputs goes
through softmax. The network is trained in numpy on labelled windows.

Training reads at most ``PER_LANG`` documents of each language (those with the
smallest hashes of their ids) and two windows of each: a documented bound for
fitting only. Prediction reads the text alone.

Cases: a null text or one without a letter is ``und`` with score 0, as is every
text when no labelled document exists; documents with null language are
predicted but not learned from; repeated rows keep their own result, and rows
that share id and language are learned from once (the smallest text); a null id
counts as not held out; of equally likely languages the first in order is
predicted; an empty table gives no rows; more than ``MAX_LANGS`` languages to learn
raise an error, since every one of them needs its training rows on the driver;
extra columns are kept by :func:`predict`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as tk
from .frames import give_back
from .nets import Adam, softmax

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANG = 800
MAX_LANGS = 200
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Tables ``taps[w][j]`` (256 x filters): what byte values at tap j of the
    width-w filters add; ``bias`` and the linear layer ``out``."""

    langs: list[str]
    params: dict[str, np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages) of uint8 windows, by byte-pair tables."""
        if not hasattr(self, "_pairs"):
            p = self.params
            # a filter's first two (and next two) taps as one table over byte pairs
            pair = lambda a, b: (p[a][:, None, :] + p[b][None, :, :]).reshape(65536, -1)
            self._pairs = {w: [pair(f"w{w}_{j}", f"w{w}_{j + 1}") for j in range(0, w - 1, 2)] for w in WIDTHS}
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 64):
            part = x[at:at + 64].astype(np.uint16)
            two = (part[:, :-1] << np.uint16(8)) | part[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                s = self._pairs[w][0][two[:, :n]]
                for i, table in enumerate(self._pairs[w][1:], 1):
                    s += table[two[:, 2 * i:2 * i + n]]
                if w % 2:
                    s += self.params[f"w{w}_{w - 1}"][part[:, w - 1:w - 1 + n]]
                pooled.append(s.max(1))
            h = np.maximum(np.concatenate(pooled, 1) + self.params["bias"], 0)
            out[at:at + 64] = h @ self.params["out"] + self.params["out_bias"]
        return out


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 8, seed: int = 5) -> ByteNet:
    """Fit on uint8 windows ``x`` and class numbers ``y``."""
    rng = np.random.default_rng(seed)
    p = {f"w{w}_{j}": rng.normal(0, 0.1, (256, FILTERS)).astype(np.float32) for w in WIDTHS for j in range(w)}
    h = FILTERS * len(WIDTHS)
    p |= {"bias": np.zeros(h, np.float32), "out": rng.normal(0, 0.2, (h, len(langs))).astype(np.float32),
          "out_bias": np.zeros(len(langs), np.float32)}
    opt = Adam(p, 0.004)
    rows = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            pick = order[at:at + 64]
            xb = x[pick]
            pooled, where = [], {}
            for w in WIDTHS:
                n = WINDOW - w + 1
                s = p[f"w{w}_0"][xb[:, :n]]
                for j in range(1, w):
                    s = s + p[f"w{w}_{j}"][xb[:, j:j + n]]
                where[w] = s.argmax(1)
                pooled.append(np.take_along_axis(s, where[w][:, None, :], 1)[:, 0])
            z = np.concatenate(pooled, 1) + p["bias"]
            act = np.maximum(z, 0)
            d = softmax(act @ p["out"] + p["out_bias"])
            d[np.arange(len(pick)), y[pick]] -= 1
            d /= len(pick)
            dz = (d @ p["out"].T) * (z > 0)
            g = {"out": act.T @ d, "out_bias": d.sum(0), "bias": dz.sum(0)}
            for i, w in enumerate(WIDTHS):
                own = dz[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(xb, where[w] + j, 1).astype(np.int64)
                    flat = np.bincount((byte * FILTERS + rows).ravel(), own.ravel(), 256 * FILTERS)
                    g[f"w{w}_{j}"] = flat.reshape(256, FILTERS).astype(np.float32)
            opt.step(g)
    return ByteNet(langs, p)


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes in each, document of each) of a slice's documents."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    first = np.concatenate(([0], np.cumsum(n)))
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    doc_of = np.repeat(np.arange(len(size)), size)
    flat[np.arange(offs[-1]) - offs[:-1][doc_of] + first[:-1][doc_of] * WINDOW] = tk.lower_ascii(data)
    doc = np.repeat(np.arange(len(n)), n)
    used = np.minimum(WINDOW, size[doc] - (np.arange(len(doc)) - first[doc]) * WINDOW)
    return flat.reshape(-1, WINDOW), used, doc


def _labelled(docs: DataFrame, doc_id: str, text: str, lang: str, allowed: Column, per_lang: int) -> DataFrame:
    """(lang, text) of the training documents: the smallest id hashes of each
    language. Counts of ids give a hash under which about twice as many lie, so
    that the exact choice meets that many rows at every size of the input."""
    key = F.xxhash64(F.col(doc_id))
    rows = (docs.where(allowed & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
            .select(F.col(lang).cast("string").alias("lang"), key.alias("__key"), F.col(text).cast("string").alias("text")))
    ids = (rows.groupBy("lang").agg(F.approx_count_distinct("__key").alias("n"))
           .orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(ids) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not ids:
        return rows.select("lang", "text").limit(0)
    bound = {r["lang"]: (1 << 63) - 1 if r["n"] <= 2 * per_lang else (1 << 65) * per_lang // r["n"] - (1 << 63) for r in ids}
    bounds = F.create_map(*[F.lit(v) for pair in bound.items() for v in pair])
    order = Window.partitionBy("lang").orderBy("__key")
    return (rows.where(F.col("__key") <= bounds[F.col("lang")])
            .groupBy("lang", "__key").agg(F.min("text").alias("text"))
            .withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang)
            .select("lang", "text"))


def fit(docs: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_lang: int = PER_LANG, seed: int = 5) -> ByteNet | None:
    """A network learned from the documents where ``allowed`` holds; None
    without any."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tk.text_buffer(b["text"])
            lang, out = b["lang"].to_pylist(), []
            for a, z in tk.slices(offs):
                x, _, doc = windows(data[offs[a]:offs[z]], offs[a:z + 1] - offs[a])
                edge = np.searchsorted(doc, np.arange(z - a + 1))
                for d in range(z - a):
                    # the first window and one in the middle
                    for i in sorted({edge[d], (edge[d] + edge[d + 1]) // 2}) if edge[d + 1] > edge[d] else []:
                        out.append((lang[a + d], x[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()),
                                              pa.array([r[1] for r in out], pa.binary())], ["lang", "x"])

    got = (_labelled(docs, doc_id, text, lang, allowed, per_lang)
           .mapInArrow(cut, "lang string, x binary").toArrow().to_pydict())
    if not got["lang"]:
        return None
    rows = sorted(zip(got["lang"], got["x"], strict=True))
    langs = sorted({k for k, _ in rows})
    x = np.frombuffer(b"".join(v for _, v in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([langs.index(k) for k, _ in rows]), langs, seed=seed)


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = total[offs[1:]] > total[offs[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in data[offs[d]:offs[d + 1]].tobytes().decode())
    return out


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text``, unless it is to be kept) with the predicted
    language and its probability; columns of those names are replaced."""
    docs = docs.drop(*[c for c in (lang_col, score_col) if c in docs.columns and c != text])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rest = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the byte-pair tables of a copy go with the task
        net = shared.value and ByteNet(shared.value.langs, shared.value.params)
        for b in batches:
            data, offs = tk.text_buffer(b[text])
            lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for a, z in tk.slices(offs):
                part, own = data[offs[a]:offs[z]], offs[a:z + 1] - offs[a]
                x, used, doc = windows(part, own)
                if net is None or not len(x):
                    continue
                logit = net.logits(x).astype(np.float64) * used[:, None]
                for d, ok in enumerate(_has_letter(part, own)):
                    if ok:
                        i, j = np.searchsorted(doc, [d, d + 1])
                        prob = softmax(logit[i:j].sum(0) / used[i:j].sum())
                        lang[a + d], score[a + d] = net.langs[int(prob.argmax())], prob.max()
            yield pa.RecordBatch.from_arrays([*[b[n] for n in rest], pa.array(lang, pa.string()),
                                              pa.array(np.clip(score, 0, 1))], [*rest, lang_col, score_col])
        del net
        give_back()
    spec = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add(lang_col, "string").add(score_col, "double")
    return docs.mapInArrow(run, spec)
