"""Exact top-k inner product by MaxScore over sharded postings.

A component index is a term: a shard keeps, for each component, the column of
its values and their smallest and largest value. For a query a component adds
at least ``low_d`` and at most ``high_d`` to any score of the shard; taking
``low_d`` off makes every contribution non-negative, as in text search.
Components are put in falling order of ``high_d - low_d``. While the k-th best
score so far (the threshold) exceeds what the last components can add
together, those are non-essential: only the essential columns are traversed
for all rows, and the rows whose partial score could still reach the threshold
are probed in the other columns, a few at a time, dropping rows that cannot
compete any more. Shards yield their own top k; a window merges them.

Bounds hold exactly: scores are integers and rows are dropped only when their
bound is below the threshold, so ties survive to the merge, which puts smaller
ids first.

Cases: vectors that are null, empty or hold a null or non-finite component
take no part; shorter vectors are zero in the missing components. Rows that
share an id, exact copies included, are all candidates, and all queries under
that id. Fewer than k candidates: all of them. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a shard, and of a block of queries sent to every shard
SHARD_ROWS = 8192
QUERY_ROWS = 1024


def scaled_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                   scale: float = 64.0) -> DataFrame:
    """(id, v): floor(scale * component) of the valid vectors, one row for each."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (table.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
            .where(F.col(vec_id).isNotNull())
            .select(F.col(vec_id).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x * scale)).alias("v")))


def _matrix(col: pa.Array) -> np.ndarray:
    offs = col.offsets.to_numpy()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(offs)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), np.int64)
    if len(n) and (n == out.shape[1]).all():
        return flat.reshape(out.shape)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], n)] = flat
    return out


def _pack(ids: np.ndarray, m: np.ndarray) -> dict:
    # the narrowest whole-number type that holds the values
    for t in (np.int8, np.int16, np.int32, np.int64):
        if m.size == 0 or (np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max):
            break
    return {"n": len(ids), "dims": m.shape[1], "width": np.dtype(t).itemsize,
            "ids": ids.astype(np.int64).tobytes(), "vals": m.T.astype(t).tobytes()}


def _unpack(n, dims, width, ids, vals) -> tuple[np.ndarray, np.ndarray]:
    t = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[width]
    return np.frombuffer(ids, np.int64), np.frombuffer(vals, t).reshape(dims, n)


_BLOCK = "n long, dims long, width long, ids binary, vals binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SHARD_ROWS):
            part = b.slice(at, SHARD_ROWS)
            yield pa.RecordBatch.from_pylist([_pack(part["id"].to_numpy(), _matrix(part["v"]))])


def _query_block(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    ids, v = group["id"].combine_chunks(), group["v"].combine_chunks()
    return pa.Table.from_pylist([{"block": group["block"][0].as_py(), **_pack(ids.to_numpy(), _matrix(v))}])


def shard_topk(ids: np.ndarray, columns: np.ndarray, qid: int, q: np.ndarray, k: int,
               step: int = 2048, probe: int = 16, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the shard's rows that can be among the best k.

    ``columns``: float64 (dims, rows) postings; ``q``: float64 (dims,). The
    first ``step`` rows give a threshold; each further run of rows is larger.
    ``ends``: smallest and largest value of each column, if known."""
    least, most = ends or (columns.min(1), columns.max(1))
    low, high = np.minimum(q * least, q * most), np.maximum(q * least, q * most)
    order = np.argsort(low - high, kind="stable")
    rest = np.concatenate((np.cumsum((high - low)[order][::-1])[::-1], [0.0]))   # what order[i:] can add over low
    base = np.concatenate((np.cumsum(low[order][::-1])[::-1], [0.0]))            # what order[i:] adds at least
    best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
    floor = -np.inf
    at = 0
    while at < columns.shape[1]:
        block = columns[:, at:at + step]
        # essential: as long as the others together could lift a row over the threshold on their own
        first = int(np.searchsorted(-(rest + base[0]), -floor, side="right")) if np.isfinite(floor) else len(order)
        first = min(max(first, 1), len(order))
        rows = np.arange(block.shape[1])
        score = q[order[:first]] @ block[order[:first]]
        d = first
        while True:
            keep = (score + base[d] + rest[d] >= floor) & (ids[at + rows] != qid)
            rows, score = rows[keep], score[keep]
            if d == len(order) or not len(rows):
                break
            more = order[d:d + probe]
            score = score + q[more] @ block[more][:, rows]
            d = min(d + probe, len(order))
        if len(rows) > k:
            # ties with the k-th best stay for the ids to decide
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        if len(rows):
            best_i = np.concatenate((best_i, ids[at + rows]))
            best_s = np.concatenate((best_s, score))
            if len(best_s) > k:
                pick = np.lexsort((best_i, -best_s))[:k]
                best_i, best_s = best_i[pick], best_s[pick]
            if len(best_s) == k:
                floor = best_s.min()
        at, step = at + step, 4 * step
    return best_i, best_s


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, cols = _unpack(r["n"], r["dims"], r["width"], r["ids"], r["vals"])
                qids, qcols = _unpack(r["q_n"], r["q_dims"], r["q_width"], r["q_ids"], r["q_vals"])
                dims = min(len(cols), len(qcols))
                largest = [float(max(m.max(initial=0), -float(m.min(initial=0)))) for m in (cols, qcols)]
                wide = dims * largest[0] * largest[1] >= 2.0 ** 53
                kind = np.longdouble if wide else np.float64    # whole numbers stay exact
                cols, qcols = cols[:dims].astype(kind), qcols[:dims].astype(kind)
                ends = (cols.min(1), cols.max(1)) if cols.size else None
                out = [(np.full(len(i), q), i, s) for q, (i, s) in
                       ((q, shard_topk(ids, cols, q, np.ascontiguousarray(qcols[:, j]), k, ends=ends))
                        for j, q in enumerate(qids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out]) if out else [], pa.int64()),
                     pa.array(np.concatenate([x[1] for x in out]) if out else [], pa.int64()),
                     pa.array(np.concatenate([x[2] for x in out]).astype(np.int64) if out else [], pa.int64())],
                    ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` candidates of each query.

    ``vectors``: (id, v array<long>); ``is_query``: condition on ``id``. All
    rows are candidates; a query never meets its own id. Blocks of queries
    meet every shard: the query set against all rows, in blocks."""
    n, rows = vectors.agg(F.count_if(is_query), F.count(F.lit(1))).first()
    blocks, lanes = max(1, -(-n // QUERY_ROWS)), max(1, -(-rows // SHARD_ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    queries = (vectors.where(is_query)
               .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
               .groupBy("block").applyInArrow(_query_block, "block long, " + _BLOCK)
               .select("block", *[F.col(c).alias("q_" + c) for c in ("n", "dims", "width", "ids", "vals")])
               .withColumn("lane", every(lanes)))
    # a lane holds about one shard: each task joins one block of queries with one shard
    shards = (vectors.mapInArrow(_shards, _BLOCK)
              .withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
              .withColumn("block", every(blocks)))
    found = (shards.join(queries, ["block", "lane"])
             .mapInArrow(_search(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
