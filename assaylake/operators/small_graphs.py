"""Frontier rounds of graphs that fit a task, many graphs at a time.

Edges and roots are shuffled once by graph; a task then runs the rounds of its
graphs together in arrays. :mod:`graph` uses it for graphs of at most
``SMALL_EDGES`` edges and joins the rounds of larger ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import by_rows

SMALL_EDGES = 1000
#: roots x nodes of the graphs that are worked on at once
SLICE_PAIRS = 1 << 20


def gathered(edges: DataFrame, start: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, edges, roots), one row a graph: its (src, dst, ...) and its distinct
    (a, b). Edges of a null key or a null source lead nowhere."""
    cols = [c for c in edges.columns if c != key]
    e = edges.where(F.col(key).isNotNull() & F.col("src").isNotNull()).select(key, F.struct(*cols).alias("_e"))
    r = start.select(key, F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("_r"))
    both = e.unionByName(r, allowMissingColumns=True)
    return by_rows(both, key).groupBy(key).agg(F.collect_list("_e").alias("edges"), F.collect_set("_r").alias("roots"))


class Graphs:
    """Some graphs in arrays. Nodes are numbered by graph and value."""

    def __init__(self, row: np.ndarray, values: pa.Array, edge_row: np.ndarray, root_row: np.ndarray):
        """``values``: sources, targets, then roots' first and last nodes; ``row``: their graphs."""
        d = values.dictionary_encode("encode")        # null is a value without edges
        known = d.dictionary
        order = np.empty(len(known), np.int64)
        by_value = pc.sort_indices(known)
        order[by_value.to_numpy()] = np.arange(len(known))
        self.values = known.take(by_value)
        width = max(len(known), 1)
        codes, at = np.unique(row * width + order[d.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
        self.code_value = codes % width
        self.n = max(len(codes), 1)
        ne, nr = len(edge_row), len(root_row)
        self.src, self.dst = at[:ne], at[ne:2 * ne]
        self.first, self.last = at[2 * ne:2 * ne + nr], at[2 * ne + nr:]
        pairs = np.unique(self.src * self.n + self.dst)
        self.nb = pairs % self.n
        self.starts = np.searchsorted(pairs // self.n, np.arange(self.n + 1))

    def next_of(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``node``, neighbour) of every edge that leaves one of ``node``."""
        count = self.starts[node + 1] - self.starts[node]
        at = np.repeat(np.arange(len(node)), count)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.nb[self.starts[node][at] + inside]

    def out(self, codes: np.ndarray) -> pa.Array:
        return self.values.take(pa.array(self.code_value[codes]))


def _without(x: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Places of ``x`` that are in none of the sorted ``known``."""
    keep = np.ones(len(x), bool)
    for k in known:
        if len(k):
            keep &= k[np.minimum(np.searchsorted(k, x), len(k) - 1)] != x
    return np.flatnonzero(keep)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Graphs, np.ndarray, pa.Array]]:
    """(graphs, their arrays, graph of each root, all edges) by ``SLICE_PAIRS``."""
    for b in batches:
        edges, roots = (b.column(n) for n in ("edges", "roots"))
        size = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (edges, roots)]
        part = np.cumsum((size[0] + 1) * size[1]) // SLICE_PAIRS
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = b.slice(lo, hi - lo)
            e, r = (own.column(n).flatten() for n in ("edges", "roots"))
            er, rr = (np.repeat(np.arange(hi - lo), s[lo:hi]) for s in size)
            values = pa.concat_arrays([e.field("src"), e.field("dst"), r.field("a"), r.field("b")])
            yield own, Graphs(np.concatenate([er, er, rr, rr]), values, er, rr), rr, e


def small_frontiers(graphs: DataFrame, key: str, a: str, b: str, name: str, max_rounds: int | None = None,
                    undirected: bool = True) -> DataFrame:
    """:func:`graph.frontiers` of the graphs of :func:`gathered`."""
    types = {f.name: f.dataType for f in graphs.schema}
    pair = types["roots"].elementType
    schema = T.StructType([T.StructField(key, types[key]), T.StructField(a, pair["a"].dataType),
                           T.StructField(b, pair["b"].dataType), T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, g, row, _ in slices(batches):
            if not len(row):
                continue
            root = np.unique(g.first)
            at = np.searchsorted(root, g.first)
            row_of = np.zeros(len(root), np.int64)
            row_of[at] = row
            levels = [np.unique(at * g.n + g.last)]
            while len(levels[-1]) and (max_rounds is None or len(levels) <= max_rounds):
                place, nb = g.next_of(levels[-1] % g.n)
                new = np.unique((levels[-1] // g.n)[place] * g.n + nb)
                levels.append(new[_without(new, levels[-2:] if undirected else levels)])
            found = np.concatenate(levels)
            r, hop = found // g.n, np.repeat(np.arange(len(levels), dtype=np.int32), [len(x) for x in levels])
            yield pa.RecordBatch.from_arrays([own.column(key).take(pa.array(row_of[r])), g.out(root[r]), g.out(found % g.n),
                                              pa.array(hop)], [key, a, b, name])
    return graphs.mapInArrow(run, schema)


def small_samples(graphs: DataFrame, key: str, k: int, cap: int, hashes: Callable[[list, int], list[int]]) -> DataFrame:
    """:func:`graph.sample_k_hop` of the graphs of :func:`gathered`.
    ``hashes(nodes, hop)``: the order in which a hop's nodes are kept."""
    types = {f.name: f.dataType for f in graphs.schema}
    node = types["roots"].elementType["a"].dataType
    schema = T.StructType([T.StructField(key, types[key]), T.StructField("root", node), T.StructField("node", node),
                           T.StructField("hop", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, g, row, _ in slices(batches):
            if not len(row):
                continue
            root = np.unique(g.first)
            at = np.searchsorted(root, g.first)
            row_of = np.zeros(len(root), np.int64)
            row_of[at] = row
            seen = [np.unique(at * g.n + g.last)]
            kept = [seen[0]]
            for h in range(1, k + 1):
                place, nb = g.next_of(kept[-1] % g.n)
                new = np.unique((kept[-1] // g.n)[place] * g.n + nb)
                new = new[_without(new, seen)]
                seen.append(new)
                r, value = new // g.n, g.code_value[new % g.n]
                order = np.lexsort((value, np.array(hashes(g.values.to_pylist(), h), np.int64)[value], r))
                inside = np.arange(len(r)) - np.searchsorted(r, r)      # r is in order
                kept.append(np.sort(new[order][inside < cap]))
            found = np.concatenate(kept)
            hop = np.repeat(np.arange(k + 1, dtype=np.int32), [len(x) for x in kept])
            yield pa.RecordBatch.from_arrays([own.column(key).take(pa.array(row_of[found // g.n])), g.out(root[found // g.n]),
                                              g.out(found % g.n), pa.array(hop)], [key, "root", "node", "hop"])
    return graphs.mapInArrow(run, schema)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def small_paths(graphs: DataFrame, key: str, feat: str, max_rounds: int | None = None, undirected: bool = True) -> DataFrame:
    """(key, i, j, path, dist, feats): :func:`graph.shortest_paths` of the graphs
    of :func:`gathered`, from dist 1 on; ``feats``: by step, ``feat`` of all edges
    between its two nodes."""
    types = {f.name: f.dataType for f in graphs.schema}
    node, value = types["roots"].elementType["a"].dataType, types["edges"].elementType[feat].dataType
    schema = T.StructType([T.StructField(key, types[key]), T.StructField("i", node), T.StructField("j", node),
                           T.StructField("path", T.ArrayType(node)), T.StructField("dist", T.IntegerType()),
                           T.StructField("feats", T.ArrayType(T.ArrayType(value)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, g, row, edges in slices(batches):
            by_pair = np.argsort(g.src * g.n + g.dst, kind="stable")
            pairs, feats = (g.src * g.n + g.dst)[by_pair], edges.field(feat).take(pa.array(by_pair))
            root, first = np.unique(g.first, return_index=True)
            row_of = row[first]
            code, path, rank = np.arange(len(root)) * g.n + root, root[:, None], np.arange(len(root))
            levels = [code]
            while max_rounds is None or len(levels) <= max_rounds:
                place, nb = g.next_of(code % g.n)
                new = (code // g.n)[place] * g.n + nb
                keep = _without(new, levels[-2:] if undirected else levels)
                keep = keep[np.lexsort((rank[place[keep]], new[keep]))]
                keep = keep[np.flatnonzero(np.diff(new[keep], prepend=-1))]     # of equal ends the smallest path
                if not len(keep):
                    break
                code, before = new[keep], place[keep]
                order = np.lexsort((g.code_value[nb[keep]], rank[before]))
                path, rank = np.column_stack([path[before], nb[keep]]), np.empty(len(keep), np.int64)
                rank[order] = np.arange(len(keep))
                levels.append(code)
                step = (path[:, :-1] * g.n + path[:, 1:]).ravel()
                lo, many = np.searchsorted(pairs, step), np.searchsorted(pairs, step, "right")
                many -= lo
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                dist = len(levels) - 1
                each = np.full(len(code), dist)
                r = code // g.n
                yield pa.RecordBatch.from_arrays(
                    [own.column(key).take(pa.array(row_of[r])), g.out(root[r]), g.out(code % g.n), _lists(each + 1, g.out(path.ravel())),
                     pa.array(each.astype(np.int32)), _lists(each, _lists(many, feats.take(pa.array(at))))], schema.names)
    return graphs.mapInArrow(run, schema)


def small_distances(graphs: DataFrame, key: str, limit: int | None = None, undirected: bool = True) -> DataFrame:
    """(key, i, j, dist) of the pairs (roots) of the graphs of :func:`gathered`
    that are connected, by ``limit`` hops at most."""
    types = {f.name: f.dataType for f in graphs.schema}
    pair = types["roots"].elementType
    schema = T.StructType([T.StructField(key, types[key]), T.StructField("i", pair["a"].dataType),
                           T.StructField("j", pair["b"].dataType), T.StructField("dist", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, g, row, _ in slices(batches):
            root, at = np.unique(g.first, return_inverse=True)
            asked = at * g.n + g.last
            levels = [np.arange(len(root)) * g.n + root]
            while len(levels[-1]):
                hit = np.flatnonzero(np.isin(asked, levels[-1]))
                yield pa.RecordBatch.from_arrays(
                    [own.column(key).take(pa.array(row[hit])), g.out(g.first[hit]), g.out(g.last[hit]),
                     pa.array(np.full(len(hit), len(levels) - 1, np.int32))], schema.names)
                if limit is not None and len(levels) > limit:
                    break
                place, nb = g.next_of(levels[-1] % g.n)
                new = np.unique((levels[-1] // g.n)[place] * g.n + nb)
                levels.append(new[_without(new, levels[-2:] if undirected else levels)])
    return graphs.mapInArrow(run, schema)


def gathered_marks(edges: DataFrame, nodes: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, edges, nodes, marks), one row a graph: all of its rows of each.
    Rows of a null key meet nothing, edges of a null source lead nowhere."""
    e = edges.where(F.col("src").isNotNull()).select(key, F.struct("src", "dst").alias("_e"))
    n = nodes.select(key, F.struct("node").alias("_n"))
    m = marks.select(key, F.struct("set_id", "piece", "node").alias("_m"))
    both = e.unionByName(n, allowMissingColumns=True).unionByName(m, allowMissingColumns=True).where(F.col(key).isNotNull())
    return by_rows(both, key).groupBy(key).agg(F.collect_list("_e").alias("edges"), F.collect_list("_n").alias("nodes"),
                                               F.collect_list("_m").alias("marks"))


def small_marks(graphs: DataFrame, key: str, hop: int | None, far: int) -> DataFrame:
    """:func:`graph.distance_to_marks` of the graphs of :func:`gathered_marks`."""
    types = {f.name: f.dataType for f in graphs.schema}
    mark = types["marks"].elementType
    schema = T.StructType([T.StructField(key, types[key]), *(T.StructField(c, mark[c].dataType) for c in ("set_id", "piece")),
                           T.StructField("node", types["nodes"].elementType["node"].dataType), T.StructField("dist", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(c) for c in ("edges", "nodes", "marks")]
            size = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
            part = np.cumsum((size[0] + size[1] + 1) * size[2]) // SLICE_PAIRS
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                e, n, m = (c.slice(lo, hi - lo).flatten() for c in lists)
                er, nr, mr = (np.repeat(np.arange(hi - lo), s[lo:hi]) for s in size)
                nodes, marked = n.field("node"), m.field("node")
                values = pa.concat_arrays([e.field("src"), e.field("dst"), nodes, marked])
                g = Graphs(np.concatenate([er, er, nr, mr]), values, er, nr)
                root, at = np.unique(g.last, return_inverse=True)
                levels = [np.arange(len(root)) * g.n + root]
                while len(levels[-1]) and (hop is None or len(levels) <= hop):
                    place, nb = g.next_of(levels[-1] % g.n)
                    new = np.unique((levels[-1] // g.n)[place] * g.n + nb)
                    levels.append(new[_without(new, levels[-2:])])
                found = np.concatenate(levels)
                dist = np.repeat(np.arange(len(levels), dtype=np.int32), [len(x) for x in levels])
                order = np.argsort(found, kind="stable")
                found, dist = found[order], dist[order]
                # every mark meets the nodes of its graph
                many = size[1][lo:hi]
                of_mark = np.repeat(np.arange(len(mr)), many[mr])
                if not len(of_mark):
                    continue
                before = np.cumsum(many[mr]) - many[mr]
                of_node = (np.cumsum(many) - many)[mr][of_mark] + np.arange(len(of_mark)) - before[of_mark]
                pair = at[of_mark] * g.n + g.first[of_node]
                place = np.minimum(np.searchsorted(found, pair), len(found) - 1)
                near = (found[place] == pair) & marked.is_valid().to_numpy(zero_copy_only=False)[of_mark]
                of_mark, rows = pa.array(of_mark), pa.array(mr[of_mark] + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(rows), m.field("set_id").take(of_mark), m.field("piece").take(of_mark),
                     nodes.take(pa.array(of_node)), pa.array(np.where(near, dist[place], far).astype(np.int32))], schema.names)
    return graphs.mapInArrow(run, schema)
