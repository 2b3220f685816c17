"""Graph-table operators.

Graphs are long tables: ``nodes(key, node, ...)`` and ``edges(key, src, dst,
...)`` where ``key`` identifies a graph (a molecule) or is a constant for one
big graph. Traversals are frontier rounds of join + anti join keyed by
``(key, root, node)``; propagation is ``edges ⋈ features`` followed by a
map-side-combined ``groupBy(dst)``. Hub nodes (one node with a large share of the edges) are
found by their degree and joined in lanes (:class:`Spread`), and the group-by
never collects a neighbour list. Loops write every round to the shared folder.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash32, hash32_of
from ..session import by_rows, scratch_path, written
from .small_graphs import SMALL_EDGES, gathered, gathered_marks, small_frontiers, small_marks, small_paths, small_samples

UNREACHABLE_APSP = 510
UNREACHABLE_CAPPED = 9999
#: outputs of all pairs are refused for graphs of more nodes
ALL_PAIRS_NODES = 2048
#: a node with more than 1 / HUBS of all edges is a hub; its edges are dealt out to LANES lanes
HUBS = 1000
LANES = 32


def graph_nodes(n_nodes: DataFrame, key: str = "g", count: str = "n") -> DataFrame:
    """Node table incl. isolated nodes from a per-graph node count."""
    return n_nodes.select(key, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("node"))


def symmetrize(edges: DataFrame, num_rels: int | None = None, rel: str = "rel") -> DataFrame:
    """Both directions of every edge, emitted from its one row; reversed
    relation types are shifted by num_rels."""
    back = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    if num_rels is not None:
        back[rel] = (F.col(rel) + num_rels).alias(rel)
    rev = F.struct(*[back.get(c, F.col(c)) for c in edges.columns])
    return edges.select(F.inline(F.array(F.struct(*edges.columns), rev)))


def large_graphs(edges: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Keys of graphs that do not fit a task: those of more than ``SMALL_EDGES``
    edges (and rows of ``others``), and of edges to nowhere (null)."""
    each = edges.select(key, F.col("dst").isNull().alias("_null"))
    for df in others:
        each = each.unionByName(df.select(key, F.lit(False).alias("_null")))
    return written(each.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_null").alias("_open"))
        .where((F.col("_n") > SMALL_EDGES) | (F.col("_open") > 0)).select(key), "large", grows=True)


def by_size(df: DataFrame, large: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` of small and of large graphs."""
    return df.join(large, key, "left_anti"), df.join(large, key, "left_semi")


def frontiers(edges: DataFrame, start: DataFrame, key: str, a: str, b: str, name: str, max_rounds: int | None = None,
              undirected: bool = True, block: DataFrame | None = None) -> DataFrame:
    """``(key, a, b, name)``: the nodes ``b`` first reached from ``a`` in round
    ``name`` (0: ``start``), by frontier rounds until no pair is new.

    Small graphs are shuffled once and run all their rounds in a task
    (:mod:`small_graphs`); the rounds of large ones are joins
    (:func:`joined_frontiers`).

    ``block(key, a, b)``: nodes that may not be reached in round 1 and are
    released afterwards (all rounds are joins then)."""
    if block is not None:
        return joined_frontiers(edges, start, key, a, b, name, max_rounds, undirected, block)
    e = written(edges.select(key, "src", "dst"), "edges", grows=True)
    large = large_graphs(e, key)
    rounds = dict(name=name, max_rounds=max_rounds, undirected=undirected)
    if large.isEmpty():
        return small_frontiers(gathered(e, start, key, a, b), key, a, b, **rounds)
    (small_e, large_e), (small_s, large_s) = by_size(e, large, key), by_size(start.select(key, a, b), large, key)
    return small_frontiers(gathered(small_e, small_s, key, a, b), key, a, b, **rounds).unionByName(
        joined_frontiers(large_e, large_s, key, a, b, **rounds))


def joined_frontiers(edges: DataFrame, start: DataFrame, key: str, a: str, b: str, name: str, max_rounds: int | None = None,
                     undirected: bool = True, block: DataFrame | None = None) -> DataFrame:
    """:func:`frontiers` of graphs of any size by a join a round.

    Undirected graphs (symmetric ``edges``) only need the two previous levels
    for the "new" test (a neighbour of a node at distance h is at h-1, h or
    h+1), so the anti join never touches the growing visited set. Directed
    graphs anti-join against all levels. Every level is written once, as one
    part of a single table in the shared folder: rounds read the levels they
    need, and the result is one scan of that table.

    ``block(key, a, b)``: nodes that may not be reached in round 1 and are
    released afterwards (full visited set is then used)."""
    spark, base = edges.sparkSession, scratch_path(edges.sparkSession, "frontiers")
    undirected = undirected and block is None
    e = written(edges.select(key, F.col("src").alias(b), F.col("dst").alias("_nb")).distinct(), "edges", grows=True)
    schema = start.select(key, a, b).schema

    def levels(first: int, last: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{base}/{name}={h}" for h in range(first, last + 1)]).hint("merge")

    start.select(key, a, b).distinct().write.parquet(f"{base}/{name}=0")
    for h in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        nxt = levels(h - 1, h - 1).join(e, [key, b]).select(key, a, F.col("_nb").alias(b)).distinct()
        seen = levels(max(0, h - 2) if undirected else 0, h - 1)
        if block is not None and h == 1:
            seen = seen.unionByName(block.select(key, a, b))
        nxt.join(seen, [key, a, b], "left_anti").write.parquet(f"{base}/{name}={h}")
        if levels(h, h).isEmpty():
            break
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])).parquet(base).hint("merge")


def k_hop(edges: DataFrame, roots: DataFrame, k: int, key: str = "g", undirected: bool = True,
          block: DataFrame | None = None) -> DataFrame:
    """Nodes exactly h hops from each root (h = 0..k): BFS frontier rounds.

    ``edges(key, src, dst)``; pass symmetric edges and ``undirected=True``
    for undirected graphs, else ``undirected=False``. ``roots(key, root)``.
    ``block(key, root, node)`` optionally blocks one node per root at hop 1
    and releases it afterwards. Returns ``(key, root, node, hop)``."""
    start = roots.select(key, "root", F.col("root").alias("node"))
    return frontiers(edges, start, key, "root", "node", "hop", k, undirected=undirected, block=block)


def cap_per_root(df: DataFrame, cap: int, by: Sequence[str], node: str = "node", seed: int = 0) -> DataFrame:
    """Keep ``cap`` rows per group by hash order (sampling without
    replacement). A group is a (root, hop) frontier; tasks send at most ``cap``
    rows of a group on, so a hot one is cut down before the shuffle."""
    order = Window.partitionBy(*by).orderBy("_h", node)
    return (df.withColumn("_h", hash32(node, seed=seed)).withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") <= cap).drop("_h", "_r"))


def sample_k_hop(edges: DataFrame, roots: DataFrame, k: int, cap: int, key: str = "g",
                 seed: int = 0) -> DataFrame:
    """Like :func:`k_hop` but each frontier is capped to ``cap`` nodes per root
    after it has been marked visited (cut nodes are never revisited). Small
    graphs run their rounds in a task, as in :func:`frontiers`."""
    e = written(edges.select(key, "src", "dst"), "edges", grows=True)
    start = roots.select(key, "root", F.col("root").alias("node"))
    # node values that are written alike here and in Spark
    plain = {e.schema["dst"].dataType, start.schema["root"].dataType} <= {T.IntegerType(), T.LongType(), T.StringType()}
    large = large_graphs(e, key)
    if not plain:
        return joined_samples(e, roots, k, cap, key, seed)

    def small(e: DataFrame, start: DataFrame) -> DataFrame:
        return small_samples(gathered(e, start, key, "root", "node"), key, k, cap,
                             lambda nodes, hop: [hash32_of(n, seed=seed + hop) for n in nodes])
    if large.isEmpty():
        return small(e, start)
    (small_e, large_e), (small_s, large_s) = by_size(e, large, key), by_size(start, large, key)
    return small(small_e, small_s).unionByName(joined_samples(large_e, large_s.select(key, "root"), k, cap, key, seed))


def joined_samples(edges: DataFrame, roots: DataFrame, k: int, cap: int, key: str = "g", seed: int = 0) -> DataFrame:
    """:func:`sample_k_hop` of graphs of any size by joins. A round writes its
    new nodes once; the cap is read off them."""
    e = written(edges.select(key, F.col("src").alias("node"), "dst").distinct(), "edges", grows=True)
    start = roots.select(key, "root", F.col("root").alias("node")).distinct()
    levels, kept = [start], [start]
    for h in range(1, k + 1):
        nxt = kept[-1].join(e, [key, "node"]).select(key, "root", F.col("dst").alias("node")).distinct()
        seen = functools.reduce(DataFrame.unionByName, levels).hint("merge")
        levels.append(written(nxt.join(seen, [key, "root", "node"], "left_anti"), "frontier", grows=True))
        kept.append(cap_per_root(levels[-1], cap, [key, "root"], seed=seed + h))
    return functools.reduce(DataFrame.unionByName, [x.withColumn("hop", F.lit(h)) for h, x in enumerate(kept)])


def check_graph_sizes(nodes: DataFrame, max_nodes: int, key: str = "g") -> None:
    """Raise if a graph has more than ``max_nodes`` nodes."""
    most = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > max_nodes:
        raise ValueError(f"a graph has {most} nodes; outputs of all its pairs are made up to {max_nodes}. "
                         "Ask for the pairs that are needed (distances.pair_distances)")


def all_pairs(edges: DataFrame, nodes: DataFrame, key: str = "g", max_rounds: int | None = None,
              undirected: bool = True, max_nodes: int = ALL_PAIRS_NODES) -> DataFrame:
    """Shortest hop distance for every reachable ordered pair of each graph,
    by frontier rounds from every node until no pair is new. Unreachable pairs
    are absent. The output is quadratic in a graph's nodes, so a graph of more
    than ``max_nodes`` raises; :mod:`distances` answers requested pairs of any
    graph."""
    check_graph_sizes(nodes, max_nodes, key)
    start = nodes.select(key, F.col("node").alias("i"), F.col("node").alias("j"))
    return frontiers(edges, start, key, "i", "j", "dist", max_rounds, undirected=undirected)


def degree_table(nodes: DataFrame, edges: DataFrame, key: str = "g") -> DataFrame:
    """In and out degree per node, 0 for isolated nodes."""
    out_d = edges.groupBy(key, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_d = edges.groupBy(key, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (nodes.select(key, "node").join(out_d, [key, "node"], "left").join(in_d, [key, "node"], "left")
            .fillna(0, ["out_degree", "in_degree"]))


def random_marks(n_nodes: DataFrame, sets: int, pieces: int, key: str = "g", count: str = "n",
                 seed: int = 0) -> DataFrame:
    """Per graph, ``sets`` sets of ``pieces`` random node ids in [0, n)."""
    d = n_nodes.select(key, count, F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set_id"))
    d = d.select(key, count, "set_id", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
    return d.select(key, "set_id", "piece",
                    F.pmod(hash32(key, "set_id", "piece", seed=seed), F.col(count)).cast("int").alias("node"))


def marking_matrix(nodes: DataFrame, marks: DataFrame, key: str = "g") -> DataFrame:
    """-1 at marked nodes, +1 elsewhere, per marking set."""
    sets = marks.select(key, "set_id").distinct()
    grid = nodes.select(key, "node").join(sets, key)  # nodes x (fixed number of sets)
    m = marks.select(key, "set_id", "node").distinct().withColumn("_m", F.lit(True))
    return grid.join(m, [key, "set_id", "node"], "left").select(
        key, "set_id", "node", F.when(F.col("_m"), F.lit(-1)).otherwise(F.lit(1)).alias("mark"))


def distance_to_marks(nodes: DataFrame, edges: DataFrame, marks: DataFrame, hop: int = 2, key: str = "g",
                      far: int = UNREACHABLE_CAPPED) -> DataFrame:
    """For every node and every marked node of the same set: hop distance up
    to ``hop``, else ``far``. Rows = nodes x marks of a graph (a fixed number).
    Small graphs make their rows in a task (:mod:`small_graphs`), large ones by
    joins (:func:`joined_marks`)."""
    marks = written(marks, "marks", grows=True)
    e = written(edges.select(key, "src", "dst"), "edges", grows=True)
    if len({df.schema[c].dataType for df, c in ((e, "src"), (e, "dst"), (nodes, "node"), (marks, "node"))}) > 1:
        return joined_marks(nodes, e, marks, hop, key, far)
    large = large_graphs(e, key, nodes, marks)
    if large.isEmpty():
        return small_marks(gathered_marks(e, nodes, marks, key), key, hop, far)
    (small_e, large_e), (small_n, large_n), (small_m, large_m) = (by_size(x, large, key) for x in (e, nodes, marks))
    return small_marks(gathered_marks(small_e, small_n, small_m, key), key, hop, far).unionByName(
        joined_marks(large_n, large_e, large_m, hop, key, far))


def joined_marks(nodes: DataFrame, edges: DataFrame, marks: DataFrame, hop: int = 2, key: str = "g",
                 far: int = UNREACHABLE_CAPPED) -> DataFrame:
    """:func:`distance_to_marks` of graphs of any size by joins. Nodes of one
    graph meet its marks in ``LANES`` lanes, so one big graph is spread over
    many tasks."""
    roots = marks.select(key, F.col("node").alias("root")).distinct()
    reach = k_hop(edges, roots, hop, key=key).select(key, "root", "node", F.col("hop").alias("dist"))
    asked = marks.select(key, "set_id", "piece", F.col("node").alias("root"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint"))).alias("_lane"))
    grid = nodes.select(key, "node", F.pmod(F.xxhash64("node"), F.lit(LANES)).alias("_lane")).join(asked, [key, "_lane"])
    return grid.join(reach, [key, "root", "node"], "left").select(
        key, "set_id", "piece", "node", F.coalesce(F.col("dist"), F.lit(far)).alias("dist"))


# ---- propagation --------------------------------------------------------------

@dataclass
class Spread:
    """Edges prepared for joins on ``src``: ``table`` has a lane for each edge
    (0 but for those of hubs, which are spread by their ``dst``), ``hubs`` the
    nodes with more than 1 / ``HUBS`` of all edges, so fewer than ``HUBS``;
    ``rows``: the number of edges."""
    table: DataFrame
    hubs: DataFrame
    key: str
    rows: int

    def with_source(self, feats: DataFrame, *cols: str) -> DataFrame:
        """Edges joined with the rows of ``feats`` (key, node, ...) of their
        source. A hub's rows go to all of its lanes. Edges are dealt by their
        rows: parts sized by compressed bytes grow with repetitive edges."""
        lanes = F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint"))
        f = (feats.withColumnRenamed("node", "src").join(F.broadcast(self.hubs), [self.key, "src"], "left")
             .withColumn("_lane", F.explode(F.when(F.col("_hub"), lanes).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("_hub"))
        on = [self.key, "src", "_lane"]
        return by_rows(self.table.select(self.key, "src", "dst", "_lane", *cols), *on, rows=self.rows).join(f, on)


def spread(edges: DataFrame | Spread, key: str = "g") -> Spread:
    """Write ``edges`` once, with hubs found by their share of all edges: a node
    on a third of them does not gather in one task of the join. On the receiving
    side sums are combined in each task before the shuffle."""
    if isinstance(edges, Spread):
        return edges
    table = written(edges, "edges", grows=True)
    n = table.count()
    degree = table.groupBy(key, "src").agg(F.count(F.lit(1)).alias("_n"))
    hubs = written(degree.where(F.col("_n") * HUBS > n).select(key, "src", F.lit(True).alias("_hub")), "hubs")
    lane = F.when(F.col("_hub"), F.pmod(F.xxhash64("dst"), F.lit(LANES))).otherwise(0)
    return Spread(written(table.join(F.broadcast(hubs), [key, "src"], "left").withColumn("_lane", lane).drop("_hub"), "edges", grows=True), hubs, key, n)


def neighbor_sum(feats: DataFrame, edges: DataFrame | Spread, key: str = "g", eps: float = 0.0) -> DataFrame:
    """GIN aggregate: (1 + eps) * h + sum of in-neighbour h, per dim.
    ``feats(key, node, dim, x)``, ``edges(key, src, dst)``."""
    msg = spread(edges, key).with_source(feats).groupBy(key, F.col("dst").alias("node"), "dim").agg(F.sum("x").alias("_agg"))
    return feats.join(msg, [key, "node", "dim"], "left").select(
        key, "node", "dim", (F.lit(1.0 + eps) * F.col("x") + F.coalesce(F.col("_agg"), F.lit(0.0))).alias("x"))


def neighbor_mean(feats: DataFrame, edges: DataFrame | Spread, key: str = "g", weight: str | None = None) -> DataFrame:
    """Row-normalised D^-1 (A + I) X with optional edge weights (self weight 1)."""
    w = F.col(weight) if weight else F.lit(1.0)
    msg = (spread(edges, key).with_source(feats, *([weight] if weight else []))
           .groupBy(key, F.col("dst").alias("node"), "dim").agg(F.sum(w * F.col("x")).alias("_wx"), F.sum(w).alias("_w")))
    return feats.join(msg, [key, "node", "dim"], "left").select(key, "node", "dim", (
        (F.col("x") + F.coalesce("_wx", F.lit(0.0))) / (1.0 + F.coalesce("_w", F.lit(0.0)))).alias("x"))


def neighbor_symnorm(feats: DataFrame, edges: DataFrame | Spread, key: str = "g") -> DataFrame:
    """GCN: D^-1/2 (A + I) D^-1/2 X with degrees counted with the self loop.
    Values are divided by the root of their own degree once, summed over the
    edges, and divided by the receiver's."""
    e = spread(edges, key)
    degree = e.table.groupBy(key, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    own = F.sqrt(F.coalesce(F.col("_n"), F.lit(0)) + 1)
    scaled = written(feats.join(degree, [key, "node"], "left").select(key, "node", "dim", (F.col("x") / own).alias("x"), own.alias("_root")),
                     "scaled", grows=True)
    msg = e.with_source(scaled.drop("_root")).groupBy(key, F.col("dst").alias("node"), "dim").agg(F.sum("x").alias("_agg"))
    return scaled.join(msg, [key, "node", "dim"], "left").select(
        key, "node", "dim", ((F.col("x") + F.coalesce("_agg", F.lit(0.0))) / F.col("_root")).alias("x"))


def edge_feature_sum(feats: DataFrame, edges: DataFrame | Spread, key: str = "g", edge_x: str = "ex") -> DataFrame:
    """GINE message: sum over in-edges of relu(h_src + e)."""
    return spread(edges, key).with_source(feats, edge_x).groupBy(key, F.col("dst").alias("node"), "dim").agg(
        F.sum(F.greatest(F.col("x") + F.col(edge_x), F.lit(0.0))).alias("x"))


def relation_mean(feats: DataFrame, edges: DataFrame | Spread, key: str = "g", rel: str = "rel",
                  edge_x: str = "ex") -> DataFrame:
    """RGCN-style: per relation the mean of relu(x_src + x_edge), relation
    results summed per node."""
    per = spread(edges, key).with_source(feats, rel, edge_x).groupBy(key, F.col("dst").alias("node"), rel, "dim").agg(
        F.avg(F.greatest(F.col("x") + F.col(edge_x), F.lit(0.0))).alias("_m"))
    return per.groupBy(key, "node", "dim").agg(F.sum("_m").alias("x"))


def edge_attention(feats: DataFrame, edges: DataFrame | Spread, key: str = "g", rel: str = "rel",
                   score: str = "score") -> DataFrame:
    """Softmax of edge scores over the in-edges of each (dst, rel), weighted sum
    of source features, summed over relations. The largest score of a group is
    joined back to its edges (no window over a hub's edges), in lanes where the
    group has more than 1 / ``HUBS`` of all edges."""
    e = spread(edges, key)
    most = written(e.table.groupBy(key, "dst", rel).agg(F.max(score).alias("_max"), F.count(F.lit(1)).alias("_n")), "scores", grows=True)
    n = e.table.count()
    lanes = F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint"))
    hot = F.col("_n") * HUBS > n
    hubs = F.broadcast(most.where(hot).select(key, "dst", rel, F.lit(True).alias("_hot")))        # fewer than HUBS rows
    most = most.select(key, "dst", rel, "_max", F.explode(F.when(hot, lanes).otherwise(F.array(F.lit(0).cast("bigint")))).alias("_to"))
    to = F.when(F.col("_hot"), F.pmod(F.xxhash64("src"), F.lit(LANES))).otherwise(0)
    weighed = (e.table.join(hubs, [key, "dst", rel], "left").withColumn("_to", to).join(most, [key, "dst", rel, "_to"])
               .select(key, "src", "dst", "_lane", rel, F.exp(F.col(score) - F.col("_max")).alias("_ex")))
    j = Spread(weighed, e.hubs, key, n).with_source(feats, rel, "_ex")
    parts = j.groupBy(key, F.col("dst").alias("node"), rel, "dim").agg(
        (F.sum(F.col("_ex") * F.col("x")) / F.sum("_ex")).alias("_x"))
    return parts.groupBy(key, "node", "dim").agg(F.sum("_x").alias("x"))


def combine_layers(layers: Sequence[DataFrame], how: str = "sum", key: str = "g") -> DataFrame:
    """Jumping knowledge over per-round features: last, sum, or concat
    (dims of layer l shifted by l * n_dims)."""
    if how == "last":
        return layers[-1]
    tagged = None
    for i, df in enumerate(layers):
        t = df.withColumn("layer", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    if how == "sum":
        return tagged.groupBy(key, "node", "dim").agg(F.sum("x").alias("x"))
    if how == "concat":
        nd = layers[0].select("dim").distinct().count()  # number of feature dims (small)
        return tagged.select(key, "node", (F.col("dim") + F.col("layer") * F.lit(nd)).alias("dim"), "x")
    raise ValueError(how)


def virtual_node(feats: DataFrame, edges: DataFrame | Spread, rounds: int, key: str = "g") -> DataFrame:
    """Each round: h <- neighbor_sum(h + vn), vn <- vn + graph sum of h."""
    e, h = spread(edges, key), feats
    vn = feats.select(key, "dim").distinct().withColumn("vn", F.lit(0.0))
    for _ in range(rounds):
        hv = h.join(vn, [key, "dim"]).select(key, "node", "dim", (F.col("x") + F.col("vn")).alias("x"))
        h = written(neighbor_sum(hv, e, key), "round", grows=True)
        gs = h.groupBy(key, "dim").agg(F.sum("x").alias("_s"))
        vn = vn.join(gs, [key, "dim"]).select(key, "dim", (F.col("vn") + F.col("_s")).alias("vn"))
    return h


def readout(feats: DataFrame, key: str = "g", how: str = "sum") -> DataFrame:
    """Pool node values per graph and dim: sum, mean, max, or maxmean."""
    g = feats.groupBy(key, "dim")
    if how == "sum":
        return g.agg(F.sum("x").alias("x"))
    if how == "mean":
        return g.agg(F.avg("x").alias("x"))
    if how == "max":
        return g.agg(F.max("x").alias("x"))
    if how == "maxmean":
        return g.agg(F.max("x").alias("x_max"), F.avg("x").alias("x_mean"))
    raise ValueError(how)


def shortest_paths(edges: DataFrame, nodes: DataFrame, key: str = "g", max_rounds: int | None = None,
                   undirected: bool = True, max_nodes: int = ALL_PAIRS_NODES, feat: str | None = None) -> DataFrame:
    """All reachable pairs with one shortest path each: among equal-length
    paths the lexicographically smallest node sequence is kept. Returns
    ``(key, i, j, path, dist)``, with ``feat`` also ``feats``: by step, that
    column of all edges between the step's nodes (:func:`path_edges` then needs
    no join). Small graphs run their rounds in a task, as in :func:`frontiers`;
    a graph of more than ``max_nodes`` nodes raises."""
    check_graph_sizes(nodes, max_nodes, key)
    e = written(edges.select(key, "src", "dst", F.col(feat) if feat else F.lit(None).cast("int").alias("feat")), "edges", grows=True)
    name = feat or "feat"
    large = large_graphs(e, key)
    start = nodes.select(key, F.col("node").alias("i"), F.col("node").alias("j"))
    none = F.array().cast(T.ArrayType(T.ArrayType(e.schema[name].dataType)))
    (small_e, large_e), (small_s, large_s) = ((e, None), (start, None)) if large.isEmpty() else (by_size(x, large, key) for x in (e, start))
    out = (small_s.select(key, "i", "j", F.array("i").alias("path"), F.lit(0).alias("dist"), none.alias("feats"))
           .unionByName(small_paths(gathered(small_e, small_s, key, "i", "j"), key, name, max_rounds, undirected)))
    if large_s is not None:
        paths = joined_paths(large_e, large_s.select(key, F.col("i").alias("node")), key, max_rounds, undirected)
        if feat:
            by_step = path_edges(paths, large_e, key=key, feat=name).groupBy(key, "i", "j", "k").agg(F.collect_list("edge_feat").alias("f"))
            feats = by_step.groupBy(key, "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]).alias("feats"))
            paths = paths.join(feats, [key, "i", "j"], "left").withColumn("feats", F.coalesce("feats", none))
        else:
            paths = paths.withColumn("feats", none)
        out = out.unionByName(paths)
    return out if feat else out.drop("feats")


def joined_paths(edges: DataFrame, nodes: DataFrame, key: str = "g", max_rounds: int | None = None,
                 undirected: bool = True) -> DataFrame:
    """:func:`shortest_paths` of graphs of any size by joins (``min`` over arrays
    in the group-by). Levels are written and excluded as in :func:`joined_frontiers`."""
    spark, base = edges.sparkSession, scratch_path(edges.sparkSession, "paths")
    e = written(edges.select(key, F.col("src").alias("j"), F.col("dst").alias("_nb")).distinct(), "edges", grows=True)
    start = nodes.select(key, F.col("node").alias("i"), F.col("node").alias("j"), F.array(F.col("node")).alias("path"))
    schema = T.StructType([T.StructField(c.name, c.dataType) for c in start.schema])

    def levels(first: int, last: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{base}/dist={h}" for h in range(first, last + 1)]).hint("merge")

    start.write.parquet(f"{base}/dist=0")
    for h in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        nxt = levels(h - 1, h - 1).join(e, [key, "j"]).select(key, "i", F.col("_nb").alias("j"),
                                                              F.concat("path", F.array("_nb")).alias("path"))
        seen = levels(max(0, h - 2) if undirected else 0, h - 1).select(key, "i", "j")
        new = nxt.join(seen, [key, "i", "j"], "left_anti").groupBy(key, "i", "j").agg(F.min("path").alias("path"))
        new.write.parquet(f"{base}/dist={h}")
        if levels(h, h).isEmpty():
            break
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("dist", T.IntegerType())])).parquet(base)


def path_edges(paths: DataFrame, edges: DataFrame, max_dist: int | None = None, key: str = "g", feat: str = "bond_order") -> DataFrame:
    """Edge feature at each step k (0-based) of the chosen shortest path,
    for k < min(dist, max_dist). Positions beyond are the -1 fill (implicit).
    Paths with ``feats`` hold the features already."""
    if "feats" in paths.columns:
        steps = paths.where("dist > 0").select(key, "i", "j", F.posexplode("feats").alias("k", "_f"))
        if max_dist is not None:
            steps = steps.where(F.col("k") < max_dist)
        return steps.select(key, "i", "j", F.col("k").cast("int").alias("k"), F.explode("_f").alias("edge_feat"))
    steps = paths.where("dist > 0").select(key, "i", "j", "path", F.posexplode(F.slice(
        "path", 2, F.size("path"))).alias("k", "b"))
    if max_dist is not None:
        steps = steps.where(F.col("k") < max_dist)
    steps = steps.withColumn("a", F.element_at("path", (F.col("k") + 1).cast("int")))
    ef = edges.select(key, F.col("src").alias("a"), F.col("dst").alias("b"), F.col(feat).alias("edge_feat"))
    return steps.join(ef, [key, "a", "b"]).select(key, "i", "j", F.col("k").cast("int").alias("k"), "edge_feat")
