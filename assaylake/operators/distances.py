"""Distances of requested pairs, and the largest distance of a set of graphs,
without the table of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import UNREACHABLE_APSP, by_size, frontiers, large_graphs
from .small_graphs import gathered, small_distances


def pair_distances(edges: DataFrame, pairs: DataFrame, key: str = "g", limit: int | None = None,
                   far: int = UNREACHABLE_APSP, undirected: bool = True) -> DataFrame:
    """``pairs`` (key, i, j, ...) with ``dist``: the hops from i to j, ``far``
    where there is no path, no path of ``limit`` hops at most, or no such node
    (a node always reaches itself).

    Small graphs are searched in a task (:mod:`small_graphs`), large ones from
    both ends (:func:`joined_distances`). Null ends are never met and get ``far``."""
    e = written(edges.select(key, "src", "dst"), "edges", grows=True)
    large = large_graphs(e, key)
    asked = pairs.select(key, "i", "j").where(F.col(key).isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull())
    if large.isEmpty():
        known = small_distances(gathered(e, asked, key, "i", "j"), key, limit, undirected)
    else:
        (small_e, large_e), (small_p, large_p) = by_size(e, large, key), by_size(asked, large, key)
        known = small_distances(gathered(small_e, small_p, key, "i", "j"), key, limit, undirected).unionByName(
            joined_distances(large_e, large_p, key, limit, undirected))
    return pairs.join(known.hint("merge"), [key, "i", "j"], "left").withColumn("dist", F.coalesce("dist", F.lit(far)))


def joined_distances(edges: DataFrame, pairs: DataFrame, key: str = "g", limit: int | None = None,
                     undirected: bool = True) -> DataFrame:
    """(key, i, j, dist) of the distinct pairs that are connected, by ``limit``
    hops at most.

    Frontiers grow from both ends, the smaller one next; a pair is settled in
    the round in which the two meet, at which the sum of the rounds is its
    distance. Frontiers are kept by distinct end, so pairs with a common end
    share its search, and ends without an open pair are dropped. Work follows
    the neighbourhoods of half the distance, not the graph."""
    e = edges.select(key, "src", "dst").distinct()
    sides = [written(e, "edges", grows=True)]
    sides.append(sides[0] if undirected else written(e.select(key, F.col("dst").alias("src"), F.col("src").alias("dst")), "edges", grows=True))
    asked = pairs.select(key, "i", "j").distinct()
    open_ = written(asked.where("i <> j"), "pairs", grows=True)
    found = [asked.where("i = j").withColumn("dist", F.lit(0))]
    ends = ["i", "j"]
    front = [written(open_.select(key, F.col(c).alias("root"), F.col(c).alias("node")).distinct(), "front", grows=True) for c in ends]
    past: list[list[DataFrame]] = [[], []]          # earlier frontiers of each side
    hops = 0
    while limit is None or hops < limit:
        size = [f.count() for f in front]
        if not min(size) or open_.isEmpty():
            break
        s = 0 if size[0] <= size[1] else 1
        seen = [front[s], *(past[s][-1:] if undirected else past[s])]
        live = front[s].join(open_.select(key, F.col(ends[s]).alias("root")).distinct(), [key, "root"], "left_semi")
        new = (live.join(sides[s].withColumnRenamed("src", "node"), [key, "node"])
               .select(key, "root", F.col("dst").alias("node")).distinct())
        for level in seen:
            new = new.join(level, [key, "root", "node"], "left_anti")
        past[s].append(front[s])
        front[s] = written(new, "front", grows=True)
        hops += 1
        a, b = (f.select(key, F.col("root").alias(c), "node") for f, c in zip(front, ends, strict=True))
        met = written(open_.join(a, [key, "i"]).join(b, [key, "j", "node"], "left_semi").select(key, "i", "j").distinct(), "met", grows=True)
        found.append(met.withColumn("dist", F.lit(hops)))
        open_ = written(open_.join(met, [key, "i", "j"], "left_anti"), "pairs", grows=True)
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    return known


def largest_distance(edges: DataFrame, nodes: DataFrame, key: str = "g", far: int = UNREACHABLE_APSP) -> DataFrame:
    """One row ``max_dist``: the largest hop distance between two nodes of the
    same graph, over all (undirected) graphs; ``far`` if two nodes of a graph
    are not connected, null without nodes.

    Every node's largest distance lies between bounds. A round searches from a
    few nodes (four at most) of each graph that may still hold the answer: a node
    at distance d of a root with largest distance r has one of at least
    max(d, r - d) and at most r + d. Nodes whose upper bound does not pass the
    best lower bound of all graphs are out; a few rounds close the rest. Rounds
    write one row a node; the driver reads the best bound and whether a graph is
    disconnected."""
    size = nodes.groupBy(key).agg(F.countDistinct("node").alias("_n"))
    bounds = written(nodes.select(key, "node").distinct().join(size, key).select(
        key, "node", "_n", F.lit(0).alias("low"), (F.col("_n") - 1).cast("int").alias("high")), "bounds", grows=True)
    edges = written(edges.select(key, "src", "dst").distinct(), "edges", grows=True)
    rounds = 0
    while True:
        best = bounds.agg(F.max("low")).first()[0]
        open_ = bounds.where(F.col("high") > F.lit(best if best is not None else 0))
        # nodes that may be the farthest, by three ties, and the one that seems the most central
        node, far_off = F.col("node"), [F.struct("high", -F.col("node")), F.struct("high", "node"), F.struct("high", F.xxhash64("node"))]
        picks = F.array_distinct(F.array(*[F.max_by(node, t) for t in far_off], F.min_by(node, F.struct("high", F.xxhash64("node")))))
        roots = written(open_.groupBy(key).agg(picks.alias("root")).select(key, F.explode("root").alias("root")), "roots", grows=True)
        if roots.isEmpty():
            break
        start = roots.select(key, "root", F.col("root").alias("node"))
        reach = written(frontiers(edges, start, key, "root", "node", "d"), "reach", grows=True)
        ecc = reach.groupBy(key, "root").agg(F.max("d").alias("_e"), F.count(F.lit(1)).alias("_r"))
        if rounds == 0 and not bounds.select(key, "_n").distinct().join(ecc, key).where("_r < _n").isEmpty():
            return bounds.sparkSession.range(1).select(F.lit(far).cast("int").alias("max_dist"))
        d, e = F.col("d"), F.col("_e")
        near = reach.join(ecc, [key, "root"]).groupBy(key, "node").agg(
            F.max(F.greatest(d, e - d)).alias("_low"), F.min(e + d).alias("_high"))
        bounds = written(bounds.join(near, [key, "node"], "left").select(
            key, "node", "_n", F.greatest("low", "_low").alias("low"), F.least("high", "_high").alias("high")), "bounds", grows=True)
        rounds += 1
    return bounds.agg(F.max("low").alias("max_dist"))
