"""Distances of requested pairs, largest distances and hub-safe propagation
against plain Python on random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from assaylake.operators import distances as DI
from assaylake.operators import graph as G


def _bfs(adj, i):
    dist, queue = {i: 0}, deque([i])
    while queue:
        u = queue.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    return dist


def _random_graph(seed, n, m, directed=False):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    if not directed:
        edges |= {(b, a) for a, b in edges}
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
    return sorted(edges), adj


@pytest.mark.parametrize("directed", [False, True])
def test_requested_pairs(spark, directed):
    rows, want, asked = [], {}, []
    for g in range(2):
        edges, adj = _random_graph(10 * g + directed, 30, 40, directed)
        rows += [(g, a, b) for a, b in edges]
        rng = random.Random(g)
        for _ in range(25):
            i, j = rng.randrange(30), rng.randrange(33)         # nodes above 29 do not exist
            asked.append((g, i, j))
            want[g, i, j] = _bfs(adj, i).get(j)
    e = spark.createDataFrame(rows, "g int, src int, dst int")
    p = spark.createDataFrame([*asked, asked[0], (0, None, 1), (9, 1, 2), (9, 4, 4)], "g int, i int, j int").withColumn("note", F.lit("kept"))
    for limit, far in ((None, 510), (2, 9999)):
        got = DI.pair_distances(e, p, limit=limit, far=far, undirected=not directed).collect()
        assert len(got) == len(asked) + 4 and all(r["note"] == "kept" for r in got)
        for r in got:
            d = want.get((r["g"], r["i"], r["j"]), 0 if r["i"] == r["j"] == 4 else None)
            assert r["dist"] == (d if d is not None and (limit is None or d <= limit) else far)
    assert DI.pair_distances(e, p.limit(0)).count() == 0
    assert {r["dist"] for r in DI.pair_distances(e.limit(0), p).collect()} == {510, 0} | ({0} if any(i == j for _, i, j in asked) else set())


def test_long_chain_is_met_in_the_middle(spark):
    e = spark.createDataFrame([(0, a, b) for i in range(11) for a, b in ((i, i + 1), (i + 1, i))], "g int, src int, dst int")
    p = spark.createDataFrame([(0, 0, 11), (0, 11, 3)], "g int, i int, j int")
    assert sorted(r["dist"] for r in DI.pair_distances(e, p).collect()) == [8, 11]


def test_largest_distance_of_connected_and_broken_graphs(spark):
    nodes, edges, best = [], [], 0
    for g in range(4):
        n = 5 + 3 * g
        rng = random.Random(g)
        links = {(i, rng.randrange(max(0, i - 3), i)) for i in range(1, n)}      # one component
        links |= {(b, a) for a, b in links}
        adj = defaultdict(set)
        for a, b in links:
            adj[a].add(b)
        best = max(best, max(max(_bfs(adj, i).values()) for i in range(n)))
        nodes += [(g, i) for i in range(n)]
        edges += [(g, a, b) for a, b in sorted(links)]
    nd = spark.createDataFrame([*nodes, (99, 0)], "g int, node int")
    ed = spark.createDataFrame(edges, "g int, src int, dst int")
    assert DI.largest_distance(ed, nd).first()[0] == best
    assert DI.largest_distance(ed, nd.unionAll(spark.createDataFrame([(0, 50)], "g int, node int"))).first()[0] == 510
    assert DI.largest_distance(ed, nd.limit(0)).first()[0] is None
    assert DI.largest_distance(ed.limit(0), nd.where("g = 99")).first()[0] == 0


def test_all_pairs_of_a_large_graph_are_refused(spark):
    nodes = spark.range(40).select(F.lit(0).alias("g"), F.col("id").cast("int").alias("node"))
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "g int, src int, dst int")
    for made in (G.all_pairs, G.shortest_paths):
        with pytest.raises(ValueError, match="40 nodes"):
            made(edges, nodes, max_nodes=39)
    assert G.all_pairs(edges, nodes, max_nodes=40).count() == 42


def test_hub_on_a_third_of_all_edges(spark):
    rng = random.Random(8)
    n = 900
    one = {(0, rng.randrange(1, n)) for _ in range(700)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(900)}
    edges = sorted(one | {(b, a) for a, b in one})
    x = [rng.randrange(-9, 10) / 4 for _ in range(n)]
    e = spark.createDataFrame([(0, a, b, "r" if (a + b) % 3 else "s", (a % 7) / 10) for a, b in edges], "g int, src int, dst int, rel string, ex double")
    f = spark.createDataFrame([(0, i, 0, v) for i, v in enumerate(x)], "g int, node int, dim int, x double")
    s = G.spread(e)
    assert 0 in {r["src"] for r in s.hubs.collect()} and s.hubs.count() < G.HUBS
    lanes = s.with_source(f).where("src = 0").groupBy("_lane").count().collect()
    assert len(lanes) == G.LANES and s.with_source(f).count() == len(edges)
    into = defaultdict(list)
    for a, b in edges:
        into[b].append(a)
    deg = {i: len(into[i]) + 1 for i in range(n)}

    def got(df):
        return {r["node"]: r["x"] for r in df.collect()}
    total, mean, norm = got(G.neighbor_sum(f, e)), got(G.neighbor_mean(f, e)), got(G.neighbor_symnorm(f, e))
    att = got(G.edge_attention(f, e.withColumn("score", F.col("ex"))))
    import math
    for i in range(n):
        assert total[i] == pytest.approx(x[i] + sum(x[a] for a in into[i]))
        assert mean[i] == pytest.approx((x[i] + sum(x[a] for a in into[i])) / deg[i])
        assert norm[i] == pytest.approx(x[i] / deg[i] + sum(x[a] / math.sqrt(deg[a] * deg[i]) for a in into[i]))
        want = 0.0
        for rel in "rs":
            w = [(math.exp((a % 7) / 10), x[a]) for a in into[i] if ("r" if (a + i) % 3 else "s") == rel]
            want += sum(p * v for p, v in w) / sum(p for p, _ in w) if w else 0.0
        if into[i]:
            assert att[i] == pytest.approx(want)
