"""Rounds of small graphs in a task agree with rounds of joins, and tables that
grow are never broadcast by the size of their files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assaylake.functions.hashing import hash32, hash32_of
from assaylake.operators import distances as DI
from assaylake.operators import graph as G
from assaylake.operators import small_graphs as SG
from assaylake.operators import tokens as TK
from assaylake.operators.lookup import lookup
from assaylake.plans.registry import QUERIES, load_all
from assaylake.session import by_rows, parts_for, written

from .conftest import SF_SMALL

load_all()


def odd_graphs(spark, directed=False):
    rnd = random.Random(5)
    edges = []
    for g in range(12):
        for _ in range(2 * g):
            a, b = rnd.randrange(g + 1), rnd.randrange(g + 1)
            edges += [(g, a, b)] if directed else [(g, a, b), (g, b, a)]
    edges += edges[:9] + [(None, 0, 1), (3, None, 1), (4, -1, 2), (4, 2, -1)]
    nodes = [(g, n) for g in range(14) for n in range(g + 1)] + [(5, 1), (None, 0), (6, None), (20, 3)]
    return spark.createDataFrame(edges, "g int, src int, dst int"), spark.createDataFrame(nodes, "g int, node int")


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("limit", [None, 0, 2])
@pytest.mark.parametrize("bound", [0, 20, 1000])
def test_rounds_of_small_and_large_graphs(spark, monkeypatch, directed, limit, bound):
    monkeypatch.setattr(G, "SMALL_EDGES", bound)
    monkeypatch.setattr(SG, "SLICE_PAIRS", 40)
    edges, nodes = odd_graphs(spark, directed)
    start = nodes.select("g", F.col("node").alias("i"), F.col("node").alias("j"))
    args = (edges, start, "g", "i", "j", "d", limit, not directed)
    new, old = G.frontiers(*args), G.joined_frontiers(*args)
    assert new.dtypes == old.dtypes
    assert rows(new, *old.columns) == rows(old, *old.columns)


def test_growing_tables_are_not_broadcast(spark):
    few = spark.range(50).select(F.col("id").alias("k"))
    many = written(few, "many", grows=True).select("k", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("x")).groupBy("k").count()
    plan = few.join(many, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_parts_follow_rows(spark, monkeypatch):
    monkeypatch.setattr("assaylake.session.TASK_ROWS", 10)
    assert parts_for(spark, 0) == spark.sparkContext.defaultParallelism
    assert by_rows(spark.range(200), "id").groupBy("id").count().rdd.getNumPartitions() == 20


@pytest.mark.parametrize("bound", [0, 20, 1000])
def test_samples_of_small_and_large_graphs(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "SMALL_EDGES", bound)
    monkeypatch.setattr(SG, "SLICE_PAIRS", 40)
    edges, nodes = odd_graphs(spark)
    roots = nodes.select("g", F.col("node").alias("root"))
    new, old = (f(edges, roots, 3, 2, "g", 1) for f in (G.sample_k_hop, G.joined_samples))
    assert new.dtypes == old.dtypes
    assert rows(new, *old.columns) == rows(old, *old.columns)


def test_hash_inside_a_task_is_that_of_spark(spark):
    df = spark.createDataFrame([(0, "a"), (-7, ""), (1 << 40, "ü")], "n long, s string")
    for n, s, a, b in df.select("n", "s", hash32("n", seed=3), hash32("s", "n", seed=4)).collect():
        assert (a, b) == (hash32_of(n, seed=3), hash32_of(s, n, seed=4))


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("limit,bound", [(None, 0), (None, 20), (None, 1000), (2, 1000)])
def test_paths_of_small_and_large_graphs(spark, monkeypatch, directed, limit, bound):
    monkeypatch.setattr(G, "SMALL_EDGES", bound)
    monkeypatch.setattr(SG, "SLICE_PAIRS", 40)
    edges, nodes = odd_graphs(spark, directed)
    edges = edges.withColumn("f", F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst"), F.lit("x")))
    edges = edges.unionByName(edges.where("src = 1").withColumn("f", F.lit("second")))
    new = G.shortest_paths(edges, nodes, max_rounds=limit, undirected=not directed, feat="f")
    old = G.joined_paths(edges, nodes, max_rounds=limit, undirected=not directed)
    assert rows(new, "g", "i", "j", "path", "dist") == rows(old, "g", "i", "j", "path", "dist")
    for most in (None, 1):
        a, b = (G.path_edges(p, edges, most, feat="f") for p in (new, old))
        assert a.dtypes == b.dtypes
        assert rows(a, *b.columns) == rows(b, *b.columns)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Repetitive rows are not coalesced into few tasks by their compressed bytes."""
    monkeypatch.setattr("assaylake.session.TASK_ROWS", 100)
    tokens = spark.range(300).select(F.col("id").alias("m"), F.explode(F.expr("sequence(0L, 9L)")).alias("pos"), F.lit("C").alias("token"))
    vocab = spark.createDataFrame([("C", 2)], "token string, id long")
    assert TK.encode_pad(tokens, vocab, "m").rdd.getNumPartitions() == 30
    assert TK.context_window(tokens.withColumn("id", F.lit(2)), "m", "pos", "id").rdd.getNumPartitions() == 30
    words = spark.range(50).select(F.concat(F.lit("w"), "id").alias("v"), "id")
    named = lookup(tokens.select("m", F.concat(F.lit("w"), F.col("m") % 60).alias("v")), words, "v", "left", max_rows=10)
    assert named.rdd.getNumPartitions() == 30
    assert named.count() == 3000 and named.where("id is null").count() == 500


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("limit,bound", [(None, 20), (2, 1000)])
def test_distances_of_small_and_large_graphs(spark, monkeypatch, directed, limit, bound):
    monkeypatch.setattr(G, "SMALL_EDGES", bound)
    monkeypatch.setattr(SG, "SLICE_PAIRS", 40)
    edges, _ = odd_graphs(spark, directed)
    rnd = random.Random(9)
    pairs = [(rnd.randrange(14), rnd.randrange(13), rnd.randrange(13), t) for t in range(150)] + [(None, 1, 1, 0), (2, None, 1, 1), (2, 1, None, 1), (4, -1, 2, 1)]
    pairs = spark.createDataFrame(pairs + pairs[:5], "g int, i int, j int, t int")
    new = DI.pair_distances(edges, pairs, limit=limit, far=77, undirected=not directed)
    old = pairs.join(DI.joined_distances(edges, pairs, limit=limit, undirected=not directed), ["g", "i", "j"], "left").fillna(77, ["dist"])
    assert rows(new, "g", "i", "j", "t", "dist") == rows(old, "g", "i", "j", "t", "dist")


def test_marks_of_small_and_large_graphs(spark, monkeypatch):
    """small graphs make their rows in a task, without lanes and joins."""
    monkeypatch.setattr(SG, "SLICE_PAIRS", 40)
    edges, nodes = odd_graphs(spark)
    marks = [(g, s, p, n) for g in range(14) for s, p, n in ((0, 0, 0), (0, 1, g // 2), (1, 0, g + 3), (1, 0, 0))]
    marks += [(5, 1, 1, None), (None, 0, 0, 0), (6, 0, 0, 2), (6, 0, 0, 2), (20, 0, 0, 3), (30, 0, 0, 0)]
    marks = spark.createDataFrame(marks, "g int, set_id int, piece int, node int")
    old = G.joined_marks(nodes, edges, marks, 2)
    want = rows(old, *old.columns)
    for bound in (1000, 30):
        monkeypatch.setattr(G, "SMALL_EDGES", bound)
        new = G.distance_to_marks(nodes, edges, marks, 2)
        assert new.dtypes == old.dtypes
        assert rows(new, *old.columns) == want
    plain = edges.where("src >= 0 and dst >= 0 and g is not null")
    monkeypatch.setattr(G, "SMALL_EDGES", 1000)
    plan = G.distance_to_marks(nodes, plain, marks, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def parts_of(df, *cols):
    """Numbers of parts in which the plan deals ``cols``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = ", ".join(rf"{c}#\d+L?" for c in cols)
    return [int(n) for n in re.findall(rf"hashpartitioning\({keys}, (\d+)\)", plan)]


def test_neighbour_sums_are_dealt_by_rows(spark, monkeypatch):
    """both sides of the join of near nodes and their values."""
    monkeypatch.setattr("assaylake.session.TASK_ROWS", 700)
    df = QUERIES["nested_reduce"](spark, SF_SMALL)
    parts = parts_of(df, "mol_id", "node")
    assert len(parts) == 3 and len(set(parts)) == 1 and parts[0] > 4


def test_edges_are_dealt_by_rows(spark, monkeypatch):
    """edges meet their sources in parts of ``TASK_ROWS``."""
    monkeypatch.setattr("assaylake.session.TASK_ROWS", 100)
    edges = spark.range(1000).selectExpr("id * 0 as g", "id as src", "id % 7 as dst", "0 as rel", "0.5D as ex")
    feats = spark.range(1000).selectExpr("id * 0 as g", "id as node", "0 as dim", "1.0D as x")
    df = G.relation_mean(feats, edges)
    assert set(parts_of(df, "g", "src", "_lane")) == {10}
    assert rows(df, "node", "x") == rows(spark.range(7).selectExpr("id as node", "1.5D as x"), "node", "x")
