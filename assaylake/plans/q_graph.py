"""Registered graph queries.

Two graph inputs: the molecule graphs (key ``mol_id``, from the parsed
structure strings) and one big bipartite supplier-part graph from
``lineitem`` (constant key ``g``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32, sql_hash32
from ..operators import distances as DI
from ..operators import graph as G
from ..operators import molecules as MO
from ..operators.ranking import placed
from ..operators.tokens import ELEMENTS_SQL
from ..session import by_rows, written
from ..sources import tables as S
from .common import r, r_off_halves, rounded, rounded_off_halves
from .q_molecules import with_graph
from .registry import query, with_ctes

K = "mol_id"


def mol_nodes_edges(spark, sf):
    """Molecule graphs as node and (symmetric) edge tables, written once:
    every graph operator reads them several times, so the structure parse
    runs once instead of once per reference."""
    atoms, bonds = MO.mol_graph(S.molecules(spark, sf), both_directions=True)
    nodes = written(atoms.select(K, F.col("atom").alias("node"), "symbol", "aromatic", "charge"), "nodes", grows=True)
    edges = written(bonds.select(K, "src", "dst", "bond_order"), "edges", grows=True)
    return nodes, edges


MNODES = "SELECT mol_id, atom AS node FROM gatoms"
MEDGES = "SELECT mol_id, src, dst, bond_order FROM bonds2"


# ---- bipartite graph ----------------------------------------------------------

def bip(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    e1 = li.groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"),
                    F.col("l_returnflag").alias("rel")).agg(F.count(F.lit(1)).alias("cnt"))
    e = G.symmetrize(e1).withColumn("g", F.lit(0)).withColumn("ex", F.log1p("cnt") / F.lit(10.0))
    sup = S.table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("node"),
                                                (F.col("s_acctbal") / 1000.0).alias("v"))
    prt = S.table(spark, sf, "part").select((F.col("p_partkey") * 2 + 1).alias("node"),
                                            (F.col("p_retailprice") / 1000.0).alias("v"))
    nodes = sup.unionByName(prt).withColumn("g", F.lit(0))
    feats = nodes.select("g", "node", F.explode(F.array(
        F.struct(F.lit(0).alias("dim"), F.col("v").alias("x")),
        F.struct(F.lit(1).alias("dim"), F.lit(1.0).alias("x")))).alias("f")).select("g", "node", "f.dim", "f.x")
    return nodes, e, feats


BIP = {
    "be1": """SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_returnflag AS rel, count(*) AS cnt
              FROM lineitem GROUP BY 1, 2, 3""",
    "be": """SELECT 0 AS g, src, dst, rel, cnt, ln(1 + cnt) / 10.0 AS ex FROM be1
             UNION ALL SELECT 0 AS g, dst, src, rel, cnt, ln(1 + cnt) / 10.0 AS ex FROM be1""",
    "bn": """SELECT 0 AS g, s_suppkey * 2 AS node, s_acctbal / 1000.0 AS v FROM supplier
             UNION ALL SELECT 0 AS g, p_partkey * 2 + 1 AS node, p_retailprice / 1000.0 AS v FROM part""",
    "bf": "SELECT g, node, 0 AS dim, v AS x FROM bn UNION ALL SELECT g, node, 1 AS dim, 1.0 AS x FROM bn",
}


@query("graph_from_edges", with_ctes("""
SELECT n.node, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.c, 0) AS BIGINT) AS in_degree
FROM bn n LEFT JOIN (SELECT src, count(*) AS c FROM be1 GROUP BY src) o ON n.node = o.src
LEFT JOIN (SELECT dst, count(*) AS c FROM be1 GROUP BY dst) i ON n.node = i.dst""", **BIP))
def q_graph_from_edges(spark, sf):
    nodes, e, _ = bip(spark, sf)
    one_dir = e.where(F.col("src") % 2 == 0)  # supplier -> part direction
    d = G.degree_table(nodes, one_dir, key="g")
    return d.select("node", F.col("out_degree").cast("bigint"), F.col("in_degree").cast("bigint"))


@query("degree", with_graph("""
SELECT g.mol_id, g.atom AS node, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree, CAST(coalesce(o.c, 0) AS BIGINT) AS in_degree
FROM gatoms g LEFT JOIN (SELECT mol_id, src, count(*) AS c FROM bonds2 GROUP BY mol_id, src) o
  ON g.mol_id = o.mol_id AND g.atom = o.src"""))
def q_degree(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    d = G.degree_table(nodes, edges, key=K)
    return d.select(K, "node", F.col("out_degree").cast("bigint"), F.col("in_degree").cast("bigint"))


REL_SQL = "CASE bond_order WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END"


@query("symmetrize", with_graph(f"""
SELECT mol_id, src, dst, {REL_SQL} AS rel FROM bonds
UNION ALL SELECT mol_id, dst AS src, src AS dst, {REL_SQL} + 4 AS rel FROM bonds"""))
def q_symmetrize(spark, sf):
    _, bonds = MO.mol_graph(S.molecules(spark, sf))
    rel = F.when(F.col("bond_order") == 1, 0).when(F.col("bond_order") == 2, 1).when(
        F.col("bond_order") == 3, 2).otherwise(3)
    e = bonds.select(K, "src", "dst", rel.alias("rel"))
    return G.symmetrize(e, num_rels=4)


@query("adjacency_by_relation", with_ctes("""
SELECT relation, head AS src, tail AS dst, count(*) AS n_edges FROM t GROUP BY relation, head, tail""",
                                          t=S.TRIPLES_SQL))
def q_adjacency(spark, sf):
    t = S.triples(spark, sf)
    # long adjacency per relation: no neighbour list is collected into one row
    return t.groupBy("relation", F.col("head").alias("src"), F.col("tail").alias("dst")).agg(
        F.count(F.lit(1)).alias("n_edges"))


def _walk_sql(max_d: int) -> str:
    return f"""
SELECT mol_id, node AS root, node, 0 AS d FROM mnodes
UNION
SELECT w.mol_id, w.root, e.dst AS node, w.d + 1 AS d FROM walks w JOIN medges e ON w.mol_id = e.mol_id AND w.node = e.src
WHERE w.d < {max_d}"""


@query("k_hop_neighbors", with_graph("""
SELECT mol_id, root, node, CAST(min(d) AS INTEGER) AS hop FROM walks GROUP BY mol_id, root, node""",
                                     mnodes=MNODES, medges=MEDGES, walks=_walk_sql(3)))
def q_k_hop(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    roots = nodes.select(K, F.col("node").alias("root"))
    return G.k_hop(edges, roots, 3, key=K).withColumn("hop", F.col("hop").cast("int"))


BLOCK_CTES = dict(
    mnodes=MNODES, medges=MEDGES,
    blk="SELECT mol_id, src AS root, min(dst) AS node FROM medges GROUP BY mol_id, src",
    b0="SELECT mol_id, node AS root, node FROM mnodes",
    b1="""SELECT DISTINCT f.mol_id, f.root, e.dst AS node FROM b0 f JOIN medges e ON f.mol_id = e.mol_id AND f.node = e.src
          WHERE e.dst <> f.root AND NOT EXISTS (SELECT 1 FROM blk WHERE blk.mol_id = f.mol_id AND blk.root = f.root
                                                                    AND blk.node = e.dst)""",
    b2="""SELECT DISTINCT f.mol_id, f.root, e.dst AS node FROM b1 f JOIN medges e ON f.mol_id = e.mol_id AND f.node = e.src
          WHERE e.dst <> f.root AND NOT EXISTS (SELECT 1 FROM b1 v WHERE v.mol_id = f.mol_id AND v.root = f.root
                                                                    AND v.node = e.dst)""",
    b3="""SELECT DISTINCT f.mol_id, f.root, e.dst AS node FROM b2 f JOIN medges e ON f.mol_id = e.mol_id AND f.node = e.src
          WHERE e.dst <> f.root
            AND NOT EXISTS (SELECT 1 FROM b1 v WHERE v.mol_id = f.mol_id AND v.root = f.root AND v.node = e.dst)
            AND NOT EXISTS (SELECT 1 FROM b2 v WHERE v.mol_id = f.mol_id AND v.root = f.root AND v.node = e.dst)""",
)


@query("k_hop_blocked", with_graph("""
SELECT mol_id, root, node, 0 AS hop FROM b0 UNION ALL SELECT mol_id, root, node, 1 FROM b1
UNION ALL SELECT mol_id, root, node, 2 FROM b2 UNION ALL SELECT mol_id, root, node, 3 FROM b3""", **BLOCK_CTES))
def q_k_hop_blocked(spark, sf):
    """k-hop sets where each root's smallest neighbour is blocked at hop 1
    and released afterwards (it may then appear at hop 2 or later)."""
    nodes, edges = mol_nodes_edges(spark, sf)
    roots = nodes.select(K, F.col("node").alias("root"))
    block = edges.groupBy(K, F.col("src").alias("root")).agg(F.min("dst").alias("node"))
    return G.k_hop(edges, roots, 3, key=K, block=block).withColumn("hop", F.col("hop").cast("int"))


def _cap_sql(prev_front: str, visited: str, h: int, cap: int, seed: int) -> str:
    return f"""
SELECT mol_id, root, node FROM (
  SELECT mol_id, root, node, row_number() OVER (PARTITION BY mol_id, root
           ORDER BY {sql_hash32('node', seed=seed)}, node) AS rk
  FROM (SELECT DISTINCT f.mol_id, f.root, e.dst AS node FROM {prev_front} f
        JOIN medges e ON f.mol_id = e.mol_id AND f.node = e.src) nx
  WHERE NOT EXISTS (SELECT 1 FROM {visited} v WHERE v.mol_id = nx.mol_id AND v.root = nx.root AND v.node = nx.node)) z
WHERE rk <= {cap}"""


def _new_sql(prev_front: str, visited: str) -> str:
    return f"""
SELECT DISTINCT f.mol_id, f.root, e.dst AS node FROM {prev_front} f JOIN medges e ON f.mol_id = e.mol_id AND f.node = e.src
WHERE NOT EXISTS (SELECT 1 FROM {visited} v WHERE v.mol_id = f.mol_id AND v.root = f.root AND v.node = e.dst)"""


SAMPLE_CTES = dict(
    mnodes=MNODES, medges=MEDGES,
    v0="SELECT mol_id, node AS root, node FROM mnodes",
    f1=_cap_sql("v0", "v0", 1, 2, 1),
    v1="SELECT * FROM v0 UNION SELECT * FROM (" + _new_sql("v0", "v0") + ") a",
    f2=_cap_sql("f1", "v1", 2, 2, 2),
    v2="SELECT * FROM v1 UNION SELECT * FROM (" + _new_sql("f1", "v1") + ") b",
    f3=_cap_sql("f2", "v2", 3, 2, 3),
)


@query("sample_k_hop", with_graph("""
SELECT mol_id, root, node, 0 AS hop FROM v0 UNION ALL SELECT mol_id, root, node, 1 FROM f1
UNION ALL SELECT mol_id, root, node, 2 FROM f2 UNION ALL SELECT mol_id, root, node, 3 FROM f3""", **SAMPLE_CTES))
def q_sample_k_hop(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    roots = nodes.select(K, F.col("node").alias("root"))
    return G.sample_k_hop(edges, roots, 3, cap=2, key=K, seed=0).withColumn("hop", F.col("hop").cast("int"))


@query("frontier_cap", with_graph("SELECT mol_id, root, node FROM f1", **SAMPLE_CTES))
def q_frontier_cap(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    roots = nodes.select(K, F.col("node").alias("root"))
    hop1 = G.k_hop(edges, roots, 1, key=K).where("hop = 1").select(K, "root", "node")
    return G.cap_per_root(hop1, 2, [K, "root"], seed=1)


@query("frontier_difference", with_graph("""
SELECT mol_id, node, 1 AS step FROM (SELECT DISTINCT e.mol_id, e.dst AS node FROM medges e WHERE e.src = 0 AND e.dst <> 0) a
UNION ALL
SELECT mol_id, node, 2 AS step FROM (
  SELECT DISTINCT e.mol_id, e.dst AS node FROM medges e JOIN medges f ON e.mol_id = f.mol_id AND e.src = f.dst
  WHERE f.src = 0 AND e.dst <> 0 AND NOT EXISTS (SELECT 1 FROM medges h WHERE h.mol_id = e.mol_id AND h.src = 0 AND h.dst = e.dst)) b""",
                                         mnodes=MNODES, medges=MEDGES))
def q_frontier_difference(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    roots = nodes.where("node = 0").select(K, F.col("node").alias("root"))
    kh = G.k_hop(edges, roots, 2, key=K).where("hop > 0")
    return kh.select(K, "node", F.col("hop").alias("step"))


@query("all_pairs_shortest_path", with_graph("""
SELECT mol_id, root AS i, node AS j, CAST(min(d) AS INTEGER) AS dist FROM walks GROUP BY mol_id, root, node""",
                                             mnodes=MNODES, medges=MEDGES, walks=_walk_sql(26)))
def q_all_pairs(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    return G.all_pairs(edges, nodes, key=K).withColumn("dist", F.col("dist").cast("int"))


@query("pair_features", with_graph("""
SELECT a.mol_id, a.i, a.j, a.dist, CAST(coalesce(e.bond_order, 0) AS INTEGER) AS edge_type, CAST(dg.c AS BIGINT) AS degree_j
FROM (SELECT mol_id, root AS i, node AS j, CAST(min(d) AS INTEGER) AS dist FROM walks GROUP BY mol_id, root, node) a
LEFT JOIN medges e ON a.mol_id = e.mol_id AND a.i = e.src AND a.j = e.dst
JOIN (SELECT g.mol_id, g.node, count(e2.dst) AS c FROM mnodes g LEFT JOIN medges e2 ON g.mol_id = e2.mol_id AND g.node = e2.src
      GROUP BY g.mol_id, g.node) dg ON a.mol_id = dg.mol_id AND a.j = dg.node""",
                                   mnodes=MNODES, medges=MEDGES, walks=_walk_sql(26)))
def q_pair_features(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    ap = G.all_pairs(edges, nodes, key=K)
    deg = G.degree_table(nodes, edges, key=K).select(K, F.col("node").alias("j"), F.col("out_degree").alias("degree_j"))
    et = edges.select(K, F.col("src").alias("i"), F.col("dst").alias("j"), F.col("bond_order").alias("edge_type"))
    # an edge joins nodes at distance 1, or a node with itself: no other pair has to meet the edges
    ap = written(ap, "pairs", grows=True)
    near = ap.where("dist <= 1").join(et, [K, "i", "j"], "left")
    out = near.unionByName(ap.where("dist > 1"), allowMissingColumns=True).join(deg, [K, "j"])
    return out.select(K, "i", "j", F.col("dist").cast("int"), F.coalesce("edge_type", F.lit(0)).cast("int").alias("edge_type"),
                      F.col("degree_j").cast("bigint"))


def _marks(spark, sf, nodes):
    n = nodes.groupBy(K).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return G.random_marks(n, 2, 2, key=K, seed=17)


MARKS_SQL = f"""
SELECT c.mol_id, s AS set_id, p AS piece,
       CAST({sql_hash32('c.mol_id', 's', 'p', seed=17)} % c.n AS INTEGER) AS node
FROM (SELECT mol_id, count(*) AS n FROM mnodes GROUP BY mol_id) c, generate_series(0, 1) AS a(s), generate_series(0, 1) AS b(p)"""


@query("random_marks", with_graph("SELECT mol_id, CAST(set_id AS INTEGER) AS set_id, CAST(piece AS INTEGER) AS piece, node FROM marks",
                                  mnodes=MNODES, marks=MARKS_SQL))
def q_random_marks(spark, sf):
    nodes, _ = mol_nodes_edges(spark, sf)
    return _marks(spark, sf, nodes)


@query("marking_one_hot", with_graph("""
SELECT n.mol_id, CAST(s.set_id AS INTEGER) AS set_id, n.node,
       CASE WHEN EXISTS (SELECT 1 FROM marks m WHERE m.mol_id = n.mol_id AND m.set_id = s.set_id AND m.node = n.node)
            THEN -1 ELSE 1 END AS mark
FROM mnodes n JOIN (SELECT DISTINCT mol_id, set_id FROM marks) s ON n.mol_id = s.mol_id""",
                                     mnodes=MNODES, marks=MARKS_SQL))
def q_marking_one_hot(spark, sf):
    nodes, _ = mol_nodes_edges(spark, sf)
    return G.marking_matrix(nodes, _marks(spark, sf, nodes), key=K)


def _dist_marks_sql(hop: int, far: int) -> str:
    return f"""
SELECT m.mol_id, CAST(m.set_id AS INTEGER) AS set_id, CAST(m.piece AS INTEGER) AS piece, n.node,
       CAST(coalesce(w.d, {far}) AS INTEGER) AS dist
FROM marks m JOIN mnodes n ON m.mol_id = n.mol_id
LEFT JOIN (SELECT mol_id, root, node, min(d) AS d FROM walks GROUP BY mol_id, root, node) w
  ON w.mol_id = m.mol_id AND w.root = m.node AND w.node = n.node"""


@query("distance_to_marks", with_graph(_dist_marks_sql(2, 9999), mnodes=MNODES, medges=MEDGES, marks=MARKS_SQL,
                                       walks=_walk_sql(2)))
def q_distance_to_marks(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    d = G.distance_to_marks(nodes, edges, _marks(spark, sf, nodes), hop=2, key=K)
    return d.select(K, "set_id", "piece", "node", F.col("dist").cast("int"))


@query("capped_shortest_distance", with_graph(_dist_marks_sql(6, 9999), mnodes=MNODES, medges=MEDGES,
                                              marks=MARKS_SQL, walks=_walk_sql(6)))
def q_capped_distance(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    d = G.distance_to_marks(nodes, edges, _marks(spark, sf, nodes), hop=6, key=K)
    return d.select(K, "set_id", "piece", "node", F.col("dist").cast("int"))


# ---- propagation on the bipartite graph ---------------------------------------

@query("neighbor_sum", with_ctes(f"""
SELECT f.node, f.dim, {r("f.x + coalesce(m.s, 0.0)")} AS x
FROM bf f LEFT JOIN (SELECT e.dst AS node, f2.dim, sum(f2.x) AS s FROM be e JOIN bf f2 ON e.src = f2.node
                     GROUP BY e.dst, f2.dim) m ON f.node = m.node AND f.dim = m.dim""", **BIP))
def q_neighbor_sum(spark, sf):
    _, e, feats = bip(spark, sf)
    return rounded(G.neighbor_sum(feats, e, key="g").select("node", "dim", "x"))


@query("neighbor_mean", with_ctes(f"""
SELECT node, dim, {r_off_halves("sum(w * x) / sum(w)")} AS x FROM (
  SELECT e.dst AS node, f.dim, CAST(e.cnt AS DOUBLE) AS w, f.x FROM be e JOIN bf f ON e.src = f.node
  UNION ALL SELECT node, dim, 1.0 AS w, x FROM bf) t GROUP BY node, dim""", **BIP))
def q_neighbor_mean(spark, sf):
    _, e, feats = bip(spark, sf)
    e = e.withColumn("w", F.col("cnt").cast("double"))
    return rounded_off_halves(G.neighbor_mean(feats, e, key="g", weight="w").select("node", "dim", "x"), "x")


@query("neighbor_symnorm", with_ctes(f"""
SELECT a.dst AS node, f.dim, {r("sum(f.x / sqrt(ds.d * dd.d))")} AS x
FROM ae a JOIN dg ds ON a.src = ds.node JOIN dg dd ON a.dst = dd.node JOIN bf f ON a.src = f.node
GROUP BY a.dst, f.dim""", **BIP, ae="SELECT src, dst FROM be UNION ALL SELECT DISTINCT node, node FROM bf",
                                     dg="SELECT dst AS node, count(*) AS d FROM ae GROUP BY dst"))
def q_neighbor_symnorm(spark, sf):
    _, e, feats = bip(spark, sf)
    return rounded(G.neighbor_symnorm(feats, e, key="g").select("node", "dim", "x"))


@query("edge_feature_sum", with_ctes(f"""
SELECT e.dst AS node, f.dim, {r("sum(greatest(f.x + e.ex, 0.0))")} AS x FROM be e JOIN bf f ON e.src = f.node
GROUP BY e.dst, f.dim""", **BIP))
def q_edge_feature_sum(spark, sf):
    _, e, feats = bip(spark, sf)
    return rounded(G.edge_feature_sum(feats, e, key="g").select("node", "dim", "x"))


@query("relation_mean", with_ctes(f"""
SELECT node, dim, {r("sum(m)")} AS x FROM (
  SELECT e.dst AS node, e.rel, f.dim, avg(greatest(f.x + e.ex, 0.0)) AS m FROM be e JOIN bf f ON e.src = f.node
  GROUP BY e.dst, e.rel, f.dim) t GROUP BY node, dim""", **BIP))
def q_relation_mean(spark, sf):
    _, e, feats = bip(spark, sf)
    return rounded(G.relation_mean(feats, e, key="g").select("node", "dim", "x"))


@query("edge_attention", with_ctes(f"""
SELECT node, dim, {r_off_halves("sum(x)")} AS x FROM (
  SELECT e.dst AS node, e.rel, f.dim, sum(exp(e.ex - m.mx) * f.x) / sum(exp(e.ex - m.mx)) AS x
  FROM be e JOIN (SELECT dst, rel, max(ex) AS mx FROM be GROUP BY dst, rel) m ON e.dst = m.dst AND e.rel = m.rel
  JOIN bf f ON e.src = f.node GROUP BY e.dst, e.rel, f.dim) t GROUP BY node, dim""", **BIP))
def q_edge_attention(spark, sf):
    _, e, feats = bip(spark, sf)
    out = G.edge_attention(feats, e.withColumn("score", F.col("ex")), key="g")
    return rounded_off_halves(out.select("node", "dim", "x"), "x")


# ---- molecule-graph propagation, readouts and per-graph aggregates -----------

def mol_feats(nodes, edges, rows=None):
    """(mol_id, node, dim, x): dim 0 = degree, dim 1 = aromatic, dim 2 = charge.
    Dealt by node into the parts of ``rows`` rows, else of the edges."""
    rows = edges.count() if rows is None else rows
    ends = by_rows(edges.select(K, F.col("src").alias("node")), K, "node", rows=rows)
    deg = ends.groupBy(K, "node").agg(F.count(F.lit(1)).cast("double").alias("d"))
    n = by_rows(nodes, K, "node", rows=rows).join(deg, [K, "node"], "left").fillna(0.0, ["d"])
    return n.select(K, "node", F.explode(F.array(
        F.struct(F.lit(0).alias("dim"), F.col("d").alias("x")),
        F.struct(F.lit(1).alias("dim"), F.col("aromatic").cast("double").alias("x")),
        F.struct(F.lit(2).alias("dim"), F.col("charge").cast("double").alias("x")))).alias("f")).select(
        K, "node", "f.dim", "f.x")


MFEATS_SQL = """
SELECT g.mol_id, g.atom AS node, 0 AS dim, CAST(coalesce(d.c, 0) AS DOUBLE) AS x
FROM gatoms g LEFT JOIN (SELECT mol_id, src, count(*) AS c FROM bonds2 GROUP BY mol_id, src) d
  ON g.mol_id = d.mol_id AND g.atom = d.src
UNION ALL SELECT mol_id, atom, 1, CASE WHEN aromatic THEN 1.0 ELSE 0.0 END FROM gatoms
UNION ALL SELECT mol_id, atom, 2, CAST(charge AS DOUBLE) FROM gatoms"""


def _nsum_sql(src: str) -> str:
    return f"""
SELECT f.mol_id, f.node, f.dim, f.x + coalesce(m.s, 0.0) AS x
FROM {src} f LEFT JOIN (SELECT e.mol_id, e.dst AS node, f2.dim, sum(f2.x) AS s FROM medges e
                        JOIN {src} f2 ON e.mol_id = f2.mol_id AND e.src = f2.node GROUP BY e.mol_id, e.dst, f2.dim) m
  ON f.mol_id = m.mol_id AND f.node = m.node AND f.dim = m.dim"""


def _layers(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    e, f0 = G.spread(edges, K), written(mol_feats(nodes, edges), "features", grows=True)
    f1 = written(G.neighbor_sum(f0, e, key=K), "layer", grows=True)
    return [f0, f1, G.neighbor_sum(f1, e, key=K)]


LAYERS = {"medges": MEDGES, "mf": MFEATS_SQL, "l1": _nsum_sql("mf"), "l2": _nsum_sql("l1")}


@query("layer_combine", with_graph(f"""
SELECT mol_id, node, dim, {r("sum(x)")} AS x FROM (SELECT * FROM mf UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) t
GROUP BY mol_id, node, dim""", **LAYERS))
def q_layer_combine(spark, sf):
    return rounded(G.combine_layers(_layers(spark, sf), "sum", key=K))


@query("layer_combine_last", with_graph(f"SELECT mol_id, node, dim, {r('x')} AS x FROM l2", **LAYERS))
def q_layer_combine_last(spark, sf):
    return rounded(G.combine_layers(_layers(spark, sf), "last", key=K))


@query("layer_combine_concat", with_graph(f"""
SELECT mol_id, node, dim, {r('x')} AS x FROM mf UNION ALL SELECT mol_id, node, dim + 3, {r('x')} FROM l1
UNION ALL SELECT mol_id, node, dim + 6, {r('x')} FROM l2""", **LAYERS))
def q_layer_combine_concat(spark, sf):
    return rounded(G.combine_layers(_layers(spark, sf), "concat", key=K))


@query("virtual_node", with_graph(f"""
SELECT mol_id, node, dim, {r("x")} AS x FROM h2""", medges=MEDGES, mf=MFEATS_SQL,
    hv0="SELECT mol_id, node, dim, x FROM mf",
    h1=_nsum_sql("hv0"),
    vn1="SELECT mol_id, dim, sum(x) AS vn FROM h1 GROUP BY mol_id, dim",
    hv1="SELECT h.mol_id, h.node, h.dim, h.x + v.vn AS x FROM h1 h JOIN vn1 v ON h.mol_id = v.mol_id AND h.dim = v.dim",
    h2=_nsum_sql("hv1")))
def q_virtual_node(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    return rounded(G.virtual_node(mol_feats(nodes, edges), edges, rounds=2, key=K))


@query("marking_ensemble", with_graph(f"""
SELECT mol_id, node, {r("avg(x)")} AS x FROM (
  SELECT f.mol_id, f.set_id, f.node, f.x + coalesce(m.s, 0.0) AS x
  FROM mk f LEFT JOIN (SELECT e.mol_id, f2.set_id, e.dst AS node, sum(f2.x) AS s FROM medges e
                       JOIN mk f2 ON e.mol_id = f2.mol_id AND e.src = f2.node GROUP BY e.mol_id, f2.set_id, e.dst) m
    ON f.mol_id = m.mol_id AND f.set_id = m.set_id AND f.node = m.node) t
GROUP BY mol_id, node""", mnodes=MNODES, medges=MEDGES, marks=MARKS_SQL, mk="""
SELECT n.mol_id, s.set_id, n.node,
       CASE WHEN EXISTS (SELECT 1 FROM marks m WHERE m.mol_id = n.mol_id AND m.set_id = s.set_id AND m.node = n.node)
            THEN -1.0 ELSE 1.0 END AS x
FROM mnodes n JOIN (SELECT DISTINCT mol_id, set_id FROM marks) s ON n.mol_id = s.mol_id"""))
def q_marking_ensemble(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    mm = G.marking_matrix(nodes, _marks(spark, sf, nodes), key=K)
    # each marking set is one copy of the graph: (mol_id, set_id) is the graph key
    feats = mm.select(F.struct(K, "set_id").alias("gk"), "node", F.lit(0).alias("dim"),
                      F.col("mark").cast("double").alias("x"))
    sets = mm.select(K, "set_id").distinct()
    e = edges.join(sets, K).select(F.struct(K, "set_id").alias("gk"), "src", "dst")
    h = G.neighbor_sum(feats, e, key="gk")
    return rounded(h.groupBy(F.col("gk.mol_id").alias(K), "node").agg(F.avg("x").alias("x")))


@query("graph_readout", with_graph(f"""
SELECT mol_id, dim, {r("sum(x)")} AS x_sum, {r("avg(x)")} AS x_mean, {r("max(x)")} AS x_max
FROM mf GROUP BY mol_id, dim""", mf=MFEATS_SQL))
def q_graph_readout(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    f = mol_feats(nodes, edges)
    s = G.readout(f, K, "sum").withColumnRenamed("x", "x_sum")
    mm = G.readout(f, K, "maxmean")
    return rounded(s.join(mm, [K, "dim"]).select(K, "dim", "x_sum", "x_mean", "x_max"))


@query("segment_reduce", f"""
SELECT l_orderkey, {r("sum(l_extendedprice)")} AS v_sum, {r("avg(l_extendedprice)")} AS v_mean,
       {r("max(l_extendedprice)")} AS v_max FROM lineitem GROUP BY l_orderkey""")
def q_segment_reduce(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return rounded(li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("v_sum"),
                                                F.avg("l_extendedprice").alias("v_mean"),
                                                F.max("l_extendedprice").alias("v_max")))


@query("nested_reduce", with_graph(f"""
SELECT mol_id, root AS node, dist, {r("sum(s)")} AS x, count(*) AS n_nbrs FROM (
  SELECT w.mol_id, w.root, w.node, w.d AS dist, sum(f.x) AS s
  FROM (SELECT mol_id, root, node, min(d) AS d FROM walks GROUP BY mol_id, root, node) w
  JOIN mf f ON w.mol_id = f.mol_id AND w.node = f.node WHERE w.d BETWEEN 1 AND 2
  GROUP BY w.mol_id, w.root, w.node, w.d) t GROUP BY mol_id, root, dist""",
                                   mnodes=MNODES, medges=MEDGES, walks=_walk_sql(2), mf=MFEATS_SQL))
def q_nested_reduce(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    roots = nodes.select(K, F.col("node").alias("root"))
    kh = written(G.k_hop(edges, roots, 2, key=K).where("hop >= 1"), "near", grows=True)
    n = kh.count()
    f = mol_feats(nodes, edges, rows=n)
    # a root meets a node once, so the nodes' own sums are taken before the join
    inner = by_rows(kh, K, "node", rows=n).join(f.groupBy(K, "node").agg(F.sum("x").alias("_s")), [K, "node"])
    outer = inner.groupBy(K, F.col("root").alias("node"), F.col("hop").alias("dist")).agg(
        F.sum("_s").alias("x"), F.count(F.lit(1)).alias("n_nbrs"))
    return rounded(outer)


@query("per_graph_error_sum", with_graph(f"""
SELECT g.mol_id, {r("-sum(abs(coalesce(e.z, 0) / 10.0 - coalesce(d.c, 0)))")} AS score
FROM gatoms g LEFT JOIN elems e ON g.symbol = e.symbol
LEFT JOIN (SELECT mol_id, src, count(*) AS c FROM bonds2 GROUP BY mol_id, src) d ON g.mol_id = d.mol_id AND g.atom = d.src
GROUP BY g.mol_id""", elems=ELEMENTS_SQL))
def q_per_graph_error(spark, sf):
    from ..operators.tokens import elements
    atoms, bonds = MO.mol_graph(S.molecules(spark, sf), both_directions=True)
    af = MO.atom_features(atoms, bonds, elements(spark))
    err = F.abs(F.col("z") / 10.0 - F.col("degree"))
    return rounded(af.groupBy(K).agg((-F.sum(err)).alias("score")))


@query("dataset_caps", with_graph("""
SELECT CAST(least(max(n), 128) AS BIGINT) AS max_nodes, CAST(least(max(dist), 20) AS BIGINT) AS max_dist
FROM (SELECT mol_id, count(*) AS n FROM gatoms GROUP BY mol_id) a,
     (SELECT max(coalesce(w.d, 510)) AS dist FROM mnodes i JOIN mnodes j ON i.mol_id = j.mol_id
      LEFT JOIN (SELECT mol_id, root, node, min(d) AS d FROM walks GROUP BY mol_id, root, node) w
        ON w.mol_id = i.mol_id AND w.root = i.node AND w.node = j.node) b""",
                                  mnodes=MNODES, medges=MEDGES, walks=_walk_sql(26)))
def q_dataset_caps(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    n = nodes.groupBy(K).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("mn"))
    d = DI.largest_distance(edges, nodes, key=K)
    return n.crossJoin(F.broadcast(d)).select(F.least(F.col("mn"), F.lit(128)).cast("bigint").alias("max_nodes"),  # one row each
                                              F.least(F.col("max_dist"), F.lit(20)).cast("bigint").alias("max_dist"))


#: requested pairs: two marks of a graph, its first and last node, and a node that it does not have
PAIRS_SQL = """
SELECT DISTINCT a.mol_id, a.node AS i, b.node AS j FROM marks a JOIN marks b ON a.mol_id = b.mol_id AND a.set_id = b.set_id
WHERE a.piece = 0 AND b.piece = 1
UNION SELECT mol_id, 0, max(node) FROM mnodes GROUP BY mol_id
UNION SELECT mol_id, 0, max(node) + 1 FROM mnodes GROUP BY mol_id"""


@query("pair_distance", with_graph("""
SELECT p.mol_id, p.i, p.j, CAST(coalesce(w.d, 510) AS INTEGER) AS dist,
       CAST(CASE WHEN w.d <= 3 THEN w.d ELSE 9999 END AS INTEGER) AS capped
FROM asked p LEFT JOIN (SELECT mol_id, root, node, min(d) AS d FROM walks GROUP BY mol_id, root, node) w
  ON w.mol_id = p.mol_id AND w.root = p.i AND w.node = p.j""",
                                   mnodes=MNODES, medges=MEDGES, marks=MARKS_SQL, asked=PAIRS_SQL, walks=_walk_sql(26)))
def q_pair_distance(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    m = _marks(spark, sf, nodes)
    two = (m.where("piece = 0").select(K, "set_id", F.col("node").alias("i"))
           .join(m.where("piece = 1").select(K, "set_id", F.col("node").alias("j")), [K, "set_id"]).drop("set_id"))
    last = nodes.groupBy(K).agg(F.max("node").alias("m")).select(K, F.inline(F.array(
        F.struct(F.lit(0).alias("i"), F.col("m").alias("j")), F.struct(F.lit(0).alias("i"), (F.col("m") + 1).alias("j")))))
    asked = written(two.unionByName(last).distinct(), "asked")
    far = DI.pair_distances(edges, asked, key=K, far=G.UNREACHABLE_APSP)
    near = DI.pair_distances(edges, asked, key=K, limit=3, far=G.UNREACHABLE_CAPPED).withColumnRenamed("dist", "capped")
    return far.join(near, [K, "i", "j"])


COUNTS_SQL = "SELECT mol_id, count(*) AS cnt FROM gatoms GROUP BY mol_id"


def _atom_counts(spark, sf):
    nodes, _ = mol_nodes_edges(spark, sf)
    return nodes.groupBy(K).agg(F.count(F.lit(1)).alias("cnt"))


def count_to_offset(counts):
    """Exclusive prefix sum of counts in key order (no single task)."""
    return placed(counts, [K], sums={"offset": F.col("cnt")}, exclusive=True)


@query("count_to_offset", with_graph("""
SELECT mol_id, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(coalesce(lead(o) OVER (ORDER BY mol_id), (SELECT sum(cnt) FROM c)) - o AS BIGINT) AS count_back
FROM (SELECT *, coalesce(sum(cnt) OVER (ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c) t""",
                                     c=COUNTS_SQL))
def q_count_to_offset(spark, sf):
    # offset -> count: an offset and the running total with its own row are the
    # two ends of the key's range
    d = _atom_counts(spark, sf)
    d = placed(d, [K], sums={"_end": F.col("cnt")})
    off = F.col("_end") - F.col("cnt")
    return d.select(K, F.col("cnt").cast("bigint"), off.cast("bigint").alias("offset"),
                    (F.col("_end") - off).cast("bigint").alias("count_back"))


@query("node_offset", with_graph("""
SELECT g.mol_id, g.atom, CAST(o.off + g.atom AS BIGINT) AS global_idx FROM gatoms g
JOIN (SELECT mol_id, coalesce(sum(cnt) OVER (ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM c) o ON g.mol_id = o.mol_id""", c=COUNTS_SQL))
def q_node_offset(spark, sf):
    atoms, _ = MO.mol_graph(S.molecules(spark, sf))
    off = count_to_offset(atoms.groupBy(K).agg(F.count(F.lit(1)).alias("cnt")))
    return atoms.select(K, "atom").join(off, K).select(K, "atom", (F.col("offset") + F.col("atom")).cast("bigint").alias("global_idx"))


@query("segment_argmax", with_graph(f"""
SELECT mol_id, arg_max(node, x * 100000 - node) AS node, {r("max(x)")} AS value FROM l1 WHERE dim = 0 GROUP BY mol_id""",
                                    medges=MEDGES, mf=MFEATS_SQL, l1=_nsum_sql("mf")))
def q_segment_argmax(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    h = G.neighbor_sum(mol_feats(nodes, edges), edges, key=K).where("dim = 0")
    # best value, ties broken by the smallest node id
    best = h.groupBy(K).agg(F.max_by("node", F.struct(F.col("x"), -F.col("node"))).alias("node"),
                           F.max("x").alias("value"))
    return rounded(best)


@query("stable_rank_order", with_graph("""
SELECT g.mol_id, g.atom, CAST(row_number() OVER (PARTITION BY g.mol_id ORDER BY coalesce(e.z, 0) DESC, g.atom) - 1 AS INTEGER) AS new_idx
FROM gatoms g LEFT JOIN elems e ON g.symbol = e.symbol""",
                                       elems=ELEMENTS_SQL))
def q_stable_rank_order(spark, sf):
    from ..operators.tokens import elements
    atoms, _ = MO.mol_graph(S.molecules(spark, sf))
    a = atoms.join(F.broadcast(elements(spark).select("symbol", "z")), "symbol", "left")
    # one molecule per window partition: bounded by the molecule size
    w = Window.partitionBy(K).orderBy(F.coalesce("z", F.lit(0)).desc(), "atom")
    return a.select(K, "atom", (F.row_number().over(w) - 1).cast("int").alias("new_idx"))


@query("range_expand", with_graph("""
SELECT o.mol_id, CAST(r AS BIGINT) AS rep, CAST(o.off + i AS BIGINT) AS idx
FROM (SELECT mol_id, cnt, coalesce(sum(cnt) OVER (ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM c) o, generate_series(1, 2) AS a(r), generate_series(0, o.cnt - 1) AS b(i)""", c=COUNTS_SQL))
def q_range_expand(spark, sf):
    off = count_to_offset(_atom_counts(spark, sf))
    d = off.select(K, "cnt", "offset", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("rep"))
    d = d.select(K, "rep", F.explode(F.sequence(F.col("offset").cast("bigint"),
                                                (F.col("offset") + F.col("cnt") - 1).cast("bigint"))).alias("idx"))
    return d


SP_WALK_SQL = """
SELECT mol_id, node AS root, node, [node] AS path FROM mnodes
UNION ALL
SELECT w.mol_id, w.root, e.dst AS node, list_append(w.path, e.dst) AS path
FROM sp_walks w JOIN medges e ON w.mol_id = e.mol_id AND w.node = e.src
WHERE NOT list_contains(w.path, e.dst)"""


@query("shortest_path_edge_sequence", with_graph("""
SELECT s.mol_id, s.i, s.j, CAST(g.k - 1 AS INTEGER) AS k, e.bond_order AS edge_feat
FROM (SELECT mol_id, root AS i, node AS j, min(path) AS path FROM (
        SELECT mol_id, root, node, path, len(path) AS l, min(len(path)) OVER (PARTITION BY mol_id, root, node) AS ml
        FROM sp_walks) x WHERE l = ml AND l > 1 GROUP BY mol_id, root, node) s,
     generate_series(1, len(s.path) - 1) AS g(k),
     medges e
WHERE e.mol_id = s.mol_id AND e.src = s.path[g.k] AND e.dst = s.path[g.k + 1]""",
                                                 mnodes=MNODES, medges=MEDGES, sp_walks=SP_WALK_SQL))
def q_shortest_path_edges(spark, sf):
    nodes, edges = mol_nodes_edges(spark, sf)
    sp = G.shortest_paths(edges, nodes, key=K, feat="bond_order")
    return G.path_edges(sp, edges, key=K)
