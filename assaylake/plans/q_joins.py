"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash32
from ..operators import molecules as MO
from ..operators import splits as SP
from ..operators import tokens as TK
from ..sources import tables as S
from .common import r, rounded
from .q_graph import MARKS_SQL
from .q_molecules import _fp_sql, with_graph
from .q_splits import KFOLD_SQL, _ranked_sql
from .registry import query, with_ctes


@query("atoms_join_elements", with_graph(f"""
SELECT g.mol_id, g.atom, coalesce(e.z, 0) AS z, {r('e.weight')} AS weight, {r('e.electronegativity')} AS electronegativity
FROM gatoms g LEFT JOIN elems e ON g.symbol = e.symbol""", elems=TK.ELEMENTS_SQL))
def q_atoms_join_elements(spark, sf):
    atoms, _ = MO.mol_graph(S.molecules(spark, sf))
    j = TK.join_elements(atoms, TK.elements(spark))
    return rounded(j.select("mol_id", "atom", "z", "weight", "electronegativity"))


@query("feature_zip", with_graph(f"""
SELECT d.mol_id, {r('d.len')} AS len, {r('d.n_branch')} AS n_branch, CAST(coalesce(f.n_bits, 0) AS BIGINT) AS n_bits,
       CAST(t.n_tokens AS BIGINT) AS n_tokens
FROM descr d LEFT JOIN (SELECT mol_id, count(*) AS n_bits FROM fp GROUP BY mol_id) f ON d.mol_id = f.mol_id
JOIN (SELECT mol_id, count(*) AS n_tokens FROM toks GROUP BY mol_id) t ON d.mol_id = t.mol_id""",
                                 descr=S.MOL_DESCRIPTORS_SQL.replace(f"({S.MOLECULES_SQL})", "molecules"),
                                 **_fp_sql(2, 2048)))
def q_feature_zip(spark, sf):
    """Feature blocks of the same molecule joined on the row key (never by
    position)."""
    m = S.molecules(spark, sf)
    d = S.mol_descriptors(spark, sf).select("mol_id", "len", "n_branch")
    fp = MO.circular_fingerprint_rows(m).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_bits"))
    toks = TK.smiles_tokens(m).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    out = d.join(fp, "mol_id", "left").join(toks, "mol_id").fillna(0, ["n_bits"])
    return rounded(out.select("mol_id", "len", "n_branch", F.col("n_bits").cast("bigint"),
                              F.col("n_tokens").cast("bigint")))


@query("gather_nodes", with_graph(f"""
SELECT m.mol_id, CAST(m.set_id AS INTEGER) AS set_id, CAST(m.piece AS INTEGER) AS piece, m.node, g.symbol, g.aromatic
FROM marks m JOIN gatoms g ON m.mol_id = g.mol_id AND m.node = g.atom""",
                                  mnodes="SELECT mol_id, atom AS node FROM gatoms",
                                  marks=MARKS_SQL))
def q_gather_nodes(spark, sf):
    from ..operators import graph as G
    atoms, _ = MO.mol_graph(S.molecules(spark, sf))
    n = atoms.groupBy("mol_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    marks = G.random_marks(n, 2, 2, key="mol_id", seed=17)
    return marks.join(atoms.select("mol_id", F.col("atom").alias("node"), "symbol", "aromatic"), ["mol_id", "node"]) \
        .select("mol_id", "set_id", "piece", "node", "symbol", "aromatic")


@query("link_features", with_graph("""
SELECT b.mol_id, b.src, b.dst, b.bond_order, s.symbol AS src_symbol, d.symbol AS dst_symbol,
       s.aromatic AS src_aromatic, d.aromatic AS dst_aromatic
FROM bonds b JOIN gatoms s ON b.mol_id = s.mol_id AND b.src = s.atom
JOIN gatoms d ON b.mol_id = d.mol_id AND b.dst = d.atom"""))
def q_link_features(spark, sf):
    atoms, bonds = MO.mol_graph(S.molecules(spark, sf))
    a = atoms.select("mol_id", "atom", "symbol", "aromatic")
    j = (bonds.join(a.select("mol_id", F.col("atom").alias("src"), F.col("symbol").alias("src_symbol"),
                             F.col("aromatic").alias("src_aromatic")), ["mol_id", "src"])
         .join(a.select("mol_id", F.col("atom").alias("dst"), F.col("symbol").alias("dst_symbol"),
                        F.col("aromatic").alias("dst_aromatic")), ["mol_id", "dst"]))
    return j.select("mol_id", "src", "dst", "bond_order", "src_symbol", "dst_symbol", "src_aromatic", "dst_aromatic")




@query("split_index_join", with_ctes(f"""
SELECT m.mol_id, CASE WHEN k.fold = 0 THEN 'test' WHEN k.fold = 1 THEN 'valid' ELSE 'train' END AS split,
       {r('m.pic50')} AS pic50
FROM molecules m JOIN kf k ON m.mol_id = k.mol_id""", molecules=S.MOLECULES_SQL,
                                     rk=_ranked_sql("molecules", "mol_id", 41), kf=KFOLD_SQL))
def q_split_index_join(spark, sf):
    m = S.molecules(spark, sf)
    idx = SP.kfold(m.select("mol_id"), "mol_id", 5, seed=41).select(
        "mol_id", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "valid").otherwise("train").alias("split"))
    return rounded(m.join(idx, "mol_id").select("mol_id", "split", "pic50"))


@query("replay_join", f"""
WITH rk AS (SELECT event_id, user_id, value,
                   row_number() OVER (PARTITION BY user_id ORDER BY {sql_hash32('event_id', seed=2)}, event_id) AS rnk,
                   count(*) OVER (PARTITION BY user_id) AS m FROM events),
dr AS (SELECT DISTINCT user_id, m FROM rk),
smp AS (SELECT rk.event_id, rk.user_id, rk.value, d AS draw FROM dr, generate_series(1, 2) AS g(d), rk
        WHERE rk.user_id = dr.user_id AND rk.rnk = {sql_hash32('dr.user_id', 'd', seed=3)} % dr.m + 1)
SELECT s.event_id, CAST(s.draw AS BIGINT) AS draw, c.c_name, {r('s.value')} AS value
FROM smp s JOIN customer c ON s.user_id = c.c_custkey""")
def q_replay_join(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", "user_id", "value")
    sample = SP.draw_per_group(ev, "user_id", "event_id", 2, seed=2)
    cust = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return rounded(sample.join(cust, "user_id").select("event_id", F.col("draw").cast("bigint"), "c_name", "value"))


@query("edge_delta_apply", """
WITH base AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem WHERE l_linestatus = 'O'),
del AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem WHERE l_returnflag = 'R'),
dels AS (SELECT src, dst FROM del UNION SELECT dst, src FROM del),
adds AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem
         WHERE l_linestatus = 'F' AND l_returnflag = 'A')
SELECT src, dst FROM base b WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.src = b.src AND d.dst = b.dst)
UNION SELECT src, dst FROM adds""")
def q_edge_delta_apply(spark, sf):
    li = S.table(spark, sf, "lineitem")
    pair = [(F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")]
    base = li.where("l_linestatus = 'O'").select(*pair).distinct()
    dl = li.where("l_returnflag = 'R'").select(*pair).distinct()
    adds = li.where("l_linestatus = 'F' AND l_returnflag = 'A'").select(*pair)
    return apply_edge_delta(base, adds, dl, directed=True)


def apply_edge_delta(edges, adds, deletes, directed: bool = True):
    """Remove ``deletes`` (both directions when ``directed``), then add
    ``adds``; result is a distinct edge set (anti join + union)."""
    d = deletes.select("src", "dst")
    if directed:
        d = d.unionByName(d.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    kept = edges.select("src", "dst").join(d.distinct(), ["src", "dst"], "left_anti")
    return kept.unionByName(adds.select("src", "dst")).distinct()
