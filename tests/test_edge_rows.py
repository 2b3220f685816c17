"""Rows that the driver tables do not hold: nulls, one class, equal values,
long chains, short lines, unfinished folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import graph as G
from assaylake.operators import metrics as M
from assaylake.operators import molecules as MO
from assaylake.operators import ranking as R
from assaylake.operators import tokens as T
from assaylake.plans.q_aggs import cross_covariance
from assaylake.sources import io


def test_null_order_and_keys_keep_their_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"),
                                 F.when(F.col("id") % 3 > 0, F.lit("a")).alias("k"))
    assert R.placed(df, ["x", "id"], rank="rank").agg(F.countDistinct("rank")).first()[0] == 100
    seq = R.placed(df, ["x", "id"], by=["k"], rank="rank", count="n").groupBy("k").agg(
        F.count("*").alias("rows"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("top"), F.max("n").alias("n")).collect()
    assert sorted(tuple(r)[1:] for r in seq) == [(34,) * 4, (66,) * 4]


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.9)], "label int, score double")
    assert M.auroc(df, "label", "score").first()["auroc"] is None


def test_saturated_negatives_stay_in_the_mean(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 1, 40.0), (0, 2, 0.0)], "grp int, pos int, score double")
    row = M.rank_losses(df).first().asDict()
    assert abs(row["neg_log"] - 20.3533) < 1e-3


def test_chain_longer_than_any_former_limit(spark):
    n = 12
    nodes = spark.createDataFrame([(0, i) for i in range(n)], "g int, node int")
    edges = spark.createDataFrame([(0, i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n],
                                  "g int, src int, dst int")
    d = G.all_pairs(edges, nodes)
    assert d.count() == n * n and d.agg(F.max("dist")).first()[0] == n - 1


def test_two_letter_aromatic_atoms(spark):
    cols = T.atom_columns(F.col("t"))
    row = spark.createDataFrame([("[se]",)], "t string").select(*[c.alias(k) for k, c in cols.items()]).first()
    assert "Se" in [str(v) for v in row]


def test_short_lines_and_unfinished_folder(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("a b c\nd\n")
    assert [tuple(r)[:3] for r in io.scan_triples(spark, [str(p)]).orderBy("head").collect()] == [
        ("a", "b", "c"), ("d", None, None)]
    q = tmp_path / "b.txt"
    q.write_text("x|1\ny\nz|no\n")
    assert [r.label for r in io.scan_delimited_text(spark, [str(q)]).orderBy("text").collect()] == [1, None, None]
    out = str(tmp_path / "t")
    io.materialize_if_absent(spark, out, lambda: spark.range(10))
    os.remove(f"{out}/_SUCCESS")
    spark.range(2).write.mode("overwrite").parquet(out)
    os.remove(f"{out}/_SUCCESS")
    assert io.materialize_if_absent(spark, out, lambda: spark.range(10)).count() == 10


def test_one_frequent_order_value_is_split_and_ranked(spark, many_parts):
    df = spark.range(2000).selectExpr("CAST(IF(id < 1500, 7, id) AS LONG) AS f", "2000 - id AS line", "id")
    sizes = R.ordered(df, ["f", "line"]).where("f = 7").groupBy("_part").count().collect()
    assert len(sizes) > 2 and max(s["count"] for s in sizes) < 800
    got = {r["id"]: r["rank"] for r in R.placed(df, ["f", "line"], rank="rank").collect()}
    want = sorted(range(2000), key=lambda i: (7 if i < 1500 else i, 2000 - i))
    assert [got[i] for i in want] == list(range(1, 2001))


def test_ranks_keep_large_longs_and_nulls_in_order(spark, many_parts):
    big = 1 << 60
    rows = [(big + k % 3, k) for k in range(300)] + [(None, 1000 + k) for k in range(5)]
    df = spark.createDataFrame(rows, "f long, line long")
    got = [r["line"] for r in R.placed(df, ["f", "line"], rank="rank").orderBy("rank").collect()]
    assert got == [k for _, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]


def test_unlisted_elements_and_empty_molecules_stay(spark):
    df = spark.createDataFrame([(1, "C[Si](C)(C)C"), (2, "[Uue]C"), (3, "")], "mol_id long, smiles string")
    toks = T.smiles_tokens(df)
    d = {r.mol_id: r for r in T.token_descriptors(toks, T.elements(spark)).collect()}
    assert d[1].heavy_mol_wt == pytest.approx(4 * 12.011 + 28.085) and d[2].heavy_atoms == 2
    atoms, bonds = MO.mol_graph(df, both_directions=True)
    f = MO.atom_features(atoms, bonds, T.elements(spark)).collect()
    assert sorted(r.z for r in f if r.mol_id == 2) == [0, 6]
    enc = {r.mol_id: r for r in T.encode_pad(toks, T.dictionary_encode(toks, "token", ["mol_id", "pos"], start=2),
                                              "mol_id", keys=df).collect()}
    longest = max(r["pos"] for r in toks.collect()) + 1
    assert set(enc) == {1, 2, 3} and {len(r.input_ids) for r in enc.values()} == {longest}
    assert enc[3].input_ids == [0] * longest == enc[3].attention_mask


def test_ring_flag_and_hydrogens(spark):
    df = spark.createDataFrame([(1, "CC1CC1"), (2, "c1ccccc1-c1ccccc1"), (3, "C")], "mol_id long, smiles string")
    atoms, bonds = MO.mol_graph(df, both_directions=True)
    rows = MO.atom_features(atoms, bonds, T.elements(spark)).collect()
    of = lambda m, c: [r[c] for r in sorted(rows, key=lambda r: r.atom) if r.mol_id == m]
    assert of(1, "in_ring") == [False, True, True, True] and of(1, "n_h") == [3, 1, 2, 2]
    assert all(of(2, "in_ring")) and sum(of(2, "n_h")) == 10
    assert of(3, "in_ring") == [False] and of(3, "n_h") == [4] and of(3, "degree") == [0]


def test_covariance_of_two_views(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 1, (50, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "vec array<double>").repartition(4)
    got = {(r["kind"], r["i"], r["j"]): r["cov"] for r in cross_covariance(df, 4, ridge=0.5).collect()}
    c = np.cov(x.T)
    assert len(got) == 24
    for i in range(4):
        for j in range(6):
            k = ("auto", i, j) if j < 4 else ("cross", i, j - 4)
            assert got[k] == pytest.approx(c[i, j] + (0.5 if i == j else 0))
    assert cross_covariance(df.where("false"), 4).count() == 0
