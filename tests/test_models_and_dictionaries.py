"""Saved pipelines with label scaling, pattern matches, encoded triples, TD
targets, replayed batches and dictionary joins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import lookup as LO
from assaylake.operators import metrics as M
from assaylake.operators import ml as ML
from assaylake.operators import molecules as MO
from assaylake.operators import subgraph as SG
from assaylake.operators import tokens as TK
from assaylake.streaming import jobs as J


def _training(spark, n=200):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        on = sorted(b for b in range(12) if rng.random() < (0.5 if b < 6 else 0.01))
        rows.append((i, on, 5.0 + 2.0 * (1 in on) - 1.0 * (4 in on)))
    df = spark.createDataFrame(rows, "mol_id long, on array<int>, pic50 double")
    bits = df.select("mol_id", F.explode(F.col("on").cast("array<bigint>")).alias("bit"))
    return rows, ML.bit_rows(df.select("mol_id", "pic50"), bits)


@pytest.mark.parametrize("kind", ["forest", "linear"])
def test_saved_pipeline_predicts_in_label_units(spark, tmp_path, kind):
    rows, train = _training(spark)
    model = ML.potency_pipeline(spark, kind, n_bits=16, num_trees=5).fit(train)
    share = {b: sum(b in on for _, on, _ in rows) / len(rows) for b in range(16)}
    assert ML.kept_bits(model) == [b for b, p in share.items() if p * (1 - p) * len(rows) / (len(rows) - 1) > 0.05]
    y = np.array([p for *_, p in rows])
    assert ML.label_stats(model) == (pytest.approx(y.mean()), pytest.approx(y.std()))
    ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(str(tmp_path / "m"))
    new = train.drop("pic50")
    old = {r["mol_id"]: r["pred"] for r in ML.batch_predict(model, new).collect()}
    assert {r["mol_id"]: r["pred"] for r in ML.batch_predict(again, new).collect()} == old
    err = np.array([old[i] - p for i, _, p in rows])
    assert np.sqrt((err ** 2).mean()) < 0.6 * y.std() and y.min() - 0.2 < min(old.values()) <= max(old.values()) < y.max() + 0.2


def test_sparse_vectors_and_molecules_without_bits(spark):
    bits = spark.createDataFrame([(1, 7), (1, 3), (1, 3), (2, 0)], "mol_id long, bit long")
    rows = ML.bit_rows(spark.createDataFrame([(1,), (2,), (3,)], "mol_id long"), bits)
    got = {r["mol_id"]: r["raw"] for r in ML.vectorizer(spark, 8).transform(rows).collect()}
    assert {k: (v.size, v.indices.tolist()) for k, v in got.items()} == {1: (8, [3, 7]), 2: (8, [0]), 3: (8, [])}


def test_label_scaler_of_constant_and_missing_labels(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "label double")
    m = ML.LabelScaler().fit(df)
    assert [r["scaled"] for r in m.transform(df).collect()] == [0.0, 0.0, None]
    assert ML.LabelScaler().fit(df.where("label > 9")).getOrDefault("std") == 1.0


SMILES = ["CS(=O)(=O)C", "CS(=O)(=O)[O-]", "CC(=O)O", "CC(=O)OC", "NCC(=O)O", "[NH4+]", "CN(C)C", "OC(=O)O", "C", "O=S(=O)([O-])CS(=O)(=O)[O-]",
          "C1CC1", "OCCO"]


def test_fragments_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(SMILES)), "mol_id long, smiles string")
    got = {SMILES[r["mol_id"]]: r for r in MO.fragment_counts(*MO.mol_graph(df, both_directions=True)).collect()}
    assert len(got) == len(SMILES)
    names = [p.name for p in SG.FRAGMENTS]
    want = {"CS(=O)(=O)C": (0, 0, 0, 0, 0), "CS(=O)(=O)[O-]": (0, 0, 0, 1, 0), "CC(=O)O": (1, 0, 0, 0, 1), "CC(=O)OC": (1, 0, 0, 0, 2),
            "NCC(=O)O": (1, 1, 0, 0, 1), "[NH4+]": (0, 0, 1, 0, 0), "CN(C)C": (0,) * 5, "OC(=O)O": (2, 0, 0, 0, 2), "C": (0,) * 5,
            "O=S(=O)([O-])CS(=O)(=O)[O-]": (0, 0, 0, 2, 0), "C1CC1": (0,) * 5, "OCCO": (0, 0, 0, 0, 2)}
    assert {s: tuple(got[s][c] for c in names) for s in SMILES} == want


def test_patterns_with_rings_and_symmetry(spark):
    df = spark.createDataFrame([(0, "C1CC1"), (1, "C1CCC1"), (2, "CCC"), (3, "C1CC1C1CC1")], "mol_id long, smiles string")
    c = SG.Atom("C")
    ring = SG.Pattern("ring3", (c, c, c), ((0, 1, 1), (1, 2, 1), (0, 2, 1)))
    chain = SG.Pattern("chain3", (c, c, c), ((0, 1, 1), (1, 2, 1)))
    atoms, bonds = MO.mol_graph(df, both_directions=True)
    got = {r["mol_id"]: (r["ring3"], r["chain3"]) for r in SG.count_patterns(atoms, bonds, MO._valence(), [ring, chain]).collect()}
    assert got == {0: (1, 1), 1: (0, 4), 2: (0, 1), 3: (2, 6)}
    with pytest.raises(ValueError, match="no bond leads"):
        SG.Pattern("broken", (c, c), ()).steps()


def test_triples_are_encoded_with_a_preset_and_decoded(spark):
    rng = random.Random(1)
    rows = [(k // 40, k % 40, "hub" if rng.random() < 0.5 else f"e{rng.randrange(9)}", rng.choice("pqr"), f"e{rng.randrange(9)}") for k in range(100)]
    t = spark.createDataFrame(rows, "file_no int, line int, head string, relation string, tail string")
    preset = spark.createDataFrame([("q", 0), ("z", 4)], "value string, id long")
    rel = TK.dictionary_encode(t.select(F.col("relation").alias("value"), "file_no", "line"), "value", ["file_no", "line"], preset=preset)
    ids = {r["value"]: r["id"] for r in rel.collect()}
    first = list(dict.fromkeys(r[3] for r in rows if r[3] != "q"))
    assert ids == {"q": 0, "z": 4, **{v: 5 + i for i, v in enumerate(first)}}
    ent = TK.dictionary_encode(t.select(F.inline(F.array(
        F.struct(F.col("head").alias("value"), "file_no", "line", F.lit(0).alias("side")),
        F.struct(F.col("tail").alias("value"), "file_no", "line", F.lit(1).alias("side"))))), "value", ["file_no", "line", "side"])
    order = list(dict.fromkeys(v for r in rows for v in (r[2], r[4])))
    coded = TK.encode_triples(t, ent, rel)
    for r in coded.collect():
        assert (order[r["head_id"]], order[r["tail_id"]], ids[r["relation"]]) == (r["head"], r["tail"], r["relation_id"])
    back = TK.decode_triples(coded.drop("head", "relation", "tail"), ent, rel).select(*t.columns)
    assert back.exceptAll(t).count() == t.exceptAll(back).count() == 0


@pytest.mark.parametrize("how,max_rows", itertools.product(["inner", "left"], [10, 0]))
def test_lookup_broadcast_or_in_lanes(spark, how, max_rows):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"v{i % 7}") for i in range(300)] + [(300, None)], "id int, v string")
    d = spark.createDataFrame([("hot", 1), ("v0", 2), ("v3", 3)], "v string, n int")
    want = sorted(map(tuple, df.join(d, "v", how).select("id", "n").collect()), key=str)
    assert sorted(map(tuple, LO.lookup(df, d, "v", how, max_rows).select("id", "n").collect()), key=str) == want


def test_target_takes_the_best_next_action(spark):
    steps = spark.createDataFrame([(1, 10, 100, 0.5, 1.0), (1, 20, 101, 0.2, 0.0), (None, 5, 102, 0.1, 0.0), (None, 6, 103, 0.3, 2.0)],
                                  "user long, t long, state long, q double, reward double")
    acts = spark.createDataFrame([(100, 0, 9.0), (101, 0, 0.2), (101, 1, 0.8), (101, 2, -1.0), (103, 0, 0.4), (103, 1, 0.3)], "state long, action int, q double")
    row = M.td_error(steps, "user", "t", ["state"], "q", "reward", "state", acts, gamma=0.5).first()
    targets = [1.0 + 0.5 * 0.8, 0.0, 0.0 + 0.5 * 0.4, 2.0]
    assert row["mean_target"] == pytest.approx(np.mean(targets))
    assert row["td_error"] == pytest.approx(np.mean([(q - t) ** 2 for q, t in zip((0.5, 0.2, 0.1, 0.3), targets, strict=True)]))


def test_a_replayed_batch_is_not_doubled(spark, tmp_path):
    out, sink = str(tmp_path / "out"), J.replace_batch(str(tmp_path / "out"))
    first = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    sink(first, 0)
    sink(first, 0)
    sink(spark.createDataFrame([(1, "d")], "k int, v string"), 1)
    got = J.latest_batches(spark, out, "k").collect()
    assert sorted(((r["k"], r["v"]) for r in got), key=str) == [(1, "d"), (None, "c")]


def test_descriptors_and_decoding_keep_empty_molecules(spark):
    df = spark.createDataFrame([(1, "CC"), (2, ""), (3, "[Xx]C")], "mol_id long, smiles string")
    d = {r["mol_id"]: r for r in TK.token_descriptors(TK.smiles_tokens(df), TK.elements(spark), keys=df).collect()}
    assert set(d) == {1, 2, 3} and d[2]["heavy_atoms"] == 0 and d[2]["heavy_mol_wt"] == 0.0
    assert [d[k]["unlisted_atoms"] for k in (1, 2, 3)] == [0, 0, 1]
    cs, pad = TK.charset_fit(df, "smiles")
    back = TK.char_decode(TK.char_encode(df, "mol_id", "smiles", cs, pad), "mol_id", cs, keys=df)
    assert {r["mol_id"]: r["decoded"] for r in back.collect()} == {1: "CC", 2: "", 3: "[Xx]C"}


def test_places_in_the_periodic_table(spark):
    at = {s: TK.element_place(z) for s, z, *_ in TK.ELEMENTS}
    assert [z for _, z, *_ in TK.ELEMENTS] == list(range(1, 119))
    assert (at["H"], at["He"], at["C"]) == ((1, 1, "s", 1), (1, 18, "s", 2), (2, 14, "p", 4))
    assert (at["Fe"], at["U"], at["Og"]) == ((4, 8, "d", 8), (7, None, "f", None), (7, 18, "p", 8))
    assert TK.elements(spark).where("neutrons < 0 or weight <= 0").count() == 0


def test_focal_loss_reductions(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (1, [1.0, 1.0]), (None, [0.0, 0.0])], "label int, logits array<double>")
    ce = np.array([np.log(1 + np.exp(-2.0)), np.log(2.0)])
    want = (1 - np.exp(-ce)) ** 2 * np.array([0.25, 0.75]) * ce
    rows = M.focal_loss(df, alpha=[0.25, 0.75], reduction="none").collect()
    assert [r["focal"] for r in rows][:2] == pytest.approx(want) and rows[2]["focal"] is None
    for how, v in (("mean", want.mean()), ("sum", want.sum())):
        assert M.focal_loss(df, alpha=[0.25, 0.75], reduction=how).first()["focal"] == pytest.approx(v)
