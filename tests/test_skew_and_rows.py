"""Skewed keys, row-local fingerprints and bounded-batch losses."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.operators import metrics as M
from assaylake.operators import molecules as MO
from assaylake.operators import splits as SP
from assaylake.operators.ranking import sequence_shift
from assaylake.sources import tables as S

from .conftest import SF_SMALL


def _skewed(spark):
    # one user holds a third of all events (derived from the driver table)
    ev = S.table(spark, SF_SMALL, "events")
    n = ev.count()
    return ev.withColumn("user_id", F.when(F.col("event_id") < n // 3, F.lit(-1)).otherwise(F.col("user_id")))


def test_sequence_shift_matches_lag_on_hot_key(spark):
    ev = _skewed(spark).withColumn("t", F.col("event_id").cast("double") * 7 % 1000)
    got = sequence_shift(ev, "user_id", "t", ["event_id"], ["value"], offset=-1, suffix="_prev")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    ref = ev.withColumn("value_prev_ref", F.lag("value").over(w))
    j = got.join(ref.select("event_id", "value_prev_ref"), "event_id")
    assert j.where(~F.col("value_prev").eqNullSafe(F.col("value_prev_ref"))).count() == 0
    assert got.count() == ev.count()


def test_stratified_folds_on_hot_label(spark):
    ev = _skewed(spark)
    st = SP.stratified_kfold(ev, "event_id", "user_id", 5)
    hot = st.where("user_id = -1").groupBy("fold").count().collect()
    sizes = sorted(r["count"] for r in hot)
    assert len(sizes) == 5 and sizes[-1] - sizes[0] <= 1


def test_draw_per_group_hot_group(spark):
    ev = _skewed(spark).select("user_id", "event_id")
    d = SP.draw_per_group(ev, "user_id", "event_id", 3)
    groups = ev.select("user_id").distinct().count()
    assert d.count() == 3 * groups


def test_fingerprint_rows_equal_tables(spark):
    m = S.molecules(spark, SF_SMALL)
    atoms, bonds = MO.mol_graph(m, both_directions=True)
    a = MO.circular_fingerprint(atoms, bonds, radius=2, n_bits=2048)
    b = MO.circular_fingerprint_rows(m, radius=2, n_bits=2048)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_contrast_losses_bounded_batches(spark):
    import numpy as np
    rows = [(i // 4, i, [float(i % 3), 1.0], [1.0, float(i % 2)]) for i in range(8)]
    df = spark.createDataFrame(rows, "batch long, id long, a array<double>, b array<double>")
    out = {r.batch: r for r in M.contrast_losses(df, "batch", "id", "a", "b", temperature=0.5).collect()}
    A = np.array([r[2] for r in rows[:4]])
    B = np.array([r[3] for r in rows[:4]])
    S_ = A @ B.T / 0.5
    ref = np.mean(np.log(np.exp(S_).sum(axis=1)) - np.diag(S_))
    assert abs(out[0].contrast - ref) < 1e-9 and out[0].n == 4


def test_pattern_joins_equal_trying_all_atom_tuples(spark):
    import itertools
    from collections import defaultdict

    from assaylake.operators import subgraph as SG
    atoms, bonds = MO.mol_graph(S.molecules(spark, SF_SMALL).where("mol_id <= 60"), both_directions=True)
    got = {r["mol_id"]: r for r in MO.fragment_counts(atoms, bonds).collect()}
    per_mol, order = defaultdict(dict), defaultdict(dict)
    for r in SG.match_tables(atoms, bonds, MO._valence())[0].collect():
        per_mol[r["mol_id"]][r["atom"]] = r
    for r in bonds.collect():
        order[r["mol_id"]][r["src"], r["dst"]] = r["bond_order"]
    names = {"symbol": "symbol", "charge": "charge", "aromatic": "aromatic", "degree": "degree", "bonded": "bonded", "hydrogens": "explicit_h"}
    some = 0
    for m, at in per_mol.items():
        for p in SG.FRAGMENTS:
            fits = [[i for i, r in at.items() if all(getattr(x, a) in (None, r[c]) for a, c in names.items())] for x in p.atoms]
            found = {frozenset(t) for t in itertools.product(*fits)
                     if len(set(t)) == len(t) and all(order[m].get((t[a], t[b])) == o for a, b, o in p.bonds)}
            assert got[m][p.name] == len(found), (m, p.name)
            some += len(found)
    assert len(got) == len(per_mol) and some > 20
