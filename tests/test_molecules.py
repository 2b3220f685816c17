"""Hand-worked molecules for the structure parse, validity and descriptors."""

from pyspark.sql import functions as F

from assaylake.functions.smiles import valid_smiles
from assaylake.operators import molecules as MO
from assaylake.operators import tokens as TK


def _graph(spark, smiles):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(smiles)], "mol_id long, smiles string")
    return MO.mol_graph(df)


def _edges(bonds, mol):
    return sorted((r.src, r.dst, r.bond_order) for r in bonds.where(F.col("mol_id") == mol).collect())


def test_chain_ring_branch(spark):
    atoms, bonds = _graph(spark, ["CCO", "c1ccccc1", "CC(C)(N)O", "C1CC1C(=O)N", "C.C"])
    assert _edges(bonds, 0) == [(0, 1, 1), (1, 2, 1)]
    # benzene: six aromatic bonds including the ring closure 0-5
    assert _edges(bonds, 1) == sorted([(0, 1, 12), (1, 2, 12), (2, 3, 12), (3, 4, 12), (4, 5, 12), (0, 5, 12)])
    # second branch hangs off the same parent atom (1), not the previous branch
    assert _edges(bonds, 2) == [(0, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1)]
    assert _edges(bonds, 3) == sorted([(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (3, 4, 2), (3, 5, 1)])
    assert _edges(bonds, 4) == []  # disconnected components
    n_atoms = {r.mol_id: r.n for r in atoms.groupBy("mol_id").agg(F.count("*").alias("n")).collect()}
    assert n_atoms == {0: 3, 1: 6, 2: 5, 3: 6, 4: 2}


def test_bracket_atom_charge_and_h(spark):
    atoms, _ = _graph(spark, ["[NH4+]", "C[C@@H](O)[O-]"])
    rows = {(r.mol_id, r.atom): r for r in atoms.collect()}
    assert rows[(0, 0)].symbol == "N" and rows[(0, 0)].charge == 1 and rows[(0, 0)].explicit_h == 4
    assert rows[(1, 1)].chiral and rows[(1, 1)].explicit_h == 1
    assert rows[(1, 3)].charge == -1


def test_valid_flag(spark):
    cases = [("CCO", True), ("c1ccccc1", True), ("", False), ("C1CC", False), ("CC(", False),
             ("CC)C(", False), ("[NH4+]", True), ("C.C", True)]
    df = spark.createDataFrame(cases, "smiles string, expected boolean")
    got = df.select("expected", valid_smiles("smiles").alias("v")).collect()
    assert all(r.expected == r.v for r in got)


def test_token_descriptors(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "c1ccccc1"), (2, "[NH4+]")], "mol_id long, smiles string")
    d = {r.mol_id: r for r in TK.token_descriptors(TK.smiles_tokens(df), TK.elements(spark)).collect()}
    assert d[0].heavy_atoms == 3 and d[0].no_count == 1 and d[0].hetero_atoms == 1
    assert abs(d[0].heavy_mol_wt - (2 * 12.011 + 15.999)) < 1e-9
    assert d[1].aromatic_atoms == 6 and d[1].ring_closures == 1
    assert d[2].formal_charge == 1


def test_fingerprint_set_semantics(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "OCC")], "mol_id long, smiles string")
    atoms, bonds = MO.mol_graph(df, both_directions=True)
    fp = MO.circular_fingerprint(atoms, bonds, radius=2, n_bits=2048)
    b = {m: sorted(r.bit for r in fp.where(F.col("mol_id") == m).collect()) for m in (0, 1)}
    # the same molecule written two ways has the same environments
    assert b[0] == b[1] and len(b[0]) > 0


def test_ring_links_are_single(spark):
    _, bonds = _graph(spark, ["c1ccccc1c1ccccc1", "c1ccc2ccccc2c1"])
    biphenyl = _edges(bonds, 0)
    assert (5, 6, 1) in biphenyl  # the link between the two rings
    assert sum(1 for e in biphenyl if e[2] == 12) == 12
    naphthalene = _edges(bonds, 1)
    assert all(e[2] == 12 for e in naphthalene) and len(naphthalene) == 11


def test_hydrogens_added(spark):
    atoms, bonds = _graph(spark, ["CCO", "c1ccccc1", "[NH4+]", "C=O"])
    atoms_h, bonds_h = MO.add_hydrogens(atoms, bonds)
    n_h = {r.mol_id: r.n for r in atoms_h.where("symbol = 'H'").groupBy("mol_id").agg(F.count("*").alias("n")).collect()}
    assert n_h == {0: 6, 1: 6, 2: 4, 3: 2}
    # hydrogen ids follow the heavy atoms
    assert sorted(r.atom for r in atoms_h.where("mol_id = 0").collect()) == list(range(9))
