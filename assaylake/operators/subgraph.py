"""Counting a small labelled pattern in molecule graphs.

A pattern is a table of atoms with conditions and a table of bonds. Its matches
grow by one join a pattern atom: the bonds of an atom matched before lead to the
next one. Matches on the same set of atoms (the pattern's own symmetries) count
once."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


@dataclass(frozen=True)
class Atom:
    """Conditions on an atom; None asks for nothing. ``bonded``: the sum of its
    bond orders, ``degree``: its neighbours, ``hydrogens``: those written in its
    bracket."""
    symbol: str
    charge: int | None = None
    aromatic: bool | None = None
    degree: int | None = None
    bonded: float | None = None
    hydrogens: int | None = None

    def holds(self, prefix: str) -> Column:
        asked = {"symbol": self.symbol, "charge": self.charge, "aromatic": self.aromatic, "degree": self.degree,
                 "bonded": self.bonded, "explicit_h": self.hydrogens}
        return functools.reduce(Column.__and__, [F.col(prefix + c) == F.lit(v) for c, v in asked.items() if v is not None])


@dataclass(frozen=True)
class Pattern:
    """``bonds`` are (atom, atom, order); the bonds that come first must lead
    from an atom that is matched to the next one, in the order of ``atoms``."""
    name: str
    atoms: tuple[Atom, ...]
    bonds: tuple[tuple[int, int, int], ...] = ()

    def steps(self) -> list[tuple[int, int, int]]:
        """For atoms 1, 2, ...: the bond by which each is reached."""
        out = []
        for k in range(1, len(self.atoms)):
            via = [(a, b, o) for x, y, o in self.bonds for a, b in ((x, y), (y, x)) if b == k and a < k]
            if not via:
                raise ValueError(f"{self.name}: no bond leads to atom {k} from one before it")
            out.append(via[0])
        return out


#: the five counted groups
FRAGMENTS = (
    Pattern("carboxyl", (Atom("C"), Atom("O"), Atom("O")), ((0, 1, 2), (0, 2, 1))),
    Pattern("nh2", (Atom("N", charge=0, aromatic=False, degree=1, bonded=1.0),)),
    Pattern("nh4", (Atom("N", charge=1, hydrogens=4),)),
    Pattern("sulfonic", (Atom("S"), Atom("O"), Atom("O"), Atom("O", charge=-1)), ((0, 1, 2), (0, 2, 2), (0, 3, 1))),
    Pattern("c_o", (Atom("C"), Atom("O")), ((0, 1, 1),)),
)

_PROPERTIES = ("symbol", "charge", "aromatic", "degree", "bonded", "explicit_h")


def matches(atoms: DataFrame, bonds: DataFrame, pattern: Pattern, key: str = "mol_id") -> DataFrame:
    """(key, found): the atom sets on which ``pattern`` matches. ``atoms`` and
    ``bonds`` are the tables of :func:`match_tables`."""
    m = atoms.where(pattern.atoms[0].holds("")).select(key, F.col("atom").alias("a0"))
    steps = pattern.steps()
    for k, (a, _, order) in enumerate(steps, 1):
        reach = bonds.where((F.col("bond_order") == order) & pattern.atoms[k].holds("d_")).select(
            key, F.col("src").alias(f"a{a}"), F.col("dst").alias(f"a{k}"))
        m = m.join(reach, [key, f"a{a}"])
        for j in range(k):
            m = m.where(F.col(f"a{j}") != F.col(f"a{k}"))
    used = {frozenset(s[:2]) for s in steps}
    for a, b, order in pattern.bonds:
        if frozenset((a, b)) not in used:                # closes a ring of the pattern
            close = bonds.where(F.col("bond_order") == order).select(key, F.col("src").alias(f"a{a}"), F.col("dst").alias(f"a{b}"))
            m = m.join(close, [key, f"a{a}", f"a{b}"], "left_semi")
    return m.select(key, F.array_sort(F.array(*[f"a{k}" for k in range(len(pattern.atoms))])).alias("found")).distinct()


def match_tables(atoms: DataFrame, bonds_both: DataFrame, valence: Column, key: str = "mol_id") -> tuple[DataFrame, DataFrame]:
    """Atoms with degree and bonded valence, and bonds (both directions) with
    the properties of the atom that they lead to, each written once."""
    per = bonds_both.groupBy(key, F.col("src").alias("atom")).agg(
        F.count(F.lit(1)).cast("int").alias("degree"), F.sum(valence).cast("double").alias("bonded"))
    a = written(atoms.join(per, [key, "atom"], "left").fillna({"degree": 0, "bonded": 0.0})
                .select(key, "atom", *_PROPERTIES), "match-atoms")
    to = a.select(key, F.col("atom").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in _PROPERTIES])
    return a, written(bonds_both.select(key, "src", "dst", "bond_order").join(to, [key, "dst"]), "match-bonds")


def count_patterns(atoms: DataFrame, bonds_both: DataFrame, valence: Column, patterns: Sequence[Pattern] = FRAGMENTS,
                   key: str = "mol_id") -> DataFrame:
    """One row a molecule (those without a match too) with a count for each pattern."""
    a, b = match_tables(atoms, bonds_both, valence, key)
    found = [matches(a, b, p, key).select(key, F.lit(p.name).alias("_name")) for p in patterns]
    keys = a.select(key, F.lit(None).cast("string").alias("_name")).distinct()
    return functools.reduce(DataFrame.unionByName, found, keys).groupBy(key).agg(
        *[F.count_if(F.col("_name") == p.name).alias(p.name) for p in patterns])
