"""Molecule graph tables and fingerprints.

``mol_graph`` parses each structure string with one ``aggregate`` fold over
its token array (a JVM-side higher-order function, no Python): the
accumulator carries the atom counter, the previous atom, the branch stack,
open ring labels, the pending bond symbol and the emitted edges. Atoms and
bonds then become long tables keyed by ``mol_id``; every later operator is a
join / group-by on those keys, so work is partitioned per molecule.

Bond order rule: an explicit symbol wins; otherwise a bond between two
aromatic atoms that lies on a ring is aromatic and any other bond single (so
a link between two aromatic rings, as in biphenyl, is single). Ring bonds
are found from the parse itself: each ring closure closes the tree path
between its two atoms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.smiles import ATOM_RE, RING_RE, tokens as token_array
from ..functions.vectors import let
from ..session import spread, written
from .subgraph import count_patterns
from .tokens import atom_columns, join_elements

BOND_RE = r"^[-=#$:/\\]$"
AROMATIC_RE = r"^([bcnops]|\[[0-9]*(?:se|as|[bcnops](?![a-z])).*\])$"
EDGE_T = "array<struct<src:int,dst:int,bond:string,ring:boolean>>"
RING_T = "array<struct<label:string,atom:int,bond:string>>"

# Bond symbol -> bond order code (1 single, 2 double, 3 triple,
# 4 quadruple, 12 aromatic; '/' and '\\' are single bonds with direction).
BOND_CODES = {"": 1, "-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": 12}


def _fold(toks: Column) -> Column:
    init = F.struct(
        F.lit(0).alias("n"), F.lit(-1).alias("prev"),
        F.array().cast("array<int>").alias("stack"),
        F.array().cast(RING_T).alias("rings"),
        F.lit("").alias("bond"),
        F.array().cast(EDGE_T).alias("edges"),
        F.array().cast("array<boolean>").alias("arom"),
        F.array().cast("array<int>").alias("par"),
    )

    def step(acc, t):
        is_atom = t.rlike(ATOM_RE)
        is_ring = t.rlike(RING_RE)
        match = F.filter(acc["rings"], lambda r: r["label"] == t)
        has_open = F.size(match) > 0
        opened = F.element_at(match, 1)
        atom_edge = F.struct(acc["prev"].alias("src"), acc["n"].alias("dst"), acc["bond"].alias("bond"),
                             F.lit(False).alias("ring"))
        ring_edge = F.struct(opened["atom"].alias("src"), acc["prev"].alias("dst"),
                             F.when(acc["bond"] != "", acc["bond"]).otherwise(opened["bond"]).alias("bond"),
                             F.lit(True).alias("ring"))
        return F.struct(
            F.when(is_atom, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(is_atom, acc["n"]).when(t == ")", F.try_element_at(acc["stack"], F.lit(-1)))
             .when(t == ".", F.lit(-1)).otherwise(acc["prev"]).alias("prev"),
            F.when(t == "(", F.concat(acc["stack"], F.array(acc["prev"])))
             .when(t == ")", F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0))))
             .otherwise(acc["stack"]).alias("stack"),
            F.when(is_ring & has_open, F.filter(acc["rings"], lambda r: r["label"] != t))
             .when(is_ring, F.concat(acc["rings"], F.array(F.struct(
                 t.alias("label"), acc["prev"].alias("atom"), acc["bond"].alias("bond")))))
             .otherwise(acc["rings"]).alias("rings"),
            F.when(t.rlike(BOND_RE), t).when(is_atom | is_ring, F.lit("")).otherwise(acc["bond"]).alias("bond"),
            F.when(is_atom & (acc["prev"] >= 0), F.concat(acc["edges"], F.array(atom_edge)))
             .when(is_ring & has_open, F.concat(acc["edges"], F.array(ring_edge)))
             .otherwise(acc["edges"]).alias("edges"),
            F.when(is_atom, F.concat(acc["arom"], F.array(t.rlike(AROMATIC_RE)))).otherwise(acc["arom"]).alias("arom"),
            F.when(is_atom, F.concat(acc["par"], F.array(acc["prev"]))).otherwise(acc["par"]).alias("par"),
        )

    return F.aggregate(toks, init, step)


def _ancestors(par: Column, x: Column) -> Column:
    """[x, parent(x), parent(parent(x)), ...] up to the component root."""
    return F.aggregate(F.sequence(F.lit(0), F.size(par)), F.array(x),
                       lambda acc, _: F.when(F.element_at(par, F.element_at(acc, -1) + 1) >= 0,
                                             F.concat(acc, F.array(F.element_at(par, F.element_at(acc, -1) + 1))))
                       .otherwise(acc))


def _ring_children(acc: Column) -> Column:
    """Atoms whose tree bond to their parent lies on a cycle. Each ring
    closure (a, b) closes the tree path a..lca..b; since a parent always has
    a smaller index than its child, lca = max(common ancestors) and the path
    atoms are the ancestors of a or b above it."""
    par = acc["par"]

    def on_cycle(e):
        return let(_ancestors(par, e["src"]), lambda aa: let(_ancestors(par, e["dst"]), lambda ab: let(
            F.array_max(F.array_intersect(aa, ab)),
            lambda lca: F.filter(F.array_union(aa, ab), lambda x: x > lca))))

    closures = F.filter(acc["edges"], lambda e: e["ring"])
    return F.array_distinct(F.flatten(F.transform(closures, on_cycle)))


def typed_edges(acc: Column) -> Column:
    """Fold edges with bond order code and ring flag (struct src, dst, bond, bond_order, in_ring).
    ``acc`` must be a bound value (a column or lambda variable)."""
    arom = acc["arom"]
    return let(_ring_children(acc), lambda kids: F.transform(acc["edges"], lambda e: F.struct(
        e["src"].alias("src"), e["dst"].alias("dst"), e["bond"].alias("bond"),
        _bond_code(e["bond"], F.element_at(arom, e["src"] + 1), F.element_at(arom, e["dst"] + 1),
                   e["ring"] | F.array_contains(kids, e["dst"])).alias("bond_order"),
        (e["ring"] | F.array_contains(kids, e["dst"])).alias("in_ring"))))


def _bond_code(bond: Column, a_src: Column, a_dst: Column, in_ring: Column) -> Column:
    code = F.when((bond == "") & a_src & a_dst & in_ring, F.lit(12))
    for sym, c in BOND_CODES.items():
        code = code.when(bond == sym, F.lit(c))
    return code.otherwise(F.lit(1))


def mol_graph(df: DataFrame, key: str = "mol_id", col: str = "smiles",
              both_directions: bool = False) -> tuple[DataFrame, DataFrame]:
    """``atoms(key, atom, token, symbol, aromatic, charge, explicit_h, chiral)``
    and ``bonds(key, src, dst, bond, bond_order, in_ring)``. Bonds are listed once (src <
    dst order of appearance) unless ``both_directions``."""
    toks = spread(df.select(key, col), key).select(key, token_array(col).alias("_t"))
    parsed = toks.select(key, "_t", let(_fold(F.col("_t")), lambda acc: F.struct(
        typed_edges(acc).alias("edges"))).alias("_acc"))
    # atoms and bonds come from the same parse
    parsed = written(parsed, "parsed", grows=True)
    atoms = parsed.select(key, F.posexplode(F.filter("_t", lambda t: t.rlike(ATOM_RE))).alias("atom", "token"))
    ac = atom_columns(F.col("token"))
    atoms = atoms.select(key, F.col("atom").cast("int").alias("atom"), "token", *[v.alias(k) for k, v in ac.items()])
    # bond order from the symbol and the aromatic flags of both ends, all
    # inside the row: no join back to the atom table
    bonds = parsed.select(key, F.explode("_acc.edges").alias("e")).select(
        key, "e.src", "e.dst", "e.bond", "e.bond_order", "e.in_ring")
    if both_directions:
        bonds = symmetric(bonds, key)
    return atoms, bonds


def symmetric(bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """Both directions of every bond, emitted from its one row."""
    back = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return bonds.select(F.inline(F.array(F.struct(*bonds.columns), F.struct(*[back.get(c, F.col(c)) for c in bonds.columns]))))


def degree(atoms: DataFrame, bonds_both: DataFrame, key: str = "mol_id") -> DataFrame:
    """Degree per atom including isolated atoms (0)."""
    d = bonds_both.groupBy(key, F.col("src").alias("atom")).agg(F.count(F.lit(1)).cast("int").alias("degree"))
    return atoms.select(key, "atom").join(d, [key, "atom"], "left").fillna(0, ["degree"])


def atom_features(atoms: DataFrame, bonds_both: DataFrame, elems: DataFrame, key: str = "mol_id") -> DataFrame:
    """Per atom: atomic number (0 for an unlisted element), degree, aromatic,
    charge, explicit H, chirality flag, in-ring flag, total hydrogens. One
    aggregate over the bonds serves degree, ring flag and bonded valence."""
    per = bonds_both.groupBy(key, F.col("src").alias("atom")).agg(
        F.count(F.lit(1)).cast("int").alias("degree"), F.bool_or("in_ring").alias("in_ring"),
        F.sum(_valence()).alias("_bv"))
    a = join_elements(atoms.join(per, [key, "atom"], "left"), elems.select("symbol", "z")).fillna(
        {"degree": 0, "in_ring": False, "_bv": 0.0})
    return a.select(key, "atom", "z", "degree", "aromatic", "charge", "explicit_h", "chiral", "in_ring",
                    _hydrogens().alias("n_h"))


def hex_hash(*cols: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8)


def circular_fingerprint(atoms: DataFrame, bonds_both: DataFrame, radius: int = 2, n_bits: int = 2048,
                         key: str = "mol_id") -> DataFrame:
    """Morgan-style environments: round 0 id = hash of atom invariants
    (symbol, degree, charge, aromatic, explicit H); round r id = hash of the
    previous id and the sorted (bond order, neighbour id) list. All ids of
    rounds 0..r are folded to ``n_bits`` and de-duplicated per molecule.
    Each round is one join on (mol_id, atom) and one group-by."""
    deg = degree(atoms, bonds_both, key)
    a = atoms.join(deg, [key, "atom"])
    cur = a.select(key, "atom", hex_hash(F.col("symbol"), F.col("degree").cast("string"),
                                         F.col("charge").cast("string"), F.col("aromatic").cast("string"),
                                         F.col("explicit_h").cast("string")).alias("hid"))
    ids = [cur.select(key, "hid")]
    for r in range(1, radius + 1):
        nb = bonds_both.select(key, F.col("src").alias("atom"), F.col("dst").alias("nbr"), "bond_order")
        nb = nb.join(cur.select(key, F.col("atom").alias("nbr"), F.col("hid").alias("nhid")), [key, "nbr"])
        env = nb.groupBy(key, "atom").agg(F.array_join(F.array_sort(F.collect_list(
            F.concat_ws(":", F.col("bond_order").cast("string"), F.col("nhid")))), ",").alias("_env"))
        cur = cur.join(env, [key, "atom"], "left").select(
            key, "atom", hex_hash(F.lit(str(r)), F.col("hid"), F.coalesce(F.col("_env"), F.lit(""))).alias("hid"))
        ids.append(cur.select(key, "hid"))
    allids = ids[0]
    for x in ids[1:]:
        allids = allids.unionByName(x)
    bit = F.pmod(F.conv(F.col("hid"), 16, 10).cast("bigint"), F.lit(n_bits))
    return allids.select(key, bit.alias("bit")).distinct()


def concat_fingerprints(key: str, *blocks: tuple[DataFrame, int]) -> DataFrame:
    """Concatenate bit blocks (df(key, bit), width): block i is shifted by the
    widths before it."""
    out, off = None, 0
    for df, width in blocks:
        part = df.select(key, (F.col("bit") + F.lit(off)).alias("bit"))
        out = part if out is None else out.unionByName(part)
        off += width
    return out


def fragment_counts(atoms: DataFrame, bonds_both: DataFrame, key: str = "mol_id") -> DataFrame:
    """Matches of the five groups of :data:`subgraph.FRAGMENTS` per molecule:
    carboxyl C(=O)O, primary amine, ammonium, charged sulfonate S(=O)(=O)[O-] and
    single C-O bonds, each set of atoms once."""
    return count_patterns(atoms, bonds_both, _valence(), key=key)


def _idx(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(F.array().cast("array<int>"))


def _morgan_rounds(atoms: Column, both: Column, radius: int) -> Column:
    """All environment ids of rounds 0..radius for one molecule; every round
    is bound once with :func:`let`."""
    def inv(i):
        ac = atom_columns(F.element_at(atoms, i + 1))
        deg = F.size(F.filter(both, lambda e: e["a"] == i))
        return hex_hash(ac["symbol"], deg.cast("string"), ac["charge"].cast("string"),
                        ac["aromatic"].cast("string"), ac["explicit_h"].cast("string"))

    def step(prev: Column, r: int):
        def one(i):
            env = F.array_join(F.array_sort(F.transform(
                F.filter(both, lambda e: e["a"] == i),
                lambda e: F.concat_ws(":", e["o"].cast("string"), F.element_at(prev, e["b"] + 1)))), ",")
            return hex_hash(F.lit(str(r)), F.element_at(prev, i + 1), env)
        return F.transform(_idx(prev), one)

    def go(prev: Column, r: int, acc: Column) -> Column:
        if r > radius:
            return acc
        return let(step(prev, r), lambda h: go(h, r + 1, F.concat(acc, h)))

    return let(F.transform(_idx(atoms), inv), lambda h0: go(h0, 1, h0))


def circular_fingerprint_rows(df: DataFrame, key: str = "mol_id", col: str = "smiles", radius: int = 2,
                              n_bits: int = 2048) -> DataFrame:
    """Same environments as :func:`circular_fingerprint`, computed inside each
    row: parse fold -> atom invariants -> ``radius`` rounds of neighbour
    hashing with ``transform``/``filter`` over the row's own atom and bond
    arrays. A molecule never leaves its row, so there is no join and no
    shuffle besides exploding the per-molecule distinct bit list.
    Intermediate arrays are bound once per row (:func:`let`)."""
    def per_row(t):
        def with_edges(acc):
            return let(typed_edges(acc), lambda E: let(
                F.concat(F.transform(E, lambda e: F.struct(e["src"].alias("a"), e["dst"].alias("b"),
                                                           e["bond_order"].alias("o"))),
                         F.transform(E, lambda e: F.struct(e["dst"].alias("a"), e["src"].alias("b"),
                                                           e["bond_order"].alias("o")))),
                lambda B: let(F.filter(t, lambda x: x.rlike(ATOM_RE)),
                              lambda A: _morgan_rounds(A, B, radius))))
        return let(_fold(t), with_edges)

    d = spread(df.select(key, col), key).select(key, token_array(col).alias("_t"))
    ids = let(F.col("_t"), per_row)
    bits = F.array_distinct(F.transform(ids, lambda h: F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(n_bits))))
    return d.select(key, F.explode(bits).alias("bit"))


# Allowed valences of the organic-subset elements used for
# implicit hydrogens (the smallest allowed valence >= bonded valence is used).
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "P": [3, 5], "S": [2, 4, 6],
            "F": [1], "Cl": [1], "Br": [1], "I": [1]}


def hydrogen_counts(atoms: DataFrame, bonds_both: DataFrame, key: str = "mol_id") -> DataFrame:
    """Total hydrogens per heavy atom: explicit H of bracket atoms; for
    organic-subset atoms the implicit H = smallest allowed valence >= bonded
    valence minus the bonded valence (aromatic bonds count 1.5, rounded
    down)."""
    bv = bonds_both.groupBy(key, F.col("src").alias("atom")).agg(F.sum(_valence()).alias("_bv"))
    a = atoms.join(bv, [key, "atom"], "left").fillna(0.0, ["_bv"])
    return a.select(key, "atom", _hydrogens().alias("n_h"))


def _valence() -> Column:
    return F.when(F.col("bond_order") == 12, F.lit(1.5)).otherwise(F.col("bond_order").cast("double"))


def _hydrogens() -> Column:
    """Hydrogens of an atom row with its bonded valence ``_bv``."""
    allowed = F.create_map(*[x for sym, vs in VALENCES.items()
                             for x in (F.lit(sym), F.array(*[F.lit(v) for v in vs]))])
    vals = F.element_at(allowed, F.col("symbol"))
    bvi = F.floor(F.col("_bv")).cast("int")
    target = F.array_min(F.filter(vals, lambda v: v >= bvi))
    implicit = F.coalesce(target - bvi, F.lit(0))
    return F.when(F.col("token").startswith("["), F.col("explicit_h")).otherwise(implicit).cast("int")


def add_hydrogens(atoms: DataFrame, bonds: DataFrame, key: str = "mol_id"):
    """Graph convention with hydrogens as atoms: H atoms get ids after the
    heavy atoms of their molecule (ordered by parent atom) and a single bond
    to their parent. Returns (atoms_h(key, atom, symbol), bonds_h(key, src,
    dst, bond_order)), bonds listed once."""
    from pyspark.sql import Window
    both = symmetric(bonds, key)
    hc = hydrogen_counts(atoms, both, key)
    n_heavy = atoms.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    # per molecule (a bounded group): exclusive running count of hydrogens
    w = Window.partitionBy(key).orderBy("atom").rowsBetween(Window.unboundedPreceding, -1)
    hc = hc.withColumn("_off", F.coalesce(F.sum("n_h").over(w), F.lit(0)))
    hs = hc.join(n_heavy, key).where("n_h > 0").select(
        key, F.col("atom").alias("src"),
        F.explode(F.sequence(F.lit(0), F.col("n_h") - 1)).alias("_k"), "_n", "_off")
    hs = hs.select(key, "src", (F.col("_n") + F.col("_off") + F.col("_k")).cast("int").alias("dst"))
    atoms_h = atoms.select(key, "atom", "symbol").unionByName(
        hs.select(key, F.col("dst").alias("atom"), F.lit("H").alias("symbol")))
    bonds_h = bonds.select(key, "src", "dst", "bond_order").unionByName(
        hs.select(key, "src", "dst", F.lit(1).alias("bond_order")))
    return atoms_h, bonds_h
