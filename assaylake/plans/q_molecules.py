"""Registered molecule-graph queries (M7-M12). The DuckDB oracle parses the
structure strings with a recursive CTE that steps token by token (stack,
open rings and pending bond as columns) – an independent formulation of the
Spark ``aggregate`` fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.smiles import ATOM_RE, RING_RE, sql_tokens
from ..operators import molecules as MO
from ..operators import tokens as TK
from ..sources import tables as S
from .q_tokens import ATOMS_SQL, TOKENS_SQL
from .registry import query, with_ctes

WALK_SQL = f"""
SELECT mol_id, t, 0 AS i, 0 AS n, -1 AS prev, CAST([] AS INTEGER[]) AS stack,
       CAST([] AS STRUCT(label VARCHAR, atom INTEGER, bond VARCHAR)[]) AS rings, '' AS bond,
       CAST(NULL AS STRUCT(src INTEGER, dst INTEGER, bond VARCHAR, ring BOOLEAN)) AS edge
FROM (SELECT mol_id, {sql_tokens('smiles')} AS t FROM molecules) m
UNION ALL
SELECT mol_id, t, i + 1,
  CASE WHEN is_atom THEN n + 1 ELSE n END,
  CASE WHEN is_atom THEN n WHEN tok = ')' THEN stack[len(stack)] WHEN tok = '.' THEN -1 ELSE prev END,
  CASE WHEN tok = '(' THEN list_append(stack, prev) WHEN tok = ')' THEN stack[1:len(stack) - 1] ELSE stack END,
  CASE WHEN is_ring AND len(om) > 0 THEN list_filter(rings, lambda r: r.label <> tok)
       WHEN is_ring THEN list_append(rings, {{'label': tok, 'atom': prev, 'bond': bond}}) ELSE rings END,
  CASE WHEN regexp_matches(tok, '^[-=#$:/\\\\]$') THEN tok WHEN is_atom OR is_ring THEN '' ELSE bond END,
  CASE WHEN is_atom AND prev >= 0 THEN {{'src': prev, 'dst': n, 'bond': bond, 'ring': false}}
       WHEN is_ring AND len(om) > 0 THEN {{'src': om[1].atom, 'dst': prev,
                                           'bond': CASE WHEN bond <> '' THEN bond ELSE om[1].bond END, 'ring': true}}
       ELSE NULL END
FROM (SELECT *, list_filter(rings, lambda r: r.label = tok) AS om
      FROM (SELECT w.*, w.t[w.i + 1] AS tok, regexp_matches(w.t[w.i + 1], '{ATOM_RE}') AS is_atom,
                   regexp_matches(w.t[w.i + 1], '{RING_RE}') AS is_ring
            FROM walk w WHERE w.i < len(w.t)) s) s2"""

GATOMS_SQL = f"""
SELECT a.mol_id, CAST(row_number() OVER (PARTITION BY a.mol_id ORDER BY a.pos) - 1 AS INTEGER) AS atom,
       a.token, a.symbol, a.aromatic, a.charge, a.explicit_h, a.chiral
FROM atoms a"""

REDGES_SQL = "SELECT mol_id, edge.src AS src, edge.dst AS dst, edge.bond AS bond, edge.ring AS ring FROM walk WHERE edge IS NOT NULL"

# ancestors of both ends of every ring closure, walking tree edges upwards
ANC_SQL = """
SELECT * FROM (SELECT mol_id, src AS ca, dst AS cb, src AS start, src AS node FROM redges WHERE ring
               UNION ALL SELECT mol_id, src, dst, dst, dst FROM redges WHERE ring) a0
UNION ALL
SELECT a.mol_id, a.ca, a.cb, a.start, p.src FROM anc a JOIN redges p ON p.mol_id = a.mol_id AND p.dst = a.node AND NOT p.ring"""

RINGKIDS_SQL = """
SELECT DISTINCT a.mol_id, a.node FROM anc a
JOIN (SELECT mol_id, ca, cb, max(node) AS lca FROM (
        SELECT mol_id, ca, cb, node FROM anc WHERE start = ca
        INTERSECT SELECT mol_id, ca, cb, node FROM anc WHERE start = cb) c GROUP BY mol_id, ca, cb) l
  ON a.mol_id = l.mol_id AND a.ca = l.ca AND a.cb = l.cb
WHERE a.node > l.lca"""

BONDS_SQL = """
SELECT b.mol_id, b.src, b.dst, b.bond,
  CASE WHEN b.bond = '' AND s.aromatic AND d.aromatic AND b.in_ring THEN 12
       WHEN b.bond IN ('', '-', '/', '\\') THEN 1 WHEN b.bond = '=' THEN 2 WHEN b.bond = '#' THEN 3
       WHEN b.bond = '$' THEN 4 WHEN b.bond = ':' THEN 12 ELSE 1 END AS bond_order, b.in_ring
FROM (SELECT *, ring OR EXISTS (SELECT 1 FROM ringkids k WHERE k.mol_id = e.mol_id AND k.node = e.dst) AS in_ring
      FROM redges e) b
JOIN gatoms s ON b.mol_id = s.mol_id AND b.src = s.atom
JOIN gatoms d ON b.mol_id = d.mol_id AND b.dst = d.atom"""

BOTH_SQL = """SELECT mol_id, src, dst, bond, bond_order, in_ring FROM bonds
UNION ALL SELECT mol_id, dst, src, bond, bond_order, in_ring FROM bonds"""

GRAPH = {"molecules": S.MOLECULES_SQL, "toks": TOKENS_SQL, "atoms": ATOMS_SQL, "gatoms": GATOMS_SQL,
         "walk": WALK_SQL, "redges": REDGES_SQL, "anc": ANC_SQL, "ringkids": RINGKIDS_SQL,
         "bonds": BONDS_SQL, "bonds2": BOTH_SQL}


def graph_ctes(**extra) -> dict:
    d = dict(GRAPH)
    d.update(extra)
    return d


def with_graph(body: str, **extra) -> str:
    return "WITH RECURSIVE " + with_ctes(body, **graph_ctes(**extra))[len("WITH "):]


def mol_graph(spark, sf, both=False):
    return MO.mol_graph(S.molecules(spark, sf), both_directions=both)


@query("mol_graph_tables", with_graph("SELECT mol_id, src, dst, bond, bond_order FROM bonds"))
def q_mol_graph_tables(spark, sf):
    return mol_graph(spark, sf)[1].select("mol_id", "src", "dst", "bond", "bond_order")


@query("mol_graph_atoms", with_graph(
    "SELECT mol_id, atom, token, symbol, aromatic, charge, explicit_h, chiral FROM gatoms"))
def q_mol_graph_atoms(spark, sf):
    return mol_graph(spark, sf)[0]


DEG_SQL = """
SELECT g.mol_id, g.atom, CAST(coalesce(d.degree, 0) AS INTEGER) AS degree
FROM gatoms g LEFT JOIN (SELECT mol_id, src AS atom, count(*) AS degree FROM bonds2 GROUP BY mol_id, src) d
  ON g.mol_id = d.mol_id AND g.atom = d.atom"""


def _fp_sql(radius: int, n_bits: int, name: str = "fp") -> dict:
    ctes = {"deg": DEG_SQL}
    ctes["h0"] = """
SELECT g.mol_id, g.atom, substr(md5(concat_ws('|', g.symbol, CAST(d.degree AS VARCHAR), CAST(g.charge AS VARCHAR),
       CAST(g.aromatic AS VARCHAR), CAST(g.explicit_h AS VARCHAR))), 1, 8) AS hid
FROM gatoms g JOIN deg d ON g.mol_id = d.mol_id AND g.atom = d.atom"""
    for rr in range(1, radius + 1):
        ctes[f"h{rr}"] = f"""
SELECT c.mol_id, c.atom, substr(md5(concat_ws('|', '{rr}', c.hid, coalesce(e.env, ''))), 1, 8) AS hid
FROM h{rr - 1} c LEFT JOIN (
  SELECT b.mol_id, b.src AS atom,
         array_to_string(list_sort(list(CAST(b.bond_order AS VARCHAR) || ':' || n.hid)), ',') AS env
  FROM bonds2 b JOIN h{rr - 1} n ON b.mol_id = n.mol_id AND b.dst = n.atom GROUP BY b.mol_id, b.src) e
  ON c.mol_id = e.mol_id AND c.atom = e.atom"""
    ctes[name] = " UNION ".join(
        f"SELECT DISTINCT mol_id, ('0x' || hid)::BIGINT % {n_bits} AS bit FROM h{rr}" for rr in range(radius + 1))
    return ctes


@query("circular_fingerprint", with_graph("SELECT mol_id, bit FROM fp", **_fp_sql(2, 2048)))
def q_circular_fingerprint(spark, sf):
    return MO.circular_fingerprint_rows(S.molecules(spark, sf), radius=2, n_bits=2048)


@query("fingerprint_concat", with_graph("""
SELECT mol_id, bit FROM fp UNION ALL SELECT mol_id, bit + 2048 AS bit FROM fp1""",
                                        **_fp_sql(2, 2048),
                                        fp1="SELECT DISTINCT mol_id, ('0x' || hid)::BIGINT % 1024 AS bit FROM h0 "
                                            "UNION SELECT DISTINCT mol_id, ('0x' || hid)::BIGINT % 1024 AS bit FROM h1"))
def q_fingerprint_concat(spark, sf):
    m = S.molecules(spark, sf)
    fp2 = MO.circular_fingerprint_rows(m, radius=2, n_bits=2048)
    fp1 = MO.circular_fingerprint_rows(m, radius=1, n_bits=1024)
    return MO.concat_fingerprints("mol_id", (fp2, 2048), (fp1, 1024))


@query("fragment_counts", with_graph("""
SELECT m.mol_id,
  CAST(coalesce(cx.n, 0) AS BIGINT) AS carboxyl, CAST(coalesce(nh2.n, 0) AS BIGINT) AS nh2,
  CAST(coalesce(nh4.n, 0) AS BIGINT) AS nh4, CAST(coalesce(su.n, 0) AS BIGINT) AS sulfonic,
  CAST(coalesce(co.n, 0) AS BIGINT) AS c_o
FROM (SELECT DISTINCT mol_id FROM gatoms) m
LEFT JOIN (SELECT mol_id, sum(n2 * n1) AS n FROM
             (SELECT mol_id, src, count(*) FILTER (WHERE bond_order = 2) AS n2, count(*) FILTER (WHERE bond_order = 1) AS n1
              FROM eb WHERE ss = 'C' AND ds = 'O' GROUP BY mol_id, src) c GROUP BY mol_id) cx ON m.mol_id = cx.mol_id
LEFT JOIN (SELECT g.mol_id, count(*) AS n FROM gatoms g JOIN
             (SELECT mol_id, src, count(*) AS dg, max(bond_order) AS mo FROM eb GROUP BY mol_id, src) x
             ON g.mol_id = x.mol_id AND g.atom = x.src
           WHERE g.symbol = 'N' AND g.charge = 0 AND NOT g.aromatic AND x.dg = 1 AND x.mo = 1
           GROUP BY g.mol_id) nh2 ON m.mol_id = nh2.mol_id
LEFT JOIN (SELECT mol_id, count(*) AS n FROM gatoms WHERE token = '[NH4+]' GROUP BY mol_id) nh4 ON m.mol_id = nh4.mol_id
LEFT JOIN (SELECT mol_id, sum(n2 * (n2 - 1) // 2 * n1) AS n FROM
             (SELECT mol_id, src, count(*) FILTER (WHERE bond_order = 2) AS n2,
                     count(*) FILTER (WHERE bond_order = 1 AND dc = -1) AS n1
              FROM eb WHERE ss = 'S' AND ds = 'O' GROUP BY mol_id, src) q GROUP BY mol_id) su ON m.mol_id = su.mol_id
LEFT JOIN (SELECT mol_id, count(*) AS n FROM eb WHERE ss = 'C' AND ds = 'O' AND bond_order = 1 GROUP BY mol_id) co
  ON m.mol_id = co.mol_id""", eb="""
SELECT b.mol_id, b.src, b.dst, b.bond_order, s.symbol AS ss, d.symbol AS ds, d.charge AS dc FROM bonds2 b
JOIN gatoms s ON b.mol_id = s.mol_id AND b.src = s.atom JOIN gatoms d ON b.mol_id = d.mol_id AND b.dst = d.atom"""))
def q_fragment_counts(spark, sf):
    return MO.fragment_counts(*mol_graph(spark, sf, both=True))


@query("element_one_hot_matrix", with_graph("""
SELECT g.mol_id, g.atom, coalesce(e.z, 0) AS z FROM gatoms g LEFT JOIN elems e ON g.symbol = e.symbol""", elems=TK.ELEMENTS_SQL))
def q_element_rows(spark, sf):
    atoms, _ = mol_graph(spark, sf)
    return TK.join_elements(atoms, TK.elements(spark)).select("mol_id", "atom", "z")


HCOUNT_SQL = """
SELECT g.mol_id, g.atom, g.symbol,
  CAST(CASE WHEN starts_with(g.token, '[') THEN g.explicit_h
       ELSE coalesce(list_min(list_filter(v.vals, lambda x: x >= CAST(floor(coalesce(b.bv, 0)) AS INTEGER)))
                     - CAST(floor(coalesce(b.bv, 0)) AS INTEGER), 0) END AS INTEGER) AS n_h
FROM gatoms g
LEFT JOIN (SELECT mol_id, src, sum(CASE WHEN bond_order = 12 THEN 1.5 ELSE bond_order END) AS bv
           FROM bonds2 GROUP BY mol_id, src) b ON g.mol_id = b.mol_id AND g.atom = b.src
LEFT JOIN vals v ON g.symbol = v.symbol"""


def _vals_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        f"('{s}', {list(v)})" for s, v in MO.VALENCES.items()) + ") AS t(symbol, vals)"


@query("atom_features", with_graph("""
SELECT g.mol_id, g.atom, coalesce(e.z, 0) AS z, d.degree, g.aromatic, g.charge, g.explicit_h, g.chiral,
       coalesce(rg.in_ring, false) AS in_ring, h.n_h
FROM gatoms g JOIN deg d ON g.mol_id = d.mol_id AND g.atom = d.atom LEFT JOIN elems e ON g.symbol = e.symbol
JOIN hc h ON g.mol_id = h.mol_id AND g.atom = h.atom
LEFT JOIN (SELECT mol_id, src, bool_or(in_ring) AS in_ring FROM bonds2 GROUP BY mol_id, src) rg
  ON g.mol_id = rg.mol_id AND g.atom = rg.src""",
                                   deg=DEG_SQL, elems=TK.ELEMENTS_SQL, vals=_vals_sql(), hc=HCOUNT_SQL))
def q_atom_features(spark, sf):
    atoms, bonds = mol_graph(spark, sf, both=True)
    return MO.atom_features(atoms, bonds, TK.elements(spark))


HATOMS_SQL = """
SELECT h.mol_id, h.atom AS src, CAST(n.n + coalesce(sum(h.n_h) OVER (PARTITION BY h.mol_id ORDER BY h.atom
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first_h, h.n_h
FROM hc h JOIN (SELECT mol_id, count(*) AS n FROM gatoms GROUP BY mol_id) n ON h.mol_id = n.mol_id"""


@query("mol_graph_with_h", with_graph("""
SELECT mol_id, src, dst, bond_order FROM bonds
UNION ALL
SELECT mol_id, src, CAST(first_h + k AS INTEGER) AS dst, 1 AS bond_order
FROM ha, generate_series(0, ha.n_h - 1) AS g(k) WHERE ha.n_h > 0""", vals=_vals_sql(), hc=HCOUNT_SQL, ha=HATOMS_SQL))
def q_mol_graph_with_h(spark, sf):
    atoms, bonds = mol_graph(spark, sf)
    _, bonds_h = MO.add_hydrogens(atoms, bonds)
    return bonds_h
