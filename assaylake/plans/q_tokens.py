"""Registered token / text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.smiles import sql_tokens
from ..operators import tokens as TK
from ..operators.lookup import lookup
from ..session import written
from ..sources import tables as S
from .common import r, rounded
from .registry import query, with_ctes

MOL = {"molecules": S.MOLECULES_SQL}
TOKENS_SQL = f"""
SELECT mol_id, CAST(g.i - 1 AS BIGINT) AS pos, toks[g.i] AS token
FROM (SELECT mol_id, {sql_tokens('smiles')} AS toks FROM molecules) m, generate_series(1, len(m.toks)) AS g(i)"""
TOK = dict(MOL, toks=TOKENS_SQL)


def mol_tokens(spark, sf):
    return TK.smiles_tokens(S.molecules(spark, sf))


@query("smiles_tokens", with_ctes("SELECT mol_id, pos, token FROM toks", **TOK))
def q_smiles_tokens(spark, sf):
    return mol_tokens(spark, sf)


def mol_vocab(tokens):
    # ids 0 = pad, 1 = unknown; tokens numbered from 2 in order of first appearance
    return TK.dictionary_encode(tokens, "token", ["mol_id", "pos"], start=2)


VOCAB_SQL = """
SELECT token, CAST(row_number() OVER (ORDER BY fm, fp, token) + 1 AS BIGINT) AS id
FROM (SELECT token, arg_min(mol_id, mol_id * 1000000 + pos) AS fm, arg_min(pos, mol_id * 1000000 + pos) AS fp
      FROM toks GROUP BY token) f"""


@query("vocab_encode_pad", with_ctes("""
SELECT mol_id,
  array_to_string(list_concat(ids, list_transform(range(w - len(ids)), lambda x: 0)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(w - len(ids)), lambda x: 0)), ',') AS attention_mask
FROM (SELECT m.mol_id, coalesce(e0.ids, []) AS ids FROM molecules m LEFT JOIN
        (SELECT t.mol_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids
         FROM toks t LEFT JOIN vocab v ON t.token = v.token GROUP BY t.mol_id) e0 ON m.mol_id = e0.mol_id) e,
     (SELECT max(pos) + 1 AS w FROM toks) width""",
                                      **TOK, vocab=VOCAB_SQL))
def q_vocab_encode_pad(spark, sf):
    t = written(mol_tokens(spark, sf), "tokens", grows=True)      # read for the dictionary, the width and the ids
    enc = TK.encode_pad(t, mol_vocab(t), "mol_id", keys=S.molecules(spark, sf))
    return enc.select("mol_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


ATOMS_SQL = r"""
SELECT mol_id, pos, token,
  CASE WHEN regexp_matches(raw, '^[bcnops]$') THEN upper(raw) ELSE raw END AS symbol,
  regexp_matches(raw, '^[bcnops]$') AS aromatic,
  CAST(CASE WHEN NOT starts_with(token, '[') THEN 0
       WHEN regexp_extract(token, '([+-])([0-9]+)\]$', 2) <> ''
         THEN CASE WHEN regexp_extract(token, '([+-])([0-9]+)\]$', 1) = '+' THEN 1 ELSE -1 END
              * CAST(regexp_extract(token, '([+-])([0-9]+)\]$', 2) AS INTEGER)
       ELSE (length(token) - length(replace(token, '+', ''))) - (length(token) - length(replace(token, '-', ''))) END
       AS INTEGER) AS charge,
  CAST(CASE WHEN NOT starts_with(token, '[') OR NOT regexp_matches(token, '^\[[0-9]*(?:[A-Z][a-z]?|[bcnops])[@]*H') THEN 0
       WHEN regexp_extract(token, '^\[[0-9]*(?:[A-Z][a-z]?|[bcnops])[@]*H([0-9]*)', 1) = '' THEN 1
       ELSE CAST(regexp_extract(token, '^\[[0-9]*(?:[A-Z][a-z]?|[bcnops])[@]*H([0-9]*)', 1) AS INTEGER) END AS INTEGER) AS explicit_h,
  contains(token, '@') AS chiral
FROM (SELECT *, CASE WHEN starts_with(token, '[') THEN regexp_extract(token, '^\[[0-9]*([A-Z][a-z]?|[bcnops])', 1)
                     ELSE token END AS raw
      FROM toks WHERE regexp_matches(token, '^(\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops])$')) a"""


@query("token_descriptors", with_ctes(f"""
SELECT m.mol_id, coalesce(heavy_atoms, 0) AS heavy_atoms, coalesce(no_count, 0) AS no_count,
       coalesce(hetero_atoms, 0) AS hetero_atoms, {r('coalesce(heavy_mol_wt, 0)')} AS heavy_mol_wt,
       coalesce(aromatic_atoms, 0) AS aromatic_atoms, coalesce(formal_charge, 0) AS formal_charge,
       coalesce(unlisted_atoms, 0) AS unlisted_atoms, CAST(coalesce(rc.ring_closures, 0) AS BIGINT) AS ring_closures
FROM molecules m LEFT JOIN (SELECT a.mol_id,
        CAST(count(*) FILTER (WHERE a.symbol <> 'H') AS BIGINT) AS heavy_atoms,
        CAST(count(*) FILTER (WHERE a.symbol IN ('N', 'O')) AS BIGINT) AS no_count,
        CAST(count(*) FILTER (WHERE a.symbol NOT IN ('C', 'H')) AS BIGINT) AS hetero_atoms,
        sum(CASE WHEN a.symbol <> 'H' THEN e.weight ELSE 0.0 END) AS heavy_mol_wt,
        CAST(count(*) FILTER (WHERE aromatic) AS BIGINT) AS aromatic_atoms,
        CAST(sum(charge) AS BIGINT) AS formal_charge,
        CAST(count(*) FILTER (WHERE e.z IS NULL) AS BIGINT) AS unlisted_atoms
      FROM atoms a LEFT JOIN elems e ON a.symbol = e.symbol GROUP BY a.mol_id) d ON m.mol_id = d.mol_id
LEFT JOIN (SELECT mol_id, CAST(floor(count(*) / 2) AS BIGINT) AS ring_closures FROM toks
           WHERE regexp_matches(token, '^(%[0-9]{{2}}|[0-9])$') GROUP BY mol_id) rc ON m.mol_id = rc.mol_id""",
                                       **TOK, atoms=ATOMS_SQL, elems=TK.ELEMENTS_SQL))
def q_token_descriptors(spark, sf):
    return rounded(TK.token_descriptors(mol_tokens(spark, sf), TK.elements(spark), keys=S.molecules(spark, sf)))


@query("element_dimension", with_ctes(f"""
SELECT a.symbol, coalesce(e.z, 0) AS z, {r('e.weight')} AS weight, {r('e.electronegativity')} AS electronegativity,
       e.period, e.group_no, e.block, e.valence_electrons, e.neutrons, count(*) AS n_atoms
FROM atoms a LEFT JOIN elems e ON a.symbol = e.symbol GROUP BY ALL""",
                                       **TOK, atoms=ATOMS_SQL, elems=TK.ELEMENTS_SQL))
def q_element_dimension(spark, sf):
    t = mol_tokens(spark, sf).where(F.col("token").rlike(TK.ATOM_TOKEN))
    a = t.select(TK.atom_columns(F.col("token"))["symbol"].alias("symbol"))
    j = TK.join_elements(a, TK.elements(spark))
    return rounded(j.groupBy("symbol", *TK.elements(spark).columns[1:]).agg(F.count(F.lit(1)).alias("n_atoms")))


CHARSET_SQL = """
SELECT ch, CAST(row_number() OVER (ORDER BY ch) - 1 AS BIGINT) AS char_id
FROM (SELECT DISTINCT unnest(string_split(smiles, '')) AS ch FROM molecules) c WHERE ch <> ''"""
PAD_SQL = "SELECT CAST(max(length(smiles)) + 5 AS BIGINT) AS pad FROM molecules"


@query("charset_fit", with_ctes("SELECT ch, char_id, pad FROM charset, pad", **MOL, charset=CHARSET_SQL, pad=PAD_SQL))
def q_charset_fit(spark, sf):
    cs, pad = TK.charset_fit(S.molecules(spark, sf), "smiles")
    return cs.crossJoin(pad)


@query("length_stats", with_ctes("""
SELECT active, CAST(max(length(smiles)) AS BIGINT) AS max_len, CAST(length(max(smiles)) AS BIGINT) AS len_of_max
FROM molecules GROUP BY active""", **MOL))
def q_length_stats(spark, sf):
    m = S.molecules(spark, sf)
    return m.groupBy("active").agg(F.max(F.length("smiles")).cast("bigint").alias("max_len"),
                                   F.length(F.max("smiles")).cast("bigint").alias("len_of_max"))


CODES_SQL = """
SELECT m.mol_id, CAST(g.i - 1 + pad.pad - length(m.smiles) AS BIGINT) AS slot, c.char_id
FROM molecules m, generate_series(1, length(m.smiles)) AS g(i), pad, charset c
WHERE c.ch = substring(m.smiles, g.i, 1)"""


def _codes(spark, sf):
    m = S.molecules(spark, sf)
    cs, pad = TK.charset_fit(m, "smiles")
    return TK.char_encode(m, "mol_id", "smiles", cs, pad, left=True), cs


@query("char_one_hot", with_ctes("SELECT mol_id, slot, char_id FROM codes", **MOL, charset=CHARSET_SQL,
                                 pad=PAD_SQL, codes=CODES_SQL))
def q_char_one_hot(spark, sf):
    return _codes(spark, sf)[0]


@query("char_decode", with_ctes("""
SELECT m.mol_id, coalesce(d.decoded, '') AS decoded FROM molecules m LEFT JOIN (
  SELECT mol_id, string_agg(c.ch, '' ORDER BY slot) AS decoded FROM codes JOIN charset c ON codes.char_id = c.char_id
  GROUP BY mol_id) d ON m.mol_id = d.mol_id""", **MOL, charset=CHARSET_SQL, pad=PAD_SQL, codes=CODES_SQL))
def q_char_decode(spark, sf):
    codes, cs = _codes(spark, sf)
    return TK.char_decode(codes, "mol_id", cs, keys=S.molecules(spark, sf))


@query("augment_replicate", with_ctes(f"""
SELECT mol_id, CAST(g.k AS BIGINT) AS replica, smiles, {r('pic50')} AS pic50
FROM molecules, generate_series(1, 10) AS g(k)""", **MOL))
def q_augment_replicate(spark, sf):
    return rounded(TK.replicate(S.molecules(spark, sf), 10).select("mol_id", "replica", "smiles", "pic50"))


@query("context_window", with_ctes("""
SELECT mol_id, pos, concat_ws(',',
  coalesce(lag(id, 5) OVER w, 0), coalesce(lag(id, 4) OVER w, 0), coalesce(lag(id, 3) OVER w, 0),
  coalesce(lag(id, 2) OVER w, 0), coalesce(lag(id, 1) OVER w, 0), id,
  coalesce(lead(id, 1) OVER w, 0), coalesce(lead(id, 2) OVER w, 0), coalesce(lead(id, 3) OVER w, 0),
  coalesce(lead(id, 4) OVER w, 0), coalesce(lead(id, 5) OVER w, 0)) AS context
FROM (SELECT t.mol_id, t.pos, v.id FROM toks t JOIN vocab v ON t.token = v.token) x
WINDOW w AS (PARTITION BY mol_id ORDER BY pos)""", **TOK, vocab=VOCAB_SQL))
def q_context_window(spark, sf):
    t = written(mol_tokens(spark, sf), "tokens", grows=True)
    ids = lookup(t, mol_vocab(t), "token").select("mol_id", "pos", "id")
    cw = TK.context_window(ids, "mol_id", "pos", "id", k=5)
    return cw.select("mol_id", "pos", F.array_join("context", ",").alias("context"))


# Generated text = an assistant turn, reference = the user turn before it.
PAIRS_SQL = """
SELECT struct_pack(c := a.conv_id, t := a.turn) AS pair_id, a.text AS hyp, u.text AS ref
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'"""


def bleu_pairs(spark, sf):
    c = S.table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("hyp"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return a.join(u, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("pair_id"), "hyp", "ref")


def _sql_ngrams(col: str) -> str:
    parts = []
    for n in range(1, 5):
        parts.append(f"""SELECT pair_id, {n} AS n, array_to_string(w[g.i:g.i + {n - 1}], ' ') AS gram
FROM (SELECT pair_id, list_filter(string_split_regex(lower({col}), '\\s+'), lambda x: x <> '') AS w FROM pairs) p,
     generate_series(1, len(p.w) - {n - 1}) AS g(i)""")
    return "SELECT pair_id, n, gram, count(*) AS cnt FROM (" + " UNION ALL ".join(parts) + ") x GROUP BY pair_id, n, gram"


@query("corpus_bleu", with_ctes(f"""
SELECT {r("CASE WHEN k < 4 THEN 0.0 ELSE (CASE WHEN c > rl THEN 1.0 ELSE exp(1 - rl / c) END) * exp(lp / 4) END")} AS bleu,
       CAST(c AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len
FROM (SELECT sum(CASE WHEN m > 0 THEN ln(m / t) END) AS lp, count(*) FILTER (WHERE m > 0) AS k
      FROM (SELECT h.n, sum(least(h.cnt, coalesce(r.cnt, 0))) AS m, sum(h.cnt) AS t
            FROM hg h LEFT JOIN rg r ON h.pair_id = r.pair_id AND h.n = r.n AND h.gram = r.gram GROUP BY h.n) q) pr,
     (SELECT sum(len(list_filter(string_split_regex(lower(hyp), '\\s+'), lambda x: x <> ''))) AS c,
             sum(len(list_filter(string_split_regex(lower(ref), '\\s+'), lambda x: x <> ''))) AS rl FROM pairs) ls""",
                                 pairs=PAIRS_SQL, hg=_sql_ngrams("hyp"), rg=_sql_ngrams("ref")))
def q_corpus_bleu(spark, sf):
    return rounded(TK.corpus_bleu(bleu_pairs(spark, sf)))


# entity and relation dictionaries over the triple files (train, valid, test)
TRIPLE_POS_SQL = f"""
SELECT head, relation, tail,
       CASE file WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS file_no, line
FROM ({S.TRIPLES_SQL}) t"""


ENTITY_IDS_SQL = """
SELECT value, CAST(row_number() OVER (ORDER BY f, l, s, value) - 1 AS BIGINT) AS id
FROM (SELECT value, arg_min(file_no, (file_no, line, side)) AS f, arg_min(line, (file_no, line, side)) AS l,
             arg_min(side, (file_no, line, side)) AS s
      FROM (SELECT head AS value, file_no, line, 0 AS side FROM tp UNION ALL
            SELECT tail AS value, file_no, line, 1 AS side FROM tp) e GROUP BY value) x"""
RELATION_IDS_SQL = """
SELECT value, CAST(row_number() OVER (ORDER BY f, l, value) - 1 AS BIGINT) AS id
FROM (SELECT relation AS value, arg_min(file_no, (file_no, line)) AS f, arg_min(line, (file_no, line)) AS l
      FROM tp GROUP BY relation) y"""


def numbered_triples(spark, sf):
    return S.triples(spark, sf).withColumn(
        "file_no", F.when(F.col("file") == "train", 0).when(F.col("file") == "valid", 1).otherwise(2))


def entity_ids(t):
    ends = F.inline(F.array(F.struct(F.col("head").alias("value"), "file_no", "line", F.lit(0).alias("side")),
                            F.struct(F.col("tail").alias("value"), "file_no", "line", F.lit(1).alias("side"))))
    return TK.dictionary_encode(t.select(ends), "value", ["file_no", "line", "side"])


@query("dictionary_encode", with_ctes("""
SELECT 'entity' AS kind, value, id FROM ents UNION ALL SELECT 'relation' AS kind, value, id FROM rels""",
                                      tp=TRIPLE_POS_SQL, ents=ENTITY_IDS_SQL, rels=RELATION_IDS_SQL))
def q_dictionary_encode(spark, sf):
    t = numbered_triples(spark, sf)
    rel = TK.dictionary_encode(t.select(F.col("relation").alias("value"), "file_no", "line"), "value", ["file_no", "line"])
    return entity_ids(t).withColumn("kind", F.lit("entity")).unionByName(rel.withColumn("kind", F.lit("relation"))).select("kind", "value", "id")


# a preset relation dictionary: the relations of the test file, in reversed alphabetical order
PRESET_SQL = """
SELECT relation AS value, CAST(row_number() OVER (ORDER BY relation DESC) - 1 AS BIGINT) AS id
FROM (SELECT DISTINCT relation FROM tp WHERE file_no = 2) d"""


@query("encoded_triples", with_ctes("""
SELECT file_no, line, h.id AS head_id, r.id AS relation_id, e.id AS tail_id, tp.head, tp.relation, tp.tail
FROM tp JOIN ents h ON tp.head = h.value JOIN ents e ON tp.tail = e.value JOIN rels r ON tp.relation = r.value""",
                                    tp=TRIPLE_POS_SQL, ents=ENTITY_IDS_SQL, preset=PRESET_SQL, rels="""
SELECT value, id FROM preset UNION ALL
SELECT value, CAST((SELECT coalesce(max(id) + 1, 0) FROM preset) + row_number() OVER (ORDER BY f, l, value) - 1 AS BIGINT) AS id
FROM (SELECT relation AS value, arg_min(file_no, (file_no, line)) AS f, arg_min(line, (file_no, line)) AS l
      FROM tp WHERE relation NOT IN (SELECT value FROM preset) GROUP BY relation) y"""))
def q_encoded_triples(spark, sf):
    """Triples as ids, and their values read back by the reverse maps."""
    t = numbered_triples(spark, sf).select("file_no", "line", "head", "relation", "tail")
    names = t.where("file_no = 2").select(F.col("relation").alias("value")).distinct()
    preset = names.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("value"))) - 1).cast("bigint"))  # one row a relation
    rel = written(TK.dictionary_encode(t.select(F.col("relation").alias("value"), "file_no", "line"), "value", ["file_no", "line"],
                                       preset=preset), "relations")
    ent = written(entity_ids(t), "entities")
    rows = t.count()
    ids = TK.encode_triples(t, ent, rel, rows).drop("head", "relation", "tail")
    return TK.decode_triples(ids, ent, rel, rows).select("file_no", "line", "head_id", "relation_id", "tail_id", "head", "relation", "tail")
