"""Token, character and n-gram jobs over structure strings and texts
(M1-M6, M13, A6, A7, J5, W1).

Every job is explode -> join/aggregate on keys; sequences are only re-collected
per row key (one molecule / one text), never across rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.smiles import tokens as smiles_token_array
from ..session import by_rows
from .lookup import lookup
from .ranking import placed

# Element dimension (symbol, atomic number, standard atomic
# weight or mass number, Pauling electronegativity or None), elements 1 to 118.
ELEMENTS = [
    ("H", 1, 1.008, 2.20), ("He", 2, 4.0026, None), ("Li", 3, 6.94, 0.98), ("Be", 4, 9.0122, 1.57),
    ("B", 5, 10.81, 2.04), ("C", 6, 12.011, 2.55), ("N", 7, 14.007, 3.04), ("O", 8, 15.999, 3.44),
    ("F", 9, 18.998, 3.98), ("Ne", 10, 20.180, None), ("Na", 11, 22.990, 0.93), ("Mg", 12, 24.305, 1.31),
    ("Al", 13, 26.982, 1.61), ("Si", 14, 28.085, 1.90), ("P", 15, 30.974, 2.19), ("S", 16, 32.06, 2.58),
    ("Cl", 17, 35.45, 3.16), ("Ar", 18, 39.95, None), ("K", 19, 39.098, 0.82), ("Ca", 20, 40.078, 1.00),
    ("Sc", 21, 44.956, 1.36), ("Ti", 22, 47.867, 1.54), ("V", 23, 50.942, 1.63), ("Cr", 24, 51.996, 1.66),
    ("Mn", 25, 54.938, 1.55), ("Fe", 26, 55.845, 1.83), ("Co", 27, 58.933, 1.88), ("Ni", 28, 58.693, 1.91),
    ("Cu", 29, 63.546, 1.90), ("Zn", 30, 65.38, 1.65), ("Ga", 31, 69.723, 1.81), ("Ge", 32, 72.630, 2.01),
    ("As", 33, 74.922, 2.18), ("Se", 34, 78.971, 2.55), ("Br", 35, 79.904, 2.96), ("Kr", 36, 83.798, 3.00),
    ("Rb", 37, 85.468, 0.82), ("Sr", 38, 87.62, 0.95), ("Y", 39, 88.906, 1.22), ("Zr", 40, 91.224, 1.33),
    ("Nb", 41, 92.906, 1.6), ("Mo", 42, 95.95, 2.16), ("Tc", 43, 97.0, 1.9), ("Ru", 44, 101.07, 2.2),
    ("Rh", 45, 102.906, 2.28), ("Pd", 46, 106.42, 2.20), ("Ag", 47, 107.868, 1.93), ("Cd", 48, 112.414, 1.69),
    ("In", 49, 114.818, 1.78), ("Sn", 50, 118.710, 1.96), ("Sb", 51, 121.760, 2.05), ("Te", 52, 127.60, 2.1),
    ("I", 53, 126.904, 2.66), ("Xe", 54, 131.293, 2.6), ("Cs", 55, 132.905, 0.79), ("Ba", 56, 137.327, 0.89),
    ("La", 57, 138.905, 1.10), ("Ce", 58, 140.116, 1.12), ("Pr", 59, 140.908, 1.13), ("Nd", 60, 144.242, 1.14),
    ("Pm", 61, 145.0, None), ("Sm", 62, 150.36, 1.17), ("Eu", 63, 151.964, None), ("Gd", 64, 157.25, 1.20),
    ("Tb", 65, 158.925, None), ("Dy", 66, 162.500, 1.22), ("Ho", 67, 164.930, 1.23), ("Er", 68, 167.259, 1.24),
    ("Tm", 69, 168.934, 1.25), ("Yb", 70, 173.045, None), ("Lu", 71, 174.967, 1.27), ("Hf", 72, 178.486, 1.3),
    ("Ta", 73, 180.948, 1.5), ("W", 74, 183.84, 2.36), ("Re", 75, 186.207, 1.9), ("Os", 76, 190.23, 2.2),
    ("Ir", 77, 192.217, 2.20), ("Pt", 78, 195.084, 2.28), ("Au", 79, 196.967, 2.54), ("Hg", 80, 200.592, 2.00),
    ("Tl", 81, 204.38, 1.62), ("Pb", 82, 207.2, 2.33), ("Bi", 83, 208.980, 2.02), ("Po", 84, 209.0, 2.0),
    ("At", 85, 210.0, 2.2), ("Rn", 86, 222.0, None), ("Fr", 87, 223.0, 0.7), ("Ra", 88, 226.0, 0.9),
    ("Ac", 89, 227.0, 1.1), ("Th", 90, 232.038, 1.3), ("Pa", 91, 231.036, 1.5), ("U", 92, 238.029, 1.38),
    ("Np", 93, 237.0, 1.36), ("Pu", 94, 244.0, 1.28), ("Am", 95, 243.0, 1.3), ("Cm", 96, 247.0, 1.3),
    ("Bk", 97, 247.0, 1.3), ("Cf", 98, 251.0, 1.3), ("Es", 99, 252.0, 1.3), ("Fm", 100, 257.0, 1.3),
    ("Md", 101, 258.0, 1.3), ("No", 102, 259.0, 1.3), ("Lr", 103, 262.0, None), ("Rf", 104, 267.0, None),
    ("Db", 105, 268.0, None), ("Sg", 106, 269.0, None), ("Bh", 107, 270.0, None), ("Hs", 108, 269.0, None),
    ("Mt", 109, 278.0, None), ("Ds", 110, 281.0, None), ("Rg", 111, 282.0, None), ("Cn", 112, 285.0, None),
    ("Nh", 113, 286.0, None), ("Fl", 114, 289.0, None), ("Mc", 115, 290.0, None), ("Lv", 116, 293.0, None),
    ("Ts", 117, 294.0, None), ("Og", 118, 294.0, None),
]

#: last atomic number of each period
PERIOD_ENDS = (2, 10, 18, 36, 54, 86, 118)


def element_place(z: int) -> tuple[int, int | None, str, int | None]:
    """(period, group, block, valence electrons) of an atomic number, by the
    layout of the periodic table; f-block elements have no group."""
    period = next(p for p, end in enumerate(PERIOD_ENDS, 1) if z <= end)
    at, width = z - (0, *PERIOD_ENDS)[period - 1], PERIOD_ENDS[period - 1] - (0, *PERIOD_ENDS)[period - 1]
    if width == 32 and 3 <= at <= 16:
        return period, None, "f", None
    group = at if at <= 2 and width > 2 or at == 1 else 18 - (width - at)
    block = "s" if group <= 2 or z == 2 else "p" if group >= 13 else "d"
    return period, group, block, 2 if z == 2 else group - 10 if group >= 13 else group


def elements(spark: SparkSession) -> DataFrame:
    """(symbol, z, weight, electronegativity, period, group_no, block,
    valence_electrons, neutrons), one row an element; neutrons of the rounded weight."""
    rows = [(s, z, w, e, *element_place(z), round(w) - z) for s, z, w, e in ELEMENTS]
    return spark.createDataFrame(rows, "symbol string, z int, weight double, electronegativity double, period int, "
                                       "group_no int, block string, valence_electrons int, neutrons int")


def _sql_value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


ELEMENTS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(map(_sql_value, (s, z, w, e, *element_place(z), round(w) - z))) + ")" for s, z, w, e in ELEMENTS
) + ") AS t(symbol, z, weight, electronegativity, period, group_no, block, valence_electrons, neutrons)"


def join_elements(atoms: DataFrame, elems: DataFrame) -> DataFrame:
    """``atoms`` with the element columns. Atoms of an unlisted element stay,
    with atomic number 0 and null properties. The element table is a fixed
    literal of 118 rows, so its broadcast is bounded."""
    return atoms.join(F.broadcast(elems), "symbol", "left").withColumn("z", F.coalesce("z", F.lit(0)))


def smiles_tokens(df: DataFrame, key: str = "mol_id", col: str = "smiles") -> DataFrame:
    """Long token table ``(key, pos, token)`` (0-based pos)."""
    return df.select(key, F.posexplode(smiles_token_array(col)).alias("pos", "token")).withColumn(
        "pos", F.col("pos").cast("bigint"))


# ---- atom-level parsing of tokens (built-in regex only) ---------------------
ATOM_TOKEN = r"^(\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops])$"
BRACKET_ELEM = r"^\[[0-9]*([A-Z][a-z]?|se|as|[bcnops])"


def atom_columns(tok: Column) -> dict[str, Column]:
    """Element symbol, aromatic flag, formal charge, explicit H, chirality of
    an atom token."""
    is_br = tok.startswith("[")
    raw = F.when(is_br, F.regexp_extract(tok, BRACKET_ELEM, 1)).otherwise(tok)
    aromatic = raw.rlike("^([bcnops]|se|as)$")
    symbol = F.when(aromatic, F.initcap(raw)).otherwise(raw)
    sign_digits = F.regexp_extract(tok, r"([+-])([0-9]+)\]$", 2)
    sign = F.regexp_extract(tok, r"([+-])([0-9]+)\]$", 1)
    n_plus = F.length(tok) - F.length(F.regexp_replace(tok, r"\+", ""))
    n_minus = F.length(tok) - F.length(F.regexp_replace(tok, "-", ""))
    charge = F.when(~is_br, F.lit(0)).when(
        sign_digits != "", F.when(sign == "+", sign_digits.cast("int")).otherwise(-sign_digits.cast("int"))
    ).otherwise(n_plus - n_minus)
    h_digits = F.regexp_extract(tok, r"^\[[0-9]*(?:[A-Z][a-z]?|se|as|[bcnops])[@]*H([0-9]*)", 1)
    has_h = tok.rlike(r"^\[[0-9]*(?:[A-Z][a-z]?|se|as|[bcnops])[@]*H")
    hcount = F.when(~is_br | ~has_h, F.lit(0)).when(h_digits == "", F.lit(1)).otherwise(h_digits.cast("int"))
    return {
        "symbol": symbol,
        "aromatic": aromatic,
        "charge": charge.cast("int"),
        "explicit_h": hcount.cast("int"),
        "chiral": tok.contains("@"),
    }


def token_descriptors(tokens: DataFrame, elems: DataFrame, key: str = "mol_id", keys: DataFrame | None = None) -> DataFrame:
    """Descriptors exact from tokens: heavy atoms, N+O count, heteroatoms,
    heavy-atom weight, aromatic atoms, formal charge sum, ring closures.
    ``unlisted_atoms`` counts those of elements that ``elems`` does not have;
    their weight is missing from the sum. With ``keys`` every key of that table
    has a row; one without tokens counts zero."""
    t = F.col("token")
    atoms = tokens.where(t.rlike(ATOM_TOKEN))
    ac = atom_columns(t)
    atoms = atoms.select(key, *[v.alias(k) for k, v in ac.items()])
    j = join_elements(atoms, elems)
    heavy = F.col("symbol") != "H"
    per_atom = j.groupBy(key).agg(
        F.count_if(heavy).cast("bigint").alias("heavy_atoms"),
        F.count_if(F.col("symbol").isin("N", "O")).cast("bigint").alias("no_count"),
        F.count_if(~F.col("symbol").isin("C", "H")).cast("bigint").alias("hetero_atoms"),
        F.sum(F.when(heavy, F.col("weight")).otherwise(0.0)).alias("heavy_mol_wt"),
        F.count_if("aromatic").cast("bigint").alias("aromatic_atoms"),
        F.sum("charge").cast("bigint").alias("formal_charge"),
        F.count_if(F.col("z") == 0).cast("bigint").alias("unlisted_atoms"),
    )
    rings = tokens.where(t.rlike(r"^(%[0-9]{2}|[0-9])$")).groupBy(key).agg(
        F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("ring_closures"))
    have = (tokens if keys is None else keys).select(key).distinct()
    return have.join(per_atom, key, "left").join(rings, key, "left").fillna(0)


# ---- dictionaries ------------------------------------------------------------

def dictionary_encode(df: DataFrame, value: str, order: Sequence[str], start: int = 0,
                      preset: DataFrame | None = None) -> DataFrame:
    """Dense ids in order of first appearance: first position per value
    (distributed ``min``), then the global rank of those first
    positions. ``order`` are numeric columns giving the position (file order,
    line). With ``preset`` (value, id) those ids are kept and new values
    continue after the largest preset id."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_f")).select(
        value, *[F.col(f"_f.{o}").alias(f"_f{i}") for i, o in enumerate(order)])
    offset = F.lit(start)
    if preset is not None:
        first = first.join(preset.select(value), value, "left_anti")
        mx = preset.agg(F.max("id").alias("_mx"))
        first = first.crossJoin(F.broadcast(mx))  # one row
        offset = F.coalesce(F.col("_mx") + 1, F.lit(start))
    ranked = placed(first, [*[f"_f{i}" for i in range(len(order))], value], rank="_r")
    out = ranked.select(value, (F.col("_r") - 1 + offset).cast("bigint").alias("id"))
    if preset is not None:
        out = out.unionByName(preset.select(value, F.col("id").cast("bigint")))
    return out


def encode_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, rows: int | None = None) -> DataFrame:
    """``triples`` (head, relation, tail, ...) with ``head_id``, ``relation_id``
    and ``tail_id`` from the dictionaries (value, id); null where one has no id.
    A frequent head, tail or relation is spread by :func:`lookup.lookup`.
    ``rows``: their number if known."""
    rows = triples.count() if rows is None else rows
    for c, d in (("head", entities), ("relation", relations), ("tail", entities)):
        triples = lookup(triples, d.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id")), c, "left", rows=rows)
    return triples


def decode_triples(encoded: DataFrame, entities: DataFrame, relations: DataFrame, rows: int | None = None) -> DataFrame:
    """The reverse maps: ``encoded`` (head_id, relation_id, tail_id, ...) with
    the values of the ids. ``rows``: their number if known."""
    rows = encoded.count() if rows is None else rows
    for c, d in (("head", entities), ("relation", relations), ("tail", entities)):
        encoded = lookup(encoded, d.select(F.col("id").alias(f"{c}_id"), F.col("value").alias(c)), f"{c}_id", "left", rows=rows)
    return encoded


def char_vocab(df: DataFrame, col: str, extra: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct characters (+ extra), index 0-based. The distinct
    alphabet is bounded by the character set, so one ordered pass is fine."""
    chars = df.select(F.explode(F.split(F.col(col), "")).alias("ch")).where(F.col("ch") != "")
    if extra:
        spark = df.sparkSession
        chars = chars.unionByName(spark.createDataFrame([(c,) for c in extra], "ch string"))
    d = chars.distinct()
    return d.withColumn("char_id", (F.row_number().over(Window.orderBy("ch")) - 1).cast("bigint"))


def charset_fit(df: DataFrame, col: str, extra: Sequence[str] = (), extra_pad: int = 5):
    """(charset table, pad length = max length + extra_pad)."""
    pad = df.agg((F.max(F.length(col)) + F.lit(extra_pad)).cast("bigint").alias("pad"))
    return char_vocab(df, col, extra), pad


def char_encode(df: DataFrame, key: str, col: str, charset: DataFrame, pad: DataFrame,
                left: bool = True) -> DataFrame:
    """Sparse one-hot ``(key, slot, char_id)``: left padding puts the string at
    the end (slot = pos + pad - len), right padding at the start."""
    chars = df.select(key, F.length(col).alias("_len"),
                      F.posexplode(F.split(F.col(col), "")).alias("pos", "ch")).where(F.col("ch") != "")
    chars = chars.crossJoin(F.broadcast(pad))  # one row
    slot = (F.col("pos") + F.col("pad") - F.col("_len")) if left else F.col("pos")
    return lookup(chars, charset, "ch").select(key, slot.cast("bigint").alias("slot"), "char_id")


def char_decode(codes: DataFrame, key: str, charset: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Inverse of :func:`char_encode`: characters ordered by slot, joined. With
    ``keys`` every key of that table has a row; one without codes was empty."""
    out = lookup(codes, charset, "char_id").groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("slot", "ch"))), lambda x: x["ch"]), "").alias("decoded"))
    return out if keys is None else keys.select(key).distinct().join(out, key, "left").fillna("", ["decoded"])


def encode_pad(tokens: DataFrame, vocab: DataFrame, key: str, length: int | None = None, value: str = "token",
               unk: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """Token ids padded (pad id 0) to the longest sequence, or truncated and
    padded to ``length``, + attention mask. With ``keys`` every key of that
    table has a row; one without tokens is all padding."""
    t = tokens if length is None else tokens.where(F.col("pos") < length)
    t = lookup(t, vocab, value, "left").withColumn("id", F.coalesce(F.col("id"), F.lit(unk)).cast("bigint"))
    g = by_rows(t, key, rows=tokens.count()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_s"))
    if keys is not None:
        g = keys.select(key).join(g, key, "left")
    width = tokens.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).cast("int").alias("_len"))  # one row
    g = g.crossJoin(F.broadcast(width)) if length is None else g.withColumn("_len", F.lit(length))
    ids = F.coalesce(F.transform("_s", lambda x: x["id"]), F.array().cast("array<bigint>"))
    n = F.size(ids)
    pad = F.array_repeat(F.lit(0).cast("bigint"), F.col("_len") - n)
    return g.select(key, F.concat(ids, pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1).cast("bigint"), n), pad).alias("attention_mask"))


def replicate(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("replica", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))))


def context_window(df: DataFrame, key: str, order: str, value: str, k: int = 5) -> DataFrame:
    """Values at offsets -k..k around each position, zero padded."""
    df = by_rows(df, key)
    w = Window.partitionBy(key).orderBy(order)
    ctx = [F.coalesce(F.lag(value, -o).over(w), F.lit(0)) if o < 0 else
           (F.col(value) if o == 0 else F.coalesce(F.lead(value, o).over(w), F.lit(0)))
           for o in range(-k, k + 1)]
    return df.select(key, order, F.array(*ctx).alias("context"))


# ---- n-grams and BLEU --------------------------------------------------------

def words(col: str) -> Column:
    return F.filter(F.split(F.lower(F.col(col)), r"\s+"), lambda x: x != "")


def ngrams(df: DataFrame, key: str, arr: str, max_n: int = 4) -> DataFrame:
    """``(key, n, gram, cnt)`` n-gram counts of a word array column; all orders
    come from one pass over the rows."""
    def grams(n: int) -> Column:
        return F.when(F.size(arr) >= n, F.transform(
            F.sequence(F.lit(0), F.size(arr) - n),
            lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(F.col(arr), i + 1, n), " ").alias("gram"))))
    every = F.flatten(F.array_compact(F.array(*[grams(n) for n in range(1, max_n + 1)])))
    return (df.select(key, F.explode(every).alias("_g")).groupBy(key, "_g.n", "_g.gram")
            .agg(F.count(F.lit(1)).alias("cnt")))


def corpus_bleu(pairs: DataFrame, key: str = "pair_id", hyp: str = "hyp", ref: str = "ref",
                max_n: int = 4) -> DataFrame:
    """Corpus-level BLEU-n (uniform weights, no smoothing)."""
    p = pairs.select(key, words(hyp).alias("_h"), words(ref).alias("_r"))
    hg = ngrams(p, key, "_h", max_n)
    rg = ngrams(p, key, "_r", max_n).withColumnRenamed("cnt", "rcnt")
    clipped = hg.join(rg, [key, "n", "gram"], "left").select(
        "n", "cnt", F.least(F.col("cnt"), F.coalesce(F.col("rcnt"), F.lit(0))).alias("clip"))
    per_n = clipped.groupBy("n").agg(F.sum("clip").alias("m"), F.sum("cnt").alias("t"))
    lens = p.agg(F.sum(F.size("_h")).alias("c"), F.sum(F.size("_r")).alias("r"))
    prec = per_n.agg(
        F.sum(F.when(F.col("m") > 0, F.log(F.col("m") / F.col("t")))).alias("_lp"),
        F.count_if(F.col("m") > 0).alias("_k"))
    j = prec.crossJoin(lens)  # one row each
    bp = F.when(F.col("c") > F.col("r"), F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.col("r") / F.col("c")))
    bleu = F.when(F.col("_k") < max_n, F.lit(0.0)).otherwise(bp * F.exp(F.col("_lp") / F.lit(max_n)))
    return j.select(bleu.alias("bleu"), F.col("c").cast("bigint").alias("hyp_len"),
                    F.col("r").cast("bigint").alias("ref_len"))
