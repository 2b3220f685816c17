"""Driver tables and the stand-in tables derived from them.

The driver data holds no molecules, assays or graphs, so each logical input of
the reference is derived from a driver table by a fixed rule. Every rule has a
DuckDB twin (``*_SQL``) so oracle queries start from the same parquet views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_uniform, uniform

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The three SMILES fragment lists of the molecule stand-in table
# (position i of each list is chosen by a key modulo the list length).
FRAG_A = ["CC", "OC", "N", "Cl", "C1CCNCC1", "c1ccccc1", "[NH3+]C"]
FRAG_B = ["c1ccc(cc1)", "C(=O)N", "[C@@H](C)", "CC", "S(=O)(=O)"]
FRAG_C = ["C", "Br", "C1CC1", "OC", "C#N", "n1cccc1"]


def _pick(frags, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in frags]), (F.pmod(key, F.lit(len(frags))) + 1).cast("int"))


def _sql_list(frags) -> str:
    return "[" + ", ".join("'" + x + "'" for x in frags) + "]"


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``molecules(mol_id, smiles, pic50, active)`` from ``part``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p.select(
        F.col("p_partkey").alias("mol_id"),
        F.concat(_pick(FRAG_A, F.col("p_partkey")), _pick(FRAG_B, F.col("p_size")),
                 _pick(FRAG_C, F.col("p_partkey"))).alias("smiles"),
        (F.lit(4.0) + F.pmod(F.col("p_partkey"), F.lit(600)) / F.lit(100.0)).alias("pic50"),
        (F.pmod(F.col("p_size"), F.lit(3)) != 0).alias("active"),
    )


MOLECULES_SQL = f"""
SELECT p_partkey AS mol_id,
       {_sql_list(FRAG_A)}[p_partkey % 7 + 1] || {_sql_list(FRAG_B)}[p_size % 5 + 1]
         || {_sql_list(FRAG_C)}[p_partkey % 6 + 1] AS smiles,
       4.0 + (p_partkey % 600) / 100.0 AS pic50,
       (p_size % 3) <> 0 AS active
FROM part"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions(id, target, pred, active)``: a potency target and a
    deterministic prediction around it."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    target = F.lit(4.0) + F.pmod(F.col("p_partkey"), F.lit(600)) / F.lit(100.0)
    return p.select(
        F.col("p_partkey").alias("id"),
        target.alias("target"),
        (target + (F.pmod(F.col("p_partkey") * 37, F.lit(101)) - 50) / F.lit(50.0)).alias("pred"),
        (F.pmod(F.col("p_size"), F.lit(3)) != 0).alias("active"),
    )


PREDICTIONS_SQL = """
SELECT p_partkey AS id,
       4.0 + (p_partkey % 600) / 100.0 AS target,
       4.0 + (p_partkey % 600) / 100.0 + ((p_partkey * 37) % 101 - 50) / 50.0 AS pred,
       (p_size % 3) <> 0 AS active
FROM part"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scores(id, label, score, toxic)``: binary labels with a hash score."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("double").alias("label"),
        uniform("doc_id", seed=7).alias("score"),
        F.col("toxic").cast("double").alias("toxic"),
    )


SCORES_SQL = f"""
SELECT l.doc_id AS id, CAST(l.quality AS DOUBLE) AS label,
       {sql_uniform('l.doc_id', seed=7)} AS score,
       CAST(l.toxic AS DOUBLE) AS toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``class_scores(id, label, logits)``: ten logits, logit j the sum of the
    embedding's dims i with i mod 10 = j."""
    def logit(j: int) -> Column:
        return F.aggregate(F.filter("embedding", lambda x, i: i % 10 == j), F.lit(0.0),
                           lambda acc, x: acc + x.cast("double"))
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("bigint").alias("label"),
        F.array(*[logit(j) for j in range(10)]).alias("logits"),
    )


CLASS_SCORES_SQL = """
SELECT vec_id AS id, CAST(label AS BIGINT) AS label,
       list_transform(range(10), lambda j: list_sum(list_filter(CAST(embedding AS DOUBLE[]),
                                                                lambda x, i: (i - 1) % 10 = j))) AS logits
FROM embeddings"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors(id, label, vec)`` with double elements."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


VECTORS_SQL = """
SELECT vec_id AS id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS vec
FROM embeddings"""


def vector_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``(id, label, dim, x)`` of the vectors (0-based dim)."""
    v = vectors(spark, sf_dir)
    return v.select("id", "label", F.posexplode("vec").alias("dim", "x")).withColumn(
        "dim", F.col("dim").cast("bigint"))


VECTOR_LONG_SQL = """
SELECT id, label, CAST(g.i - 1 AS BIGINT) AS dim, vec[g.i] AS x
FROM (SELECT vec_id AS id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS vec
      FROM embeddings) v,
     generate_series(1, CAST(len(v.vec) AS BIGINT)) AS g(i)"""


def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> part edges of ``lineitem`` (distinct). Node ids are
    interleaved so both kinds share one id space: supplier s -> 2s,
    part p -> 2p+1."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    return li.select((F.col("l_suppkey") * 2).alias("src"),
                     (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


BIPARTITE_SQL = """
SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-graph triples ``(head, relation, tail, file, line)`` from
    ``events``: user -> event type -> property bucket. ``file`` splits the
    events into train/valid/test by day of month."""
    ev = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("head"),
        F.col("event_type").alias("relation"),
        F.concat(F.lit("k"), F.regexp_extract("props", r'"k":\s*([0-9]+)', 1)).alias("tail"),
        F.when(day <= 20, "train").when(day <= 25, "valid").otherwise("test").alias("file"),
        F.col("event_id").alias("line"),
    )


TRIPLES_SQL = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS head, event_type AS relation,
       'k' || regexp_extract(props, '"k":\\s*([0-9]+)', 1) AS tail,
       CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'valid' ELSE 'test' END AS file,
       event_id AS line
FROM events"""


def assay_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled assay rows with some damaged structure strings:
    every 13th molecule loses its last 3 characters, every 17th is empty."""
    m = molecules(spark, sf_dir)
    s = F.when(F.pmod(F.col("mol_id"), F.lit(17)) == 0, F.lit("")).when(
        F.pmod(F.col("mol_id"), F.lit(13)) == 0,
        F.expr("substring(smiles, 1, length(smiles) - 3)")).otherwise(F.col("smiles"))
    return m.select("mol_id", s.alias("smiles"), "pic50", "active")


ASSAY_RAW_SQL = f"""
SELECT mol_id,
       CASE WHEN mol_id % 17 = 0 THEN '' WHEN mol_id % 13 = 0 THEN substring(smiles, 1, length(smiles) - 3)
            ELSE smiles END AS smiles,
       pic50, active
FROM ({MOLECULES_SQL}) m"""


def bioactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-column bioactivity table derived from ``part`` + molecules."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    m = molecules(spark, sf_dir)
    j = m.join(p, m.mol_id == p.p_partkey)
    return j.select(
        F.upper(F.substring(F.md5("smiles"), 1, 14)).alias("Ambit_InchiKey"),
        F.concat(F.lit("E"), F.col("mol_id").cast("string")).alias("Original_Entry_ID"),
        F.col("p_size").cast("bigint").alias("Entrez_ID"),
        F.when(F.col("active"), "A").otherwise("N").alias("Activity_Flag"),
        F.col("pic50").alias("pXC50"),
        F.when(F.pmod(F.col("mol_id"), F.lit(2)) == 0, "db_a").otherwise("db_b").alias("DB"),
        F.pmod(F.col("mol_id"), F.lit(97)).alias("Original_Assay_ID"),
        F.lit(9606).cast("bigint").alias("Tax_ID"),
        F.col("p_brand").alias("Gene_Symbol"),
        F.pmod(F.col("p_size"), F.lit(10)).cast("bigint").alias("Ortholog_Group"),
        F.concat(F.lit("InChI=1S/"), F.col("smiles")).alias("InChI"),
        F.col("smiles").alias("SMILES"),
    )


BIOACTIVITY_SQL = f"""
SELECT upper(substring(md5(m.smiles), 1, 14)) AS Ambit_InchiKey,
       'E' || CAST(m.mol_id AS VARCHAR) AS Original_Entry_ID,
       CAST(p.p_size AS BIGINT) AS Entrez_ID,
       CASE WHEN m.active THEN 'A' ELSE 'N' END AS Activity_Flag,
       m.pic50 AS pXC50,
       CASE WHEN m.mol_id % 2 = 0 THEN 'db_a' ELSE 'db_b' END AS DB,
       m.mol_id % 97 AS Original_Assay_ID,
       CAST(9606 AS BIGINT) AS Tax_ID,
       p.p_brand AS Gene_Symbol,
       CAST(p.p_size % 10 AS BIGINT) AS Ortholog_Group,
       'InChI=1S/' || m.smiles AS InChI,
       m.smiles AS SMILES
FROM ({MOLECULES_SQL}) m JOIN part p ON m.mol_id = p.p_partkey"""


# The descriptor stand-in features, name -> substring counted in
# the structure string (P and I never occur, so their columns are all zero).
COUNT_FEATURES = [("n_arom_c", "c"), ("n_n", "N"), ("n_o", "O"), ("n_s", "S"), ("n_cl", "Cl"),
                  ("n_br", "Br"), ("n_branch", "("), ("n_double", "="), ("n_triple", "#"),
                  ("n_charge", "+"), ("n_p", "P"), ("n_i", "I")]


def _count(s: Column, sub: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("double")


def mol_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide descriptor table ``(mol_id, split, n_*..., len, ring_per_branch)``;
    ``ring_per_branch`` is null when a molecule has no branch. ``split`` is a
    hash split (80% train)."""
    m = molecules(spark, sf_dir)
    s = F.col("smiles")
    cols = [_count(s, sub).alias(n) for n, sub in COUNT_FEATURES]
    ring = (F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))).cast("double")
    nb = _count(s, "(")
    return m.select(
        "mol_id",
        F.when(uniform("mol_id", seed=1) < 0.8, "train").otherwise("test").alias("split"),
        *cols,
        F.length(s).cast("double").alias("len"),
        F.when(nb > 0, ring / nb).alias("ring_per_branch"),
    )


def _sql_count(sub: str) -> str:
    return f"CAST((length(smiles) - length(replace(smiles, '{sub}', ''))) / {len(sub)} AS DOUBLE)"


MOL_DESCRIPTORS_SQL = f"""
SELECT mol_id,
       CASE WHEN {sql_uniform('mol_id', seed=1)} < 0.8 THEN 'train' ELSE 'test' END AS split,
       {", ".join(f"{_sql_count(sub)} AS {n}" for n, sub in COUNT_FEATURES)},
       CAST(length(smiles) AS DOUBLE) AS len,
       CASE WHEN {_sql_count('(')} > 0
            THEN CAST(length(smiles) - length(regexp_replace(smiles, '[0-9]', '', 'g')) AS DOUBLE) / {_sql_count('(')}
       END AS ring_per_branch
FROM ({MOLECULES_SQL}) m"""

DESCRIPTOR_NAMES = [n for n, _ in COUNT_FEATURES] + ["len", "ring_per_branch"]


def mol_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``(mol_id, split, feature, value)`` of :func:`mol_descriptors`."""
    d = mol_descriptors(spark, sf_dir)
    pairs = ", ".join(f"'{n}', {n}" for n in DESCRIPTOR_NAMES)
    return d.selectExpr("mol_id", "split", f"stack({len(DESCRIPTOR_NAMES)}, {pairs}) AS (feature, value)")


MOL_FEATURES_LONG_SQL = f"""
SELECT mol_id, split, feature, value
FROM ({MOL_DESCRIPTORS_SQL}) d
UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(DESCRIPTOR_NAMES)}))"""
