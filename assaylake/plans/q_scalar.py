"""Registered scalar-expression and filter queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as E
from ..functions import vectors as V
from ..functions.smiles import RING_RE, sql_tokens, valid_smiles
from ..operators import features as FE
from ..sources import tables as S
from .common import r, rounded
from .registry import query, with_ctes

MOL = {"molecules": S.MOLECULES_SQL}


@query("pic50_to_ic50", with_ctes(f"""
SELECT mol_id, {r("pow(10.0, 9 - pic50)", 4)} AS ic50_nm FROM molecules""", **MOL))
def q_pic50_to_ic50(spark, sf):
    m = S.molecules(spark, sf)
    return m.select("mol_id", F.round(E.to_ic50("pic50"), 4).alias("ic50_nm"))


@query("ic50_to_pic50", with_ctes(f"""
SELECT mol_id, {r("9 - log10(pow(10.0, 9 - pic50))")} AS pic50_back FROM molecules""", **MOL))
def q_ic50_to_pic50(spark, sf):
    m = S.molecules(spark, sf)
    return rounded(m.select("mol_id", E.to_pic50(E.to_ic50("pic50")).alias("pic50_back")))


# Per-target unit conversion of the 19 quantum-chemistry labels
# (1 = unchanged, 27.2113825435 = hartree to eV, 0.04336414 = kcal/mol to eV).
HAR2EV = 27.2113825435
KCALMOL2EV = 0.04336414
CONVERSION = [1.0, 1.0, HAR2EV, HAR2EV, HAR2EV, 1.0, HAR2EV, HAR2EV, HAR2EV, HAR2EV, HAR2EV, 1.0,
              KCALMOL2EV, KCALMOL2EV, KCALMOL2EV, KCALMOL2EV, 1.0, 1.0, 1.0]


@query("unit_conversion", with_ctes(f"""
SELECT id, dim AS target, {r("x / ([" + ", ".join(repr(c) for c in CONVERSION) + "])[dim + 1]")} AS value
FROM vl WHERE dim < 19""", vl=S.VECTOR_LONG_SQL))
def q_unit_conversion(spark, sf):
    vl = S.vector_long(spark, sf).where("dim < 19")
    conv = F.element_at(F.array(*[F.lit(c) for c in CONVERSION]), (F.col("dim") + 1).cast("int"))
    return rounded(vl.select("id", F.col("dim").alias("target"), (F.col("x") / conv).alias("value")))


@query("offset_encode", """
SELECT p_partkey AS id,
       array_to_string(list_transform([p_size, p_partkey % 50, length(p_name)], lambda x, i: x + 1 + 512 * (i - 1)), ',') AS codes
FROM part""")
def q_offset_encode(spark, sf):
    p = S.table(spark, sf, "part")
    arr = F.array(F.col("p_size").cast("bigint"), F.pmod("p_partkey", F.lit(50)).cast("bigint"),
                  F.length("p_name").cast("bigint"))
    return p.select(F.col("p_partkey").alias("id"),
                    F.array_join(V.offset_encode(arr, 512), ",").alias("codes"))


@query("softmax_prob", with_ctes(f"""
SELECT id, {r("exp(logits[label + 1] - (list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))))")} AS prob
FROM cs""", cs=S.CLASS_SCORES_SQL))
def q_softmax_prob(spark, sf):
    c = S.class_scores(spark, sf)
    return rounded(c.select("id", V.softmax_at("logits", "label").alias("prob")))


@query("neg_abs_error", with_ctes(f"""
SELECT id, {r("-abs(pred - target)")} AS reward FROM predictions""", predictions=S.PREDICTIONS_SQL))
def q_neg_abs_error(spark, sf):
    p = S.predictions(spark, sf)
    return rounded(p.select("id", E.neg_abs_err("pred", "target").alias("reward")))


@query("piecewise_schedule", f"""
SELECT event_id, {r("CASE WHEN event_id < 100 THEN 1.0 WHEN event_id > 5000 THEN 0.05 "
                    "ELSE 1.0 - (event_id - 100) / 4900.0 * 0.95 END")} AS eps
FROM events""")
def q_piecewise(spark, sf):
    ev = S.table(spark, sf, "events")
    return rounded(ev.select("event_id", E.piecewise("event_id", 1.0, 0.05, 100, 5000).alias("eps")))


@query("swish_sigmoid", with_ctes(f"""
SELECT id, dim, {r("1 / (1 + exp(-x))")} AS sigmoid, {r("x / (1 + exp(-x))")} AS swish FROM vl""",
                                  vl=S.VECTOR_LONG_SQL))
def q_swish(spark, sf):
    vl = S.vector_long(spark, sf)
    return rounded(vl.select("id", "dim", E.sigmoid("x").alias("sigmoid"), E.swish("x").alias("swish")))


@query("one_hot_argmax", """
SELECT vec_id AS id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ',') AS one_hot,
       CAST(label AS BIGINT) AS back
FROM embeddings""")
def q_one_hot(spark, sf):
    e = S.table(spark, sf, "embeddings")
    oh = V.one_hot(F.col("label"), 10)
    return e.select(F.col("vec_id").alias("id"), oh.alias("oh")).select(
        "id", F.array_join("oh", ",").alias("one_hot"), V.one_hot_argmax("oh").alias("back"))


@query("position_encoding", f"""
SELECT conv_id, turn, CAST(d AS BIGINT) AS dim,
       {r(f"CASE WHEN d % 2 = 0 THEN sin(turn * exp((d - d % 2) * ({-math.log(10000.0) / 16!r})))"
          f" ELSE cos(turn * exp((d - d % 2) * ({-math.log(10000.0) / 16!r}))) END")} AS pe
FROM conversations, generate_series(0, 15) AS g(d)""")
def q_position_encoding(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", "turn")
    d = c.select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("dim"))
    return rounded(d.select("conv_id", "turn", "dim", E.position_encoding("turn", "dim", 16).alias("pe")))


@query("normalize_name", """
SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_type || '_' || p_brand), '[-_ ]', '', 'g') AS name
FROM part""")
def q_normalize_name(spark, sf):
    p = S.table(spark, sf, "part")
    raw = F.concat_ws("", "p_name", F.lit("-"), "p_type", F.lit("_"), "p_brand")
    return p.select("p_partkey", E.normalize_name(raw).alias("name"))


@query("l2_normalize", with_ctes(f"""
SELECT v.id, v.dim, {r("x / sqrt(ss)")} AS x
FROM vl v JOIN (SELECT id, sum(x * x) AS ss FROM vl GROUP BY id) n ON v.id = n.id""", vl=S.VECTOR_LONG_SQL))
def q_l2_normalize(spark, sf):
    v = S.vectors(spark, sf).select("id", V.l2_normalize("vec").alias("vec"))
    return rounded(v.select("id", F.posexplode("vec").alias("dim", "x")).withColumn("dim", F.col("dim").cast("bigint")))


# ---- filters -----------------------------------------------------------------

@query("filter_active", with_ctes("""
SELECT Original_Entry_ID, SMILES, pXC50 FROM bio WHERE Activity_Flag = 'A'""", bio=S.BIOACTIVITY_SQL))
def q_filter_active(spark, sf):
    return FE.filter_active(S.bioactivity(spark, sf)).select("Original_Entry_ID", "SMILES", "pXC50")


# DuckDB twin of valid_smiles over the long token table
VALID_SQL = f"""
SELECT a.mol_id, a.smiles, a.pic50,
  coalesce(length(a.smiles) > 0
    AND array_to_string({sql_tokens('a.smiles')}, '') = a.smiles
    AND coalesce(d.min_depth, 0) >= 0 AND coalesce(d.final_depth, 0) = 0
    AND coalesce(rg.odd, 0) = 0, false) AS valid
FROM raw a
LEFT JOIN (SELECT mol_id, min(depth) AS min_depth, arg_max(depth, i) AS final_depth FROM (
             SELECT mol_id, i, sum(CASE WHEN t = '(' THEN 1 WHEN t = ')' THEN -1 ELSE 0 END)
                      OVER (PARTITION BY mol_id ORDER BY i) AS depth
             FROM (SELECT mol_id, unnest({sql_tokens('smiles')}) AS t,
                          unnest(generate_series(1, len({sql_tokens('smiles')}))) AS i FROM raw) x) y
           GROUP BY mol_id) d ON a.mol_id = d.mol_id
LEFT JOIN (SELECT mol_id, count(*) FILTER (WHERE c % 2 = 1) AS odd FROM (
             SELECT mol_id, t, count(*) AS c FROM (
               SELECT mol_id, unnest({sql_tokens('smiles')}) AS t FROM raw) z
             WHERE regexp_matches(t, '{RING_RE}') GROUP BY mol_id, t) w GROUP BY mol_id) rg
  ON a.mol_id = rg.mol_id"""

RAW = {"raw": S.ASSAY_RAW_SQL}


@query("valid_flag", with_ctes("SELECT mol_id, valid FROM v", **RAW, v=VALID_SQL))
def q_valid_flag(spark, sf):
    a = S.assay_raw(spark, sf)
    return a.select("mol_id", valid_smiles("smiles").alias("valid"))


@query("drop_invalid", with_ctes(f"SELECT mol_id, smiles, {r('pic50')} AS pic50 FROM v WHERE valid",
                                 **RAW, v=VALID_SQL))
def q_drop_invalid(spark, sf):
    a = S.assay_raw(spark, sf)
    derived = a.withColumn("fp", F.when(valid_smiles("smiles"), F.col("smiles")))
    return rounded(FE.drop_invalid(derived, "fp").select("mol_id", "smiles", "pic50"))


@query("invalid_to_zero", with_ctes(f"""
SELECT mol_id, CASE WHEN valid THEN CAST(len({sql_tokens('smiles')}) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_tokens
FROM v""", **RAW, v=VALID_SQL))
def q_invalid_to_zero(spark, sf):
    from ..functions.smiles import tokens
    a = S.assay_raw(spark, sf)
    derived = a.withColumn("toks", F.when(valid_smiles("smiles"), tokens("smiles")))
    z = derived.withColumn("toks", F.coalesce(F.col("toks"), F.array().cast("array<string>")))
    return z.select("mol_id", F.size("toks").cast("bigint").alias("n_tokens"))


@query("mask_missing_labels", with_ctes(f"""
SELECT id, {r('label')} AS label FROM (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN 'NaN'::DOUBLE
                            ELSE CAST(label AS DOUBLE) END AS label FROM embeddings) t
WHERE label IS NOT NULL AND NOT isnan(label)"""))
def q_mask_missing(spark, sf):
    e = S.table(spark, sf, "embeddings")
    lab = (F.when(F.pmod("vec_id", F.lit(7)) == 0, F.lit(None).cast("double"))
           .when(F.pmod("vec_id", F.lit(11)) == 0, F.lit(float("nan")))
           .otherwise(F.col("label").cast("double")))
    d = e.select(F.col("vec_id").alias("id"), lab.alias("label"))
    return rounded(FE.mask_missing(d, "label"))


@query("select_target", with_ctes(f"SELECT id, {r('vec[3]')} AS y FROM v", v=S.VECTORS_SQL))
def q_select_target(spark, sf):
    v = S.vectors(spark, sf).select("id", *[F.col("vec")[i].alias(f"t{i}") for i in range(19)])
    return rounded(FE.select_target(v, ["id"], "t2"))


@query("drop_self_loops", """
SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_custkey <> l_suppkey""")
def q_drop_self_loops(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    e = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"),
                                                          F.col("l_suppkey").alias("dst")).distinct()
    return FE.drop_self_loops(e)
