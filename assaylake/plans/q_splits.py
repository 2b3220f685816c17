"""Registered split / sampling / scaling / feature-selection queries
(P1-P13, Z1-Z5, F5-F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ntz_epoch_micros
from ..functions.hashing import sql_hash32, sql_uniform, uniform
from ..operators import features as FE
from ..operators import splits as SP
from ..sources import tables as S
from .common import r, rounded
from .registry import query, with_ctes

MOL = {"molecules": S.MOLECULES_SQL}


def _ranked_sql(table: str, key: str, seed: int) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY {sql_hash32(key, seed=seed)}, {key}) AS rnk, "
            f"count(*) OVER () AS n FROM {table}")


@query("random_split", with_ctes("""
SELECT mol_id, CASE WHEN rnk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk""",
                                 **MOL, rk=_ranked_sql("molecules", "mol_id", 42)))
def q_random_split(spark, sf):
    return SP.random_split(S.molecules(spark, sf), "mol_id", 0.2, seed=42).select("mol_id", "split")


@query("nested_split", with_ctes("""
SELECT mol_id, CASE WHEN rnk <= ceil(n * 0.1) THEN 'test'
                    WHEN rnk <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.05) THEN 'valid'
                    ELSE 'train' END AS split FROM rk""", **MOL, rk=_ranked_sql("molecules", "mol_id", 42)))
def q_nested_split(spark, sf):
    return SP.nested_split(S.molecules(spark, sf), "mol_id", 0.1, 0.05, seed=42).select("mol_id", "split")


@query("sequential_split", with_ctes("""
SELECT mol_id, CASE WHEN row_number() OVER (ORDER BY mol_id) <= floor(count(*) OVER () * 0.95)
                    THEN 'train' ELSE 'valid' END AS split FROM molecules""", **MOL))
def q_sequential_split(spark, sf):
    return SP.sequential_split(S.molecules(spark, sf), "mol_id", 0.05, tie=["mol_id"]).select("mol_id", "split")


@query("shuffle_cut_split", with_ctes("""
SELECT mol_id, CASE WHEN rnk <= floor(n * 0.95) THEN 'train' ELSE 'valid' END AS split FROM rk""",
                                      **MOL, rk=_ranked_sql("molecules", "mol_id", 7)))
def q_shuffle_cut(spark, sf):
    return SP.shuffle_cut(S.molecules(spark, sf), "mol_id", 0.95, seed=7).select("mol_id", "split")


KFOLD_SQL = """
SELECT mol_id, CAST(CASE WHEN rnk - 1 < (n % 5) * (n // 5 + 1) THEN (rnk - 1) // (n // 5 + 1)
                         ELSE (n % 5) + (rnk - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS BIGINT) AS fold
FROM rk"""


@query("kfold", with_ctes(KFOLD_SQL, **MOL, rk=_ranked_sql("molecules", "mol_id", 41)))
def q_kfold(spark, sf):
    return SP.kfold(S.molecules(spark, sf), "mol_id", 5, seed=41).select("mol_id", "fold")


@query("stratified_kfold", with_ctes(f"""
SELECT mol_id, CAST(label AS BIGINT) AS label,
       CAST((row_number() OVER (PARTITION BY CAST(floor(pic50) AS BIGINT)
                                ORDER BY {sql_hash32('mol_id', seed=3)}, mol_id) - 1) % 4 AS BIGINT) AS fold
FROM (SELECT *, CAST(floor(pic50) AS BIGINT) AS label FROM molecules) m""", **MOL))
def q_stratified_kfold(spark, sf):
    m = S.molecules(spark, sf).withColumn("label", F.floor("pic50").cast("bigint"))
    return SP.stratified_kfold(m, "mol_id", "label", 4, seed=3).select("mol_id", "label", "fold")


@query("rotating_folds", with_ctes("""
SELECT mol_id, fold, CAST(s AS BIGINT) AS split_id,
       CASE WHEN fold = s THEN 'test' WHEN fold = (s + 1) % 5 THEN 'valid' ELSE 'train' END AS role
FROM kf, generate_series(0, 4) AS g(s)""", **MOL, rk=_ranked_sql("molecules", "mol_id", 41), kf=KFOLD_SQL))
def q_rotating_folds(spark, sf):
    kf = SP.kfold(S.molecules(spark, sf), "mol_id", 5, seed=41).select("mol_id", "fold")
    return SP.rotating_folds(kf, 5).select("mol_id", "fold", "split_id", "role")


@query("half_split", with_ctes(f"""
SELECT mol_id, split FROM (
  SELECT mol_id, split, row_number() OVER (ORDER BY {sql_hash32('mol_id', seed=9)}, mol_id) AS rk2,
         count(*) OVER () AS n2
  FROM sp WHERE split = 'train') t WHERE rk2 <= n2 // 2
UNION ALL SELECT mol_id, split FROM sp WHERE split <> 'train'""", **MOL,
                               rk=_ranked_sql("molecules", "mol_id", 42),
                               sp="SELECT mol_id, CASE WHEN rnk <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM rk"))
def q_half_split(spark, sf):
    sp = SP.random_split(S.molecules(spark, sf), "mol_id", 0.3, seed=42).select("mol_id", "split")
    return SP.half_split(sp, "mol_id", seed=9)


@query("bernoulli_ragged", f"""
SELECT l_orderkey, count(*) FILTER (WHERE {sql_uniform('l_orderkey', 'l_linenumber', seed=5)} < 0.5) AS count
FROM lineitem GROUP BY l_orderkey""")
def q_bernoulli(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return SP.bernoulli_counts(SP.bernoulli(li, "l_orderkey", "l_linenumber", 0.5, seed=5), "l_orderkey")


@query("draw_per_group", f"""
WITH rk AS (SELECT l_orderkey, l_linenumber,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY {sql_hash32('l_linenumber', seed=2)}, l_linenumber) AS rnk,
                   count(*) OVER (PARTITION BY l_orderkey) AS m
            FROM lineitem),
dr AS (SELECT DISTINCT l_orderkey, m FROM rk)
SELECT dr.l_orderkey, CAST(d AS BIGINT) AS draw, rk.l_linenumber
FROM dr, generate_series(1, 2) AS g(d), rk
WHERE rk.l_orderkey = dr.l_orderkey AND rk.rnk = {sql_hash32('dr.l_orderkey', 'd', seed=3)} % dr.m + 1""")
def q_draw_per_group(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    out = SP.draw_per_group(li, "l_orderkey", "l_linenumber", 2, seed=2)
    return out.select("l_orderkey", F.col("draw").cast("bigint"), "l_linenumber")


@query("bootstrap_to_size", with_ctes(f"""
SELECT d AS draw, rk.mol_id
FROM generate_series(0, 999) AS g(d), rk
WHERE rk.rnk = {sql_hash32('d', seed=12)} % rk.n + 1""", **MOL, rk=_ranked_sql("molecules", "mol_id", 11)))
def q_bootstrap(spark, sf):
    return SP.bootstrap(spark, S.molecules(spark, sf), "mol_id", 1000, seed=11).select("draw", "mol_id")


@query("bounded_buffer", """
SELECT event_id, user_id FROM (
  SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS age FROM events) t
WHERE age <= 3000""")
def q_bounded_buffer(spark, sf):
    ev = S.table(spark, sf, "events").select(
        "event_id", "user_id", ntz_epoch_micros("ts").alias("t"))
    return SP.bounded_buffer(ev, "t", "event_id", 3000).select("event_id", "user_id")


@query("buffer_sample", f"""
WITH rk AS (SELECT event_id, user_id, row_number() OVER (ORDER BY {sql_hash32('event_id', seed=16)}, event_id) AS rnk,
                   count(*) OVER () AS n
            FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS age FROM events) t WHERE age <= 500)
SELECT d AS draw, event_id, user_id FROM generate_series(0, 255) AS g(d), rk
WHERE n >= 256 AND rnk = {sql_hash32('d', seed=17)} % n + 1""")
def q_buffer_sample(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", "user_id", ntz_epoch_micros("ts").alias("t"))
    kept = SP.bounded_buffer(ev, "t", "event_id", 500)
    return SP.buffer_sample(spark, kept, "event_id", 256, seed=16).select("draw", "event_id", "user_id")


@query("drop_incomplete_batch", with_ctes("""
SELECT mol_id, CAST((rnk - 1) // 64 AS BIGINT) AS batch FROM rk WHERE (rnk - 1) // 64 < n // 64""",
                                          **MOL, rk=_ranked_sql("molecules", "mol_id", 4)))
def q_batches(spark, sf):
    return SP.batches(S.molecules(spark, sf), "mol_id", 64, drop_last=True, seed=4).select("mol_id", "batch")


# ---- scaling and feature selection on the descriptor stand-in ---------------
FEAT = {"molecules": S.MOLECULES_SQL, "feats": S.MOL_FEATURES_LONG_SQL.replace(
    f"({S.MOLECULES_SQL})", "molecules")}


@query("zscore_fit_apply", with_ctes(f"""
SELECT f.mol_id, f.feature, {r("(value - mu) / CASE WHEN sigma = 0 THEN 1.0 ELSE sigma END")} AS z
FROM feats f JOIN (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sigma
                   FROM feats WHERE split = 'train' GROUP BY feature) s ON f.feature = s.feature""", **FEAT))
def q_zscore(spark, sf):
    fl = S.mol_features_long(spark, sf)
    st = FE.fit_zscore(fl.where("split = 'train'"))
    return rounded(FE.apply_zscore(fl, st).select("mol_id", "feature", "z"))


@query("zscore_sample_std", with_ctes(f"""
SELECT mol_id, feature, {r("z")} AS z,
       {r("z * CASE WHEN sigma = 0 THEN 1.0 ELSE sigma END + mu")} AS restored
FROM (SELECT f.mol_id, f.feature, mu, sigma, (value - mu) / CASE WHEN sigma = 0 THEN 1.0 ELSE sigma END AS z
      FROM feats f JOIN (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sigma
                         FROM feats WHERE split = 'train' GROUP BY feature) s ON f.feature = s.feature) t""",
                                      **FEAT))
def q_zscore_samp(spark, sf):
    fl = S.mol_features_long(spark, sf)
    st = FE.fit_zscore(fl.where("split = 'train'"), ddof=1)
    z = FE.apply_zscore(fl, st)
    back = FE.invert_zscore(z, st, out="restored")
    return rounded(back.select("mol_id", "feature", "z", "restored"))


@query("label_norm_split", with_ctes(f"""
SELECT mol_id, split, {r("(pic50 - mu) / sd")} AS y_norm, {r("sd")} AS label_std
FROM (SELECT mol_id, pic50, CASE WHEN {sql_uniform('mol_id', seed=1)} < 0.8 THEN 'train' ELSE 'test' END AS split
      FROM molecules) m,
     (SELECT avg(pic50) AS mu, stddev_pop(pic50) AS sd FROM molecules
      WHERE {sql_uniform('mol_id', seed=1)} < 0.8) s""", **MOL))
def q_label_norm_split(spark, sf):
    m = S.molecules(spark, sf).withColumn(
        "split", F.when(uniform("mol_id", seed=1) < 0.8, "train").otherwise("test"))
    st = FE.fit_zscore(m.where("split = 'train'"), by=(), value="pic50")
    out = FE.apply_zscore(m, st.withColumn("label_std", F.col("sigma")), by=(), value="pic50", out="y_norm")
    return rounded(out.select("mol_id", "split", "y_norm", "label_std"))


@query("label_norm_vector", with_ctes(f"""
SELECT v.id, v.dim, {r("(x - mu) / CASE WHEN sigma = 0 THEN 1.0 ELSE sigma END")} AS z
FROM vl v JOIN (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sigma FROM vl
                WHERE {sql_uniform('id', seed=1)} < 0.8 GROUP BY dim) s ON v.dim = s.dim""",
                                      vl=S.VECTOR_LONG_SQL))
def q_label_norm_vector(spark, sf):
    vl = S.vector_long(spark, sf)
    st = FE.fit_zscore(vl.where(uniform("id", seed=1) < 0.8), by=["dim"], value="x")
    return rounded(FE.apply_zscore(vl, st, by=["dim"], value="x").select("id", "dim", "z"))


@query("variance_select", with_ctes("""
SELECT f.mol_id, f.feature, f.value FROM feats f
WHERE f.split = 'test' AND f.feature IN (
  SELECT feature FROM feats WHERE split = 'train' GROUP BY feature HAVING var_pop(value) > 0.05)""", **FEAT))
def q_variance_select(spark, sf):
    fl = S.mol_features_long(spark, sf)
    kept = FE.variance_select(fl.where("split = 'train'"))
    return rounded(FE.keep_features(fl.where("split = 'test'"), kept).select("mol_id", "feature", "value"))


@query("drop_zero_mean_columns", with_ctes("""
SELECT f.mol_id, f.feature, f.value FROM feats f
WHERE f.split = 'test' AND f.feature IN (
  SELECT feature FROM feats WHERE split = 'train' GROUP BY feature HAVING avg(value) <> 0)""", **FEAT))
def q_drop_zero_mean(spark, sf):
    fl = S.mol_features_long(spark, sf)
    kept = FE.zero_mean_features(fl.where("split = 'train'"))
    return rounded(FE.keep_features(fl.where("split = 'test'"), kept).select("mol_id", "feature", "value"))


@query("drop_null_columns", with_ctes("""
SELECT f.mol_id, f.feature, f.value FROM feats f
WHERE f.feature IN (SELECT feature FROM feats GROUP BY feature HAVING count(*) FILTER (WHERE value IS NULL) = 0)""",
                                      **FEAT))
def q_drop_null_columns(spark, sf):
    fl = S.mol_features_long(spark, sf)
    return rounded(FE.keep_features(fl, FE.nonnull_features(fl)).select("mol_id", "feature", "value"))


@query("align_columns", with_ctes(f"""
SELECT mol_id, {", ".join(reversed(S.DESCRIPTOR_NAMES))} FROM ({S.MOL_DESCRIPTORS_SQL.replace(
    f"({S.MOLECULES_SQL})", "molecules")}) d WHERE split = 'test'""", **MOL))
def q_align_columns(spark, sf):
    d = S.mol_descriptors(spark, sf)
    train_order = ["mol_id"] + list(reversed(S.DESCRIPTOR_NAMES))
    return rounded(FE.align_columns(d.where("split = 'test'"), train_order))
