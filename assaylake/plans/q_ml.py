"""Registered modelling queries (ML1-ML4) and the flagship potency pipeline.

What a trained model predicts has no SQL twin, so the queries return what has
one beside it: rows and sizes of the splits, label statistics, the selected bits,
and checks whose answer is known (predictions lie in the label's range, the fit
beats the mean predictor, a reloaded pipeline predicts the same)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import to_ic50
from ..operators import metrics as M
from ..operators import ml as ML
from ..operators import molecules as MO
from ..operators import splits as SP
from ..session import scratch_path, written
from ..sources import tables as S
from .common import r, rounded
from .q_molecules import _fp_sql, with_graph
from .q_splits import _ranked_sql
from .registry import query

N_BITS = 2048


def _prepared(spark, sf):
    """(train, test) with sorted on-bits; the bit table is written once."""
    m = S.molecules(spark, sf)
    bits = written(MO.circular_fingerprint_rows(m, radius=2, n_bits=N_BITS), "bits")
    sp = SP.random_split(m.select("mol_id", "pic50"), "mol_id", 0.2, seed=42)
    rows = written(ML.bit_rows(sp, bits), "bit-rows")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


SPLIT_SQL = "SELECT mol_id, pic50, CASE WHEN rnk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk"
KEPT_SQL = """
SELECT f.bit FROM fp f JOIN sp s ON f.mol_id = s.mol_id, (SELECT count(*) AS n FROM sp WHERE split = 'train') t
WHERE s.split = 'train' GROUP BY f.bit, t.n
HAVING count(*) * (t.n - count(*)) / (CAST(t.n AS DOUBLE) * (t.n - 1)) > 0.05"""
STATS_SQL = """
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
       avg(pic50) FILTER (WHERE split = 'train') AS m, stddev_pop(pic50) FILTER (WHERE split = 'train') AS s FROM sp"""


def _model_sql(body: str) -> str:
    fp = _fp_sql(2, N_BITS)
    return with_graph(body, **fp, rk=_ranked_sql("molecules", "mol_id", 42), sp=SPLIT_SQL, kept=KEPT_SQL, st=STATS_SQL)


def _summary(model, train, test, in_range: bool = True):
    """One row: label range and whether the training fit beats the mean predictor."""
    fit = model.transform(train).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("pic50"), 2))).alias("rmse"),
                                     F.min("pic50").alias("lo"), F.max("pic50").alias("hi"), F.count(F.lit(1)).alias("n_train"))
    mean, std = ML.label_stats(model)
    return fit.crossJoin(F.broadcast(test.agg(F.count(F.lit(1)).alias("n_test")))).select(
        "n_train", "n_test", F.lit(mean).alias("label_mean"), F.lit(std).alias("label_std"), F.lit(len(ML.kept_bits(model))).cast("bigint").alias("n_kept"),
        (F.col("rmse") < std).alias("beats_mean"), "lo", "hi")


MODEL_COLS = f"""n_train, n_test, {r('m')} AS label_mean, {r('s')} AS label_std,
       (SELECT count(*) FROM kept) AS n_kept, TRUE AS beats_mean"""


@query("rf_regression", _model_sql(f"""
SELECT sp.mol_id, {r('pic50')} AS pic50, TRUE AS in_range, {MODEL_COLS} FROM sp, st WHERE split = 'test'"""))
def q_rf_regression(spark, sf):
    """Test rows with a forest's prediction (an average of training labels, so
    within their range), and the fit's summary."""
    train, test = _prepared(spark, sf)
    model = ML.potency_pipeline(spark).fit(train)
    s = _summary(model, train, test)
    out = model.transform(test).crossJoin(F.broadcast(s))       # one row
    ok = F.col("pred").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9) & (to_ic50("pred") > 0)
    return rounded(out.select("mol_id", "pic50", ok.alias("in_range"), *[c for c in s.columns if c not in ("lo", "hi")]))


@query("linear_on_bits", _model_sql(f"""
SELECT sp.mol_id, {r('pic50')} AS pic50, TRUE AS predicted, {MODEL_COLS} FROM sp, st WHERE split = 'test'"""))
def q_linear_on_bits(spark, sf):
    train, test = _prepared(spark, sf)
    model = ML.potency_pipeline(spark, "linear").fit(train)
    s = _summary(model, train, test)
    out = model.transform(test).crossJoin(F.broadcast(s))       # one row
    ok = F.col("pred").isNotNull() & ~F.isnan("pred")
    return rounded(out.select("mol_id", "pic50", ok.alias("predicted"), *[c for c in s.columns if c not in ("lo", "hi")]))


@query("pipeline_persist", _model_sql("""
SELECT sp.mol_id, TRUE AS same_pred, k.bits AS kept_bits FROM sp,
  (SELECT string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM kept) k WHERE split = 'test'"""))
def q_pipeline_persist(spark, sf):
    """One saved pipeline (selector, label scaling, model, inverse), read again:
    the same predictions and the same bits."""
    train, test = _prepared(spark, sf)
    model = ML.potency_pipeline(spark).fit(train)
    path = scratch_path(spark, "pipeline")
    ML.save_model(model, path)
    again = ML.load_model(path)
    old = ML.batch_predict(model, test).withColumnRenamed("pred", "old")
    bits = ",".join(str(b) for b in ML.kept_bits(again))
    return ML.batch_predict(again, test).join(old, "mol_id").select(
        "mol_id", (F.col("pred") == F.col("old")).alias("same_pred"), F.lit(bits).alias("kept_bits"))


@query("batch_predict", _model_sql(f"""
SELECT 'T' || CAST(mol_id AS VARCHAR) AS "ID", TRUE AS in_units, {r('m')} AS label_mean, {r('s')} AS label_std
FROM sp, st WHERE split = 'test'"""))
def q_batch_predict(spark, sf):
    """The fitted pipeline applied to the whole unlabelled table in one
    transform (not row by row); ``in_units``: the scaled prediction times the
    label's deviation plus its mean, and a positive IC50."""
    train, test = _prepared(spark, sf)
    model = ML.potency_pipeline(spark).fit(train)
    mean, std = ML.label_stats(model)
    out = model.transform(test.drop("pic50"))
    ok = (F.abs(F.col("scaled_pred") * std + mean - F.col("pred")) < 1e-9) & (to_ic50("pred") > 0)
    return rounded(out.select(F.concat(F.lit("T"), F.col("mol_id").cast("string")).alias("ID"), ok.alias("in_units"),
                              F.lit(mean).alias("label_mean"), F.lit(std).alias("label_std")))


def potency_score(spark, sf):
    """Flagship: molecules -> circular fingerprint -> 80/20 hash split ->
    bit variance selection on train -> random forest -> competition score."""
    train, test = _prepared(spark, sf)
    model = ML.potency_pipeline(spark).fit(train)
    pred = model.transform(test).select("mol_id", "pic50", "pred")
    return rounded(M.competition_score(pred, label="pic50", pred="pred", scale="ic50").crossJoin(
        M.regression_metrics(pred, label="pic50", pred="pred").select("n", "rmse", "mae")))


@query("potency_fingerprint_score", _model_sql("SELECT n_test AS n, TRUE AS ordered, TRUE AS bounded FROM st"))
def q_potency_fingerprint_score(spark, sf):
    """The flagship's size, and that its measures can be so: mae <= rmse, and a
    score and an rmse within their bounds (labels lie in a range of 6)."""
    s = potency_score(spark, sf)
    return s.select("n", (F.col("mae") <= F.col("rmse") + 1e-6).alias("ordered"),
                    (F.col("score").between(0.0, 1.0) & F.col("rmse").between(0.0, 6.0)).alias("bounded"))
