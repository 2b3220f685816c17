"""Registered metric / loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ntz_epoch_micros
from ..operators import metrics as M
from ..operators.ranking import placed
from ..functions.hashing import hash32, sql_hash32
from ..sources import tables as S
from .common import r, rounded
from .registry import query, with_ctes

P = {"predictions": S.PREDICTIONS_SQL}


@query("regression_metrics", with_ctes(f"""
SELECT active, count(*) AS n,
       {r('avg(pow(pred - target, 2))')} AS mse,
       {r('sqrt(avg(pow(pred - target, 2)))')} AS rmse,
       {r('sqrt(avg(pow(pow(10.0, 9 - pred) - pow(10.0, 9 - target), 2)))')} AS rmse_ic50,
       {r('avg(abs(pred - target))')} AS mae,
       {r('avg(abs(pred - target)) * 0.75')} AS mae_std
FROM predictions GROUP BY active""", **P))
def q_regression_metrics(spark, sf):
    return rounded(M.regression_metrics(S.predictions(spark, sf), by=["active"], label_std=0.75))


def _comp_sql(scale: str) -> str:
    eb = ("abs(pow(10.0, 9 - pred) - pow(10.0, 9 - target))" if scale == "ic50"
          else "abs(pred - target)")
    return with_ctes(f"""
SELECT active, {r('a')} AS a, {r('b')} AS b,
       {r('0.5 * (1 - least(a, 1.0)) + 0.5 * b')} AS score
FROM (SELECT active, avg(abs(pred - target)) / (max(pred) - min(pred)) AS a,
             avg(CASE WHEN {eb} <= 0.5 THEN 1.0 ELSE 0.0 END) AS b
      FROM predictions GROUP BY active) t""", **P)


@query("competition_score", _comp_sql("ic50"))
def q_competition_score(spark, sf):
    return rounded(M.competition_score(S.predictions(spark, sf), by=["active"], scale="ic50"))


@query("competition_score_pic50", _comp_sql("pic50"))
def q_competition_score_pic50(spark, sf):
    return rounded(M.competition_score(S.predictions(spark, sf), by=["active"], scale="pic50"))


@query("pointwise_losses", with_ctes(f"""
SELECT active,
  {r("avg(CASE WHEN abs(pred - target) <= 0.5 THEN pow(pred - target, 2) ELSE 0.5 * (abs(pred - target) - 0.25) END)")} AS huber,
  {r("avg(CASE WHEN abs(pred - target) < 0.5 THEN 0.0 ELSE pow(pred - target, 2) END)")} AS mse_deadzone,
  {r("avg(pow(ln(1 + greatest(pred, 0.0)) - ln(1 + greatest(target, 0.0)), 2))")} AS msle,
  {r("avg(pow(pred - target, 2)) + 0.1 * sum(greatest(pred - 0.5, 0.0))")} AS threshold_penalty
FROM predictions GROUP BY active""", **P))
def q_pointwise_losses(spark, sf):
    return rounded(M.pointwise_losses(S.predictions(spark, sf), by=["active"]))


@query("berhu", with_ctes(f"""
SELECT p.active,
  {r("avg(CASE WHEN abs(pred - target) <= c THEN abs(pred - target) ELSE (pow(pred - target, 2) + c * c) / (2 * c) END)")} AS berhu
FROM predictions p JOIN (SELECT active, 0.2 * max(abs(pred - target)) AS c FROM predictions GROUP BY active) m
  ON p.active = m.active
GROUP BY p.active""", **P))
def q_berhu(spark, sf):
    return rounded(M.berhu(S.predictions(spark, sf), by=["active"]))


@query("bce_logits", with_ctes(f"""
SELECT {r("avg(greatest(x, 0.0) - x * label + ln(1 + exp(-abs(x))))")} AS bce, count(*) AS n
FROM (SELECT 10.0 * (score - 0.5) AS x, label FROM scores) t
WHERE label IS NOT NULL AND NOT isnan(label)""", scores=S.SCORES_SQL))
def q_bce_logits(spark, sf):
    s = S.scores(spark, sf).withColumn("logit", F.lit(10.0) * (F.col("score") - 0.5))
    return rounded(M.bce_logits(s))


@query("classification_metrics", with_ctes(f"""
SELECT {r("avg(CASE WHEN am = label THEN 1.0 ELSE 0.0 END)")} AS accuracy,
       {r("avg(ce)")} AS cross_entropy,
       {r("avg(pow(1 - exp(-ce), 2.0) * ce)")} AS focal_mean,
       {r("sum(pow(1 - exp(-ce), 2.0) * ce)")} AS focal_sum
FROM (SELECT label, list_position(logits, list_max(logits)) - 1 AS am,
             list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
               - logits[label + 1] AS ce
      FROM class_scores) t""", class_scores=S.CLASS_SCORES_SQL))
def q_classification_metrics(spark, sf):
    return rounded(M.classification_metrics(S.class_scores(spark, sf)))


FOCAL_SQL = """
SELECT id, label, pow(1 - exp(-ce), 2.0) * ((label + 1) / 10.0) * ce AS focal
FROM (SELECT id, label, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
               - logits[label + 1] AS ce FROM class_scores) t"""
#: class weights 0.1, 0.2, ...
ALPHA = [(k + 1) / 10.0 for k in range(10)]


@query("focal_loss_rows", with_ctes(f"SELECT id, {r('focal')} AS focal FROM f", class_scores=S.CLASS_SCORES_SQL, f=FOCAL_SQL))
def q_focal_loss_rows(spark, sf):
    return rounded(M.focal_loss(S.class_scores(spark, sf), alpha=ALPHA, reduction="none").select("id", "focal"))


@query("focal_loss_weighted", with_ctes(f"""
SELECT label, {r('avg(focal)')} AS focal_mean, {r('sum(focal)')} AS focal_sum FROM f GROUP BY label""",
                                        class_scores=S.CLASS_SCORES_SQL, f=FOCAL_SQL))
def q_focal_loss_weighted(spark, sf):
    c = S.class_scores(spark, sf)
    mean, total = (M.focal_loss(c, alpha=ALPHA, reduction=how, by=["label"]).withColumnRenamed("focal", f"focal_{how}") for how in ("mean", "sum"))
    return rounded(mean.join(total, "label"))


@query("auroc", with_ctes(f"""
SELECT {r("sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg))")} AS auroc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT s, pos, neg,
             coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg
            FROM scores WHERE label IS NOT NULL GROUP BY score) a) b""", scores=S.SCORES_SQL))
def q_auroc(spark, sf):
    return rounded(M.auroc(S.scores(spark, sf)))


# rank losses: each class_scores row is a group; position 0 = logit of the true
# label, positions 1..9 = the other logits in index order
RANK_SQL = """
SELECT id AS grp, CASE WHEN i - 1 = label THEN 0 ELSE 1 END AS pos, logits[i] AS score
FROM class_scores, generate_series(1, 10) AS g(i)"""


def _rank_input(spark, sf):
    c = S.class_scores(spark, sf)
    return c.select(F.col("id").alias("grp"), "label", F.posexplode("logits").alias("i", "score")).select(
        "grp", F.when(F.col("i") == F.col("label"), 0).otherwise(1).alias("pos"), "score")


@query("rank_losses", with_ctes(f"""
SELECT {r("avg(pos_term + neg_term)")} AS neg_log,
       {r("sum(bce_sum) / sum(n)")} AS first_pos_bce,
       {r("sum(coalesce(mr, 0.0))")} AS margin_rank
FROM (SELECT grp,
        max(CASE WHEN pos = 0 THEN -ln(1 / (1 + exp(-score))) END) AS pos_term,
        avg(CASE WHEN pos <> 0 THEN -ln(1 - 1 / (1 + exp(-score))) END) AS neg_term,
        sum(greatest(score, 0.0) - score * (CASE WHEN pos = 0 THEN 1.0 ELSE 0.0 END) + ln(1 + exp(-abs(score)))) AS bce_sum,
        count(*) AS n
      FROM ranked GROUP BY grp) g
LEFT JOIN (SELECT n.grp, sum(greatest(15.0 - (p.score - n.score), 0.0)) AS mr
           FROM ranked n JOIN ranked p ON n.grp = p.grp AND p.pos = 0 AND n.pos <> 0
           GROUP BY n.grp) m ON g.grp = m.grp""", class_scores=S.CLASS_SCORES_SQL, ranked=RANK_SQL))
def q_rank_losses(spark, sf):
    return rounded(M.rank_losses(_rank_input(spark, sf)))


@query("epoch_mean_of_batches", with_ctes(f"""
SELECT {r("avg(m)")} AS epoch_mean, {r("sum(s) / sum(n)")} AS row_mean, count(*) AS n_batches
FROM (SELECT batch, avg(pow(pred - target, 2)) AS m, sum(pow(pred - target, 2)) AS s, count(*) AS n
      FROM (SELECT *, (row_number() OVER (ORDER BY {sql_hash32('id', seed=3)}, id) - 1) // 512 AS batch
            FROM predictions) x GROUP BY batch) y""", **P))
def q_epoch_mean_of_batches(spark, sf):
    p = S.predictions(spark, sf).withColumn("_h", hash32("id", seed=3))
    p = placed(p, ["_h", "id"], rank="rank").withColumn("batch", F.floor((F.col("rank") - 1) / 512))
    return rounded(M.mean_of_batch_means(p))


# a state (event) has four actions; the event's own one is its id modulo 4
EXPERIENCE_SQL = """
SELECT user_id, ts, event_id, (event_id * (event_id % 4 + 3)) % 101 / 100.0 AS q,
       CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS reward
FROM events"""
ACTIONS_SQL = "SELECT event_id, a AS action, (event_id * (a + 3)) % 101 / 100.0 AS q FROM events, generate_series(0, 3) AS g(a)"


def _value(action):
    return F.pmod(F.col("event_id") * (action + 3), F.lit(101)) / F.lit(100.0)


def experience(spark, sf):
    ev = S.table(spark, sf, "events")
    return ev.select("user_id", ntz_epoch_micros("ts").alias("ts_us"), "event_id",
                     _value(F.pmod(F.col("event_id"), F.lit(4))).alias("q"),
                     F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("reward"))


def action_values(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id")
    return (ev.withColumn("action", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .withColumn("q", _value(F.col("action"))))


@query("td_error", with_ctes(f"""
SELECT {r("avg(pow(q - tgt, 2))")} AS td_error, {r("avg(tgt)")} AS mean_target
FROM (SELECT q, reward + 0.9 * coalesce(lead(best) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS tgt
      FROM (SELECT x.*, (SELECT max(a.q) FROM actions a WHERE a.event_id = x.event_id) AS best FROM experience x) e) t""",
                             experience=EXPERIENCE_SQL, actions=ACTIONS_SQL))
def q_td_error(spark, sf):
    return rounded(M.td_error(experience(spark, sf), "user_id", "ts_us", ["event_id"], "q", "reward", "event_id",
                              action_values(spark, sf), gamma=0.9))


# per metric and fold: results of 5 folds of the predictions, then mean/std
FOLD_RESULTS_SQL = f"""
SELECT metric, fold, value FROM (
  SELECT fold, avg(pow(pred - target, 2)) AS mse, avg(abs(pred - target)) AS mae
  FROM (SELECT *, {sql_hash32('id', seed=5)} % 5 AS fold FROM predictions) p GROUP BY fold) t
UNPIVOT (value FOR metric IN (mse, mae))"""


def fold_results(spark, sf):
    p = S.predictions(spark, sf).withColumn("fold", F.pmod(hash32("id", seed=5), F.lit(5)))
    e = F.col("pred") - F.col("target")
    per = p.groupBy("fold").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return per.select("fold", F.expr("stack(2, 'mse', mse, 'mae', mae) AS (metric, value)"))


@query("results_summary", with_ctes(f"""
SELECT metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, count(*) AS n
FROM fold_results GROUP BY metric""", predictions=S.PREDICTIONS_SQL, fold_results=FOLD_RESULTS_SQL))
def q_results_summary(spark, sf):
    return rounded(M.results_summary(fold_results(spark, sf)))


# grid: shift x scale applied to predictions, repeats = 3 hash folds, split by hash
def _grid_sql():
    u = f"({sql_hash32('id', seed=11)} / 4294967296.0)"
    return f"""
SELECT shift, scale, split, rep, avg(pow(scale * pred + shift - target, 2)) AS value
FROM (SELECT *, CASE WHEN {u} < 0.5 THEN 'valid' ELSE 'test' END AS split,
             {sql_hash32('id', seed=13)} % 3 AS rep FROM predictions) p,
     (SELECT unnest([-0.1, 0.0, 0.1]) AS shift) a, (SELECT unnest([0.9, 1.0]) AS scale) b
GROUP BY shift, scale, split, rep"""


def grid_results(spark, sf):
    from ..functions.hashing import uniform
    p = S.predictions(spark, sf).select(
        "id", "target", "pred",
        F.when(uniform("id", seed=11) < 0.5, "valid").otherwise("test").alias("split"),
        F.pmod(hash32("id", seed=13), F.lit(3)).alias("rep"))
    # the parameter grid is a fixed 3x2 literal: exploded per row, not joined
    grid = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(c).alias("scale"))
                     for s in (-0.1, 0.0, 0.1) for c in (0.9, 1.0)])
    g = p.select("*", F.explode(grid).alias("g")).select("*", "g.shift", "g.scale")
    return g.groupBy("shift", "scale", "split", "rep").agg(
        F.avg(F.pow(F.col("scale") * F.col("pred") + F.col("shift") - F.col("target"), 2)).alias("value"))


@query("best_by_metric", with_ctes(f"""
SELECT CAST(shift AS DOUBLE) AS shift, CAST(scale AS DOUBLE) AS scale,
       {r('valid_mean')} AS valid_mean, {r('valid_std')} AS valid_std,
       {r('test_mean')} AS test_mean, {r('test_std')} AS test_std
FROM (SELECT shift, scale,
        avg(value) FILTER (WHERE split = 'valid') AS valid_mean,
        stddev_pop(value) FILTER (WHERE split = 'valid') AS valid_std,
        avg(value) FILTER (WHERE split = 'test') AS test_mean,
        stddev_pop(value) FILTER (WHERE split = 'test') AS test_std
      FROM grid GROUP BY shift, scale) s
ORDER BY valid_mean, shift, scale LIMIT 1""", predictions=S.PREDICTIONS_SQL, grid=_grid_sql()))
def q_best_by_metric(spark, sf):
    return rounded(M.best_by_metric(grid_results(spark, sf), ["shift", "scale"], mode="min"))


CONTRAST_SQL = f"""
SELECT a.batch, count(*) AS n, {r("avg(lse - sii / 0.5)")} AS contrast, {r("avg(lse_off - sii)")} AS infonce
FROM (SELECT x.batch, x.id,
             max(CASE WHEN x.id = y.id THEN d END) AS sii,
             ln(sum(exp(d / 0.5))) AS lse,
             ln(sum(CASE WHEN x.id <> y.id THEN exp(d) END)) AS lse_off
      FROM (SELECT x.batch, x.id, y.id AS yid,
                   list_sum(list_transform(range(1, 33), lambda k: x.vec[k] * y.vec[k + 32])) AS d
            FROM bv x JOIN bv y ON x.batch = y.batch) p
      JOIN bv x ON p.id = x.id JOIN bv y ON p.yid = y.id
      GROUP BY x.batch, x.id) a
GROUP BY a.batch"""


def _batched_vectors(spark, sf):
    v = S.vectors(spark, sf).withColumn("_h", hash32("id", seed=21))
    v = placed(v, ["_h", "id"], rank="rank").withColumn("batch", F.floor((F.col("rank") - 1) / 50).cast("bigint"))
    return v.select("batch", "id", F.slice("vec", 1, 32).alias("va"), F.slice("vec", 33, 32).alias("vb"))


@query("contrast_two_view", with_ctes(f"""
SELECT batch, n, contrast FROM c""", vectors=S.VECTORS_SQL, bv=f"""
SELECT id, vec, (row_number() OVER (ORDER BY {sql_hash32('id', seed=21)}, id) - 1) // 50 AS batch FROM vectors""",
                                      c=CONTRAST_SQL))
def q_contrast_two_view(spark, sf):
    out = M.contrast_losses(_batched_vectors(spark, sf), "batch", "id", "va", "vb", temperature=0.5)
    return rounded(out.select("batch", "n", "contrast"))


@query("infonce_matrix", with_ctes(f"""
SELECT batch, n, infonce FROM c""", vectors=S.VECTORS_SQL, bv=f"""
SELECT id, vec, (row_number() OVER (ORDER BY {sql_hash32('id', seed=21)}, id) - 1) // 50 AS batch FROM vectors""",
                                   c=CONTRAST_SQL))
def q_infonce(spark, sf):
    out = M.contrast_losses(_batched_vectors(spark, sf), "batch", "id", "va", "vb", temperature=0.5)
    return rounded(out.select("batch", "n", "infonce"))
