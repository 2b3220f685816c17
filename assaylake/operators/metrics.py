"""Metrics and losses as distributed aggregates.

Every metric is a ``groupBy(by).agg(...)``: partial aggregation runs map-side
and only one small row per group is shuffled. Metrics that need a first-pass
statistic (berHu's batch maximum, AUROC's cumulative negatives) use a second
aggregate joined back on the group key – never a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import to_ic50
from ..functions.vectors import logsumexp
from .ranking import placed, sequence_shift


def _join_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        # exactly one row: broadcast is size-bounded by construction
        return df.crossJoin(F.broadcast(stats))
    return df.join(stats, list(by))


def _err(label: str, pred: str) -> Column:
    return F.col(pred) - F.col(label)


def regression_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "target",
                       pred: str = "pred", label_std: float = 1.0) -> DataFrame:
    """mse, rmse, rmse on the IC50 scale, mae and mae scaled by the label std."""
    e = _err(label, pred)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.avg(F.pow(to_ic50(pred) - to_ic50(label), 2))).alias("rmse_ic50"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e)) * F.lit(label_std)).alias("mae_std"),
    )


def competition_score(df: DataFrame, by: Sequence[str] = (), label: str = "target",
                      pred: str = "pred", scale: str = "ic50", tol: float = 0.5) -> DataFrame:
    """A = mean(|e|) / (max pred - min pred) on the pIC50 scale,
    B = share of rows with abs error <= tol (on the IC50 scale in nM, or on the
    pIC50 scale), score = 0.5 * (1 - min(A, 1)) + 0.5 * B. One pass."""
    e = F.abs(_err(label, pred))
    if scale == "ic50":
        eb = F.abs(to_ic50(pred) - to_ic50(label))
    elif scale == "pic50":
        eb = e
    else:
        raise ValueError(scale)
    # equal predictions have no range: A is null there, and counts as 1 in the score
    a = F.try_divide(F.avg(e), F.max(pred) - F.min(pred))
    b = F.avg((eb <= tol).cast("double"))
    return df.groupBy(*by).agg(a.alias("a"), b.alias("b")).withColumn(
        "score", F.lit(0.5) * (F.lit(1.0) - F.least(F.coalesce(F.col("a"), F.lit(1.0)), F.lit(1.0))) + F.lit(0.5) * F.col("b"))


def pointwise_losses(df: DataFrame, by: Sequence[str] = (), label: str = "target", pred: str = "pred",
                     delta: float = 0.5, eps: float = 0.5, threshold: float = 0.5,
                     penalty_weight: float = 0.1) -> DataFrame:
    """huber variant (no 1/2), dead-zone MSE, MSLE, threshold penalty."""
    e = _err(label, pred)
    ae = F.abs(e)
    huber = F.when(ae <= delta, ae * ae).otherwise(F.lit(delta) * (ae - F.lit(0.5 * delta)))
    dead = F.when(ae < eps, F.lit(0.0)).otherwise(e * e)
    lp = F.log1p(F.greatest(F.col(pred), F.lit(0.0)))
    lt = F.log1p(F.greatest(F.col(label), F.lit(0.0)))
    over = F.greatest(F.col(pred) - F.lit(threshold), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(huber).alias("huber"),
        F.avg(dead).alias("mse_deadzone"),
        F.avg(F.pow(lp - lt, 2)).alias("msle"),
        (F.avg(e * e) + F.lit(penalty_weight) * F.sum(over)).alias("threshold_penalty"),
    )


def berhu(df: DataFrame, by: Sequence[str] = (), label: str = "target", pred: str = "pred",
          frac: float = 0.2) -> DataFrame:
    """c = frac * max|e| of the group; |e| if |e| <= c else (e^2 + c^2) / (2c)."""
    ae = F.abs(_err(label, pred))
    d = df.select(*by, ae.alias("_ae"))
    c = d.groupBy(*by).agg((F.lit(frac) * F.max("_ae")).alias("_c"))
    j = _join_stats(d, c, by)
    v = F.when(F.col("_ae") <= F.col("_c"), F.col("_ae")).otherwise(
        (F.col("_ae") * F.col("_ae") + F.col("_c") * F.col("_c")) / (F.lit(2.0) * F.col("_c")))
    return j.groupBy(*by).agg(F.avg(v).alias("berhu"))


def bce_logits(df: DataFrame, by: Sequence[str] = (), logit: str = "logit", label: str = "label") -> DataFrame:
    """Mean binary cross entropy with logits; rows with null/NaN labels skipped."""
    x, y = F.col(logit), F.col(label)
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    valid = y.isNotNull() & ~F.isnan(y)
    return df.where(valid).groupBy(*by).agg(F.avg(loss).alias("bce"), F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), logits: str = "logits",
                           label: str = "label", gamma: float = 2.0,
                           alpha: Sequence[float] | None = None) -> DataFrame:
    """accuracy (first argmax = label), cross entropy, focal loss
    ((1-p)^gamma * alpha_y * CE with p = exp(-CE) from the unweighted CE)."""
    arr, y = F.col(logits), F.col(label)
    ce = logsumexp(arr) - F.element_at(arr, (y + 1).cast("int"))
    am = F.array_position(arr, F.array_max(arr)) - 1
    a = F.lit(1.0) if alpha is None else F.element_at(F.array(*[F.lit(float(v)) for v in alpha]),
                                                      (y + 1).cast("int"))
    focal = F.pow(F.lit(1.0) - F.exp(-ce), F.lit(gamma)) * a * ce
    return df.groupBy(*by).agg(
        F.avg((am == y).cast("double")).alias("accuracy"),
        F.avg(ce).alias("cross_entropy"),
        F.avg(focal).alias("focal_mean"),
        F.sum(focal).alias("focal_sum"),
    )


def focal_loss(df: DataFrame, logits: str = "logits", label: str = "label", gamma: float = 2.0,
               alpha: Sequence[float] | None = None, reduction: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """(1-p)^gamma * alpha_y * CE with p = exp(-CE) from the unweighted CE, as
    ``focal``: the mean or the sum per ``by``, or every row's own value with
    ``none`` (the rows' columns stay). A null label has a null loss, which the
    mean and the sum leave out."""
    ce = logsumexp(F.col(logits)) - F.element_at(logits, (F.col(label) + 1).cast("int"))
    a = F.lit(1.0) if alpha is None else F.element_at(F.array(*[F.lit(float(v)) for v in alpha]), (F.col(label) + 1).cast("int"))
    d = df.withColumn("focal", F.pow(F.lit(1.0) - F.exp(-ce), F.lit(gamma)) * a * ce)
    if reduction == "none":
        return d
    return d.groupBy(*by).agg({"mean": F.avg, "sum": F.sum}[reduction]("focal").alias("focal"))


def auroc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Binary AUROC with ties counted half (Mann-Whitney).

    Rows are first pre-aggregated per distinct score (so a hot score value is
    one row), then the cumulative negative count below each score is a
    running sum in score order."""
    per = df.where(F.col(label).isNotNull()).groupBy(F.col(score).alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("_pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("_neg"))
    cum = placed(per, ["_s"], sums={"_neg_below": F.col("_neg")}, exclusive=True)
    return cum.agg(
        # doubles: the product of the class sizes passes LONG at some 3e9 rows a class; one class only: null
        F.try_divide(F.sum(F.col("_pos").cast("double") * (F.col("_neg_below") + F.lit(0.5) * F.col("_neg"))),
                     F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("auroc"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def rank_losses(df: DataFrame, group: str = "grp", pos: str = "pos", score: str = "score",
                margin: float = 15.0) -> DataFrame:
    """Losses over groups of one positive (``pos`` = 0) and k negatives:
    neg_log (-log s(pos) - mean log(1 - s(neg)), averaged over groups),
    first_pos_bce (BCE with logits, target 1 at position 0, mean over all),
    margin_rank (sum over negatives of relu(margin - (pos - neg)))."""
    s = F.col(score)
    is_pos = F.col(pos) == 0
    # -log sigmoid(x) = max(-x, 0) + log1p(exp(-|x|)): finite where the sigmoid saturates
    soft = F.log1p(F.exp(-F.abs(s)))
    y = is_pos.cast("double")
    bce = F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))
    g = df.groupBy(group).agg(
        F.max(F.when(is_pos, s)).alias("_pos_s"),
        F.max(F.when(is_pos, F.greatest(-s, F.lit(0.0)) + soft)).alias("_pos_term"),
        F.avg(F.when(~is_pos, F.greatest(s, F.lit(0.0)) + soft)).alias("_neg_term"),
        F.sum(bce).alias("_bce_sum"), F.count(F.lit(1)).alias("_n"),
    )
    neg = df.where(~is_pos).select(group, s.alias("_neg_s"))
    mr = neg.join(g.select(group, "_pos_s"), group).groupBy(group).agg(
        F.sum(F.greatest(F.lit(margin) - (F.col("_pos_s") - F.col("_neg_s")), F.lit(0.0))).alias("_mr"))
    j = g.join(mr, group, "left")
    return j.agg(
        F.avg(F.col("_pos_term") + F.col("_neg_term")).alias("neg_log"),
        (F.sum("_bce_sum") / F.sum("_n")).alias("first_pos_bce"),
        F.sum(F.coalesce(F.col("_mr"), F.lit(0.0))).alias("margin_rank"),
    )


def mean_of_batch_means(df: DataFrame, batch: str = "batch", label: str = "target",
                        pred: str = "pred") -> DataFrame:
    """Mean over batches of the per-batch MSE, next to the row-level MSE."""
    e = _err(label, pred)
    per = df.groupBy(batch).agg(F.avg(e * e).alias("_m"), F.sum(e * e).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per.agg(F.avg("_m").alias("epoch_mean"), (F.sum("_s") / F.sum("_n")).alias("row_mean"),
                   F.count(F.lit(1)).alias("n_batches"))


def td_error(df: DataFrame, key: str, order: str, tie: Sequence[str], q: str, reward: str, state: str,
             actions: DataFrame, gamma: float = 0.99) -> DataFrame:
    """Per entity sequence: target = reward + gamma * the largest value of the
    next state's actions (0 at the end, and for a state without actions);
    td_error = mean squared (q - target). ``actions`` (state, action, q) holds
    the values of all actions of a state. The maximum is taken per state, then
    joined to the row before by its place in the sequence (skew-safe lead).
    Rows with a null ``key`` are one sequence."""
    best = actions.groupBy(F.col(state)).agg(F.max("q").alias("_best"))
    d = df.join(best, state, "left")
    d = sequence_shift(d, key, order, tie, ["_best"], offset=1, suffix="_next")
    d = d.withColumn("_target", F.col(reward) + F.lit(gamma) * F.coalesce(F.col("_best_next"), F.lit(0.0)))
    return d.agg(F.avg(F.pow(F.col(q) - F.col("_target"), 2)).alias("td_error"),
                 F.avg("_target").alias("mean_target"))


def results_summary(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric: mean and population std of the collected values."""
    return df.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                  F.count(F.lit(1)).alias("n"))


def best_by_metric(results: DataFrame, params: Sequence[str], split: str = "split",
                   value: str = "value", mode: str = "min") -> DataFrame:
    """Grid results (params, split, value per repeat) -> mean/std per params and
    split; keep the parameter set with the best valid mean (ties: smallest
    params)."""
    stats = results.groupBy(*params).pivot(split, ["valid", "test"]).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    key = F.col("valid_mean") if mode == "min" else -F.col("valid_mean")
    # one row per parameter set (a bounded grid): rank within the grid
    w = Window.orderBy(key, *[F.col(p) for p in params])
    return stats.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contrast_losses(df: DataFrame, batch: str, key: str, a: str, b: str,
                    temperature: float = 0.5) -> DataFrame:
    """Per mini-batch contrastive losses between two views (arrays ``a``,
    ``b``): two-view contrast -mean log(exp(s_ii) / sum_j exp(s_ij)) with
    s = a_i . b_j / temperature, and InfoNCE on M = a_i . b_j with the
    denominator over the off-diagonal entries only.

    Batches have a fixed size (hash-rank batches), so each group is bounded;
    the B x B similarity block is computed in numpy inside the task and no
    pair rows are emitted."""
    import numpy as np
    import pandas as pd

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        A = np.stack(pdf[a].to_numpy()).astype(float)
        B = np.stack(pdf[b].to_numpy()).astype(float)
        M = A @ B.T
        n = len(pdf)
        S = M / temperature
        mx = S.max(axis=1, keepdims=True)
        lse = (mx[:, 0] + np.log(np.exp(S - mx).sum(axis=1)))
        contrast = float(np.mean(lse - np.diag(S)))
        if n > 1:
            off = M.copy()
            np.fill_diagonal(off, -np.inf)
            mo = off.max(axis=1, keepdims=True)
            lse_off = mo[:, 0] + np.log(np.exp(off - mo).sum(axis=1))
            infonce = float(np.mean(lse_off - np.diag(M)))
        else:
            infonce = float("nan")
        return pd.DataFrame({batch: [int(pdf[batch].iloc[0])], "n": [n], "contrast": [contrast],
                             "infonce": [infonce]})

    return df.select(batch, key, a, b).groupBy(batch).applyInPandas(
        per_batch, schema=f"{batch} long, n long, contrast double, infonce double")
