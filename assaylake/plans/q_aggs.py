"""Registered aggregate / window queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.scalar import ntz_epoch_micros
from ..operators.selection import exact_median
from ..sources import tables as S
from .common import r, rounded
from .registry import query, with_ctes


def stat_pool(df, group, value="x", only_mean=False):
    """Mean, or mean / sample std / median / max / min over the sequence axis.
    All but the median are one map-side combined aggregate; the median is
    selected by counts (:mod:`selection`), so no task holds a group's values."""
    aggs = [F.avg(value).alias("mean")]
    if only_mean:
        return df.groupBy(*group).agg(*aggs)
    aggs += [F.stddev_samp(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min")]
    mid = exact_median(df, group, value).withColumnsRenamed({g: f"_m_{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"_m_{g}")) for g in group]
    return df.groupBy(*group).agg(*aggs).join(mid, same, "left").drop(*[f"_m_{g}" for g in group])


@query("stat_pool", with_ctes(f"""
SELECT id, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std, {r('median(x)')} AS median,
       {r('max(x)')} AS max, {r('min(x)')} AS min FROM vl GROUP BY id""", vl=S.VECTOR_LONG_SQL))
def q_stat_pool(spark, sf):
    return rounded(stat_pool(S.vector_long(spark, sf), ["id"]))


def cross_covariance(vectors, split, vec="vec", ridge=1e-5):
    """Sample covariance ``(kind, i, j, cov)`` of the views ``vec[:split]`` and
    ``vec[split:]``: the cross block, and the auto block of the first view with
    a ridge on the diagonal. The column means go to the rows as one broadcast
    row; each task sums the centred products of its rows in numpy, and one row
    per task and (i, j) is shuffled. Null vectors take no part; fewer than two
    rows give no covariance."""
    v = vectors.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v"))
    mean = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))

    def products(batches):
        total, n = 0.0, 0
        for b in batches:
            if b.num_rows:
                x = np.array(b["v"].to_pylist(), float) - np.array(b["mean"][0].as_py(), float)
                total, n = total + x[:, :split].T @ x, n + len(x)
        if n:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "s": total.ravel(), "n": np.full(len(i), n)})

    sums = v.crossJoin(F.broadcast(mean)).mapInArrow(products, "i long, j long, s double, n long")
    cov = F.sum("s") / F.nullif(F.sum("n") - 1, F.lit(0))
    d = sums.groupBy("i", "j").agg(cov.alias("cov"))
    auto = F.col("j") < split
    return d.select(F.when(auto, "auto").otherwise("cross").alias("kind"), "i",
                    F.when(auto, F.col("j")).otherwise(F.col("j") - split).alias("j"),
                    (F.col("cov") + F.when(F.col("i") == F.col("j"), F.lit(ridge)).otherwise(0.0)).alias("cov"))


@query("cross_covariance", with_ctes(f"""
SELECT 'cross' AS kind, a.dim AS i, b.dim - 32 AS j, {r('covar_samp(a.x, b.x)')} AS cov
FROM vl a JOIN vl b ON a.id = b.id WHERE a.dim < 32 AND b.dim >= 32 GROUP BY a.dim, b.dim
UNION ALL
SELECT 'auto' AS kind, a.dim AS i, b.dim AS j,
       {r('covar_samp(a.x, b.x) + CASE WHEN a.dim = b.dim THEN 0.00001 ELSE 0 END')} AS cov
FROM vl a JOIN vl b ON a.id = b.id WHERE a.dim < 32 AND b.dim < 32 GROUP BY a.dim, b.dim""", vl=S.VECTOR_LONG_SQL))
def q_cross_covariance(spark, sf):
    return rounded(cross_covariance(S.vectors(spark, sf), 32))


@query("class_count", "SELECT CAST(max(label) + 1 AS BIGINT) AS num_classes FROM embeddings")
def q_class_count(spark, sf):
    e = S.table(spark, sf, "embeddings")
    return e.agg((F.max("label") + 1).cast("bigint").alias("num_classes"))


@query("score_delta", f"""
SELECT event_id, user_id, {r('reward')} AS reward, {r('sum(reward) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS total
FROM (SELECT event_id, user_id, ts, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS reward
      FROM events) t""")
def q_score_delta(spark, sf):
    from ..operators.ranking import placed, sequence_shift
    ev = S.table(spark, sf, "events").select("event_id", "user_id", "value",
                                             ntz_epoch_micros("ts").alias("ts_us"))
    # previous score by a keyed join on the sequence position (skew-safe lag)
    d = sequence_shift(ev, "user_id", "ts_us", ["event_id"], ["value"], offset=-1, suffix="_prev")
    d = d.withColumn("reward", F.col("value") - F.coalesce(F.col("value_prev"), F.lit(0.0)))
    # running total of the deltas, restarted per user; a hot user spreads over many parts
    d = placed(d, ["ts_us", "event_id"], by=["user_id"], sums={"total": F.col("reward")})
    return rounded(d.select("event_id", "user_id", "reward", "total"))
