"""Splits, folds, sampling and batching.

Seeded RNG permutations cannot be reproduced across engines, so membership is
decided by an md5 hash order (same sizes as the reference, different
members). Exact sizes need a global rank; :func:`ranking.placed` writes the
rows once in that order and hands back rank and count together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash32, uniform
from .ranking import placed
from .selection import latest


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank`` (1-based, in hash order of ``key``) and the row
    count ``_n``, per value of ``by``."""
    d = df.withColumn("_h", hash32(key, seed=seed))
    return placed(d, ["_h", key], by=by, rank="rank", count="_n").drop("_h")


def random_split(df: DataFrame, key: str, test_frac: float, seed: int = 0) -> DataFrame:
    """Two-way split; test size = ceil(test_frac * n)."""
    d = hash_rank(df, key, seed)
    test = F.col("rank") <= F.ceil(F.col("_n") * F.lit(test_frac))
    return d.withColumn("split", F.when(test, "test").otherwise("train")).drop("rank", "_n")


def nested_split(df: DataFrame, key: str, test_frac: float = 0.1, valid_frac: float = 0.05,
                 seed: int = 0) -> DataFrame:
    """test = ceil(f1 * n) rows, then valid = ceil(f2 * rest) of the rest."""
    d = hash_rank(df, key, seed)
    n_test = F.ceil(F.col("_n") * F.lit(test_frac))
    n_valid = F.ceil((F.col("_n") - n_test) * F.lit(valid_frac))
    split = (F.when(F.col("rank") <= n_test, "test")
             .when(F.col("rank") <= n_test + n_valid, "valid").otherwise("train"))
    return d.withColumn("split", split).drop("rank", "_n")


def sequential_split(df: DataFrame, order: str, valid_frac: float, tie: Sequence[str] = ()) -> DataFrame:
    """First int((1 - v) * n) rows in ``order`` are train, the rest valid."""
    d = placed(df, list(dict.fromkeys([order, *tie])), rank="rank", count="_n")
    cut = F.floor(F.col("_n") * F.lit(1.0 - valid_frac))
    return d.withColumn("split", F.when(F.col("rank") <= cut, "train").otherwise("valid")).drop("rank", "_n")


def shuffle_cut(df: DataFrame, key: str, ratio: float, seed: int = 0, test: bool = False) -> DataFrame:
    """Shuffle, index < int(n * ratio) -> train; test mode puts all rows in train."""
    if test:
        return df.withColumn("split", F.lit("train"))
    d = hash_rank(df, key, seed)
    cut = F.floor(F.col("_n") * F.lit(ratio))
    return d.withColumn("split", F.when(F.col("rank") <= cut, "train").otherwise("valid")).drop("rank", "_n")


def kfold(df: DataFrame, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Shuffled K folds as contiguous blocks of the hash order; the first
    n mod k folds get one extra row."""
    d = hash_rank(df, key, seed)
    i = F.col("rank") - 1
    q = F.floor(F.col("_n") / F.lit(k))
    rem = F.pmod(F.col("_n"), F.lit(k))
    big = rem * (q + 1)
    fold = F.when(i < big, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - big) / q))
    return d.withColumn(name, fold.cast("bigint")).drop("rank", "_n")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Folds balanced per int-cast label: rank within the label by hash,
    fold = (rank - 1) mod k. A hot label is still split by hash bucket."""
    d = df.withColumn("_lab", F.col(label).cast("bigint"))
    d = hash_rank(d, key, seed, by=["_lab"])
    return d.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k))).drop("rank", "_n", "_lab")


def rotating_folds(df_with_fold: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """For split i: test = fold i, valid = fold (i+1) mod k, train = rest."""
    d = df_with_fold.withColumn("split_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    role = (F.when(F.col(fold) == F.col("split_id"), "test")
            .when(F.col(fold) == F.pmod(F.col("split_id") + 1, F.lit(k)), "valid").otherwise("train"))
    return d.withColumn("role", role)


def half_split(df: DataFrame, key: str, split: str = "split", seed: int = 0) -> DataFrame:
    """Keep int(n_train / 2) hash-chosen train rows; other splits unchanged."""
    half = F.col("rank") <= F.floor(F.col("_n") / 2)
    return hash_rank(df, key, seed, by=[split]).where((F.col(split) != "train") | half & (F.col(split) == "train")).drop("rank", "_n")


def bernoulli(df: DataFrame, group: str, key: str, p, seed: int = 0) -> DataFrame:
    """Keep each element with probability p (a number or a per-row Column);
    returns kept rows with a ``kept`` flag plus the per-group kept counts
    (zero-count groups included) via :func:`bernoulli_counts`."""
    prob = F.lit(float(p)) if isinstance(p, (int, float)) else p
    return df.withColumn("kept", uniform(group, key, seed=seed) < prob)


def bernoulli_counts(flagged: DataFrame, group: str) -> DataFrame:
    return flagged.groupBy(group).agg(F.count_if("kept").alias("count"))


def draw_per_group(df: DataFrame, group: str, key: str, c: int, seed: int = 0) -> DataFrame:
    """c draws with replacement per non-empty group: draw j picks the row of
    in-group rank pmod(hash(group, j), m) + 1. Rows with a null group are a
    group of their own."""
    ranked = hash_rank(df, key, seed, by=[group])
    # the first row of each group stands for the group and carries its size
    draws = ranked.where("rank = 1").select(F.col(group).alias("_g"), F.col("_n").alias("_m"),
                                            F.explode(F.sequence(F.lit(1), F.lit(c))).alias("draw"))
    draws = draws.withColumn("_pick", F.pmod(hash32("_g", "draw", seed=seed + 1), F.col("_m")) + 1)
    return (draws.join(ranked, F.col("_g").eqNullSafe(F.col(group)) & (F.col("_pick") == F.col("rank")))
            .drop("_g", "_m", "_pick", "rank", "_n"))


def bootstrap(spark: SparkSession, df: DataFrame, key: str, n: int, seed: int = 0, least: int = 1) -> DataFrame:
    """Exactly n rows drawn with replacement (draw d -> global rank
    pmod(hash(d), N) + 1); none if df has fewer than ``least`` rows."""
    ranked = hash_rank(df, key, seed)
    total = ranked.agg(F.max("_n").alias("_N")).where(F.col("_N") >= least)  # one row
    draws = spark.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total))
    draws = draws.withColumn("rank", F.pmod(hash32("draw", seed=seed + 1), F.col("_N")) + 1)
    return draws.join(ranked, "rank").drop("_N", "rank", "_n")


def bounded_buffer(df: DataFrame, order: str, tie: str, capacity: int) -> DataFrame:
    """Keep the latest ``capacity`` records by the LONGs (order, tie)."""
    return latest(df, order, tie, capacity)


def buffer_sample(spark: SparkSession, buffer: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` draws with replacement from a buffer, numbered from 0; none at
    all while the buffer holds fewer than ``size`` rows."""
    return bootstrap(spark, buffer, key, size, seed=seed, least=size)


def batches(df: DataFrame, key: str, b: int, drop_last: bool = True, seed: int = 0) -> DataFrame:
    """Batch id = (hash rank - 1) div b; the last partial batch is dropped in
    training (num_batches = int(n / b)) and kept in evaluation."""
    d = hash_rank(df, key, seed)
    d = d.withColumn("batch", F.floor((F.col("rank") - 1) / F.lit(b)).cast("bigint"))
    if drop_last:
        d = d.where(F.col("batch") < F.floor(F.col("_n") / F.lit(b)))
    return d.drop("rank", "_n")
