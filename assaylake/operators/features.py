"""Row filters, column selection, scaling and feature selection
(F1-F9, Z1-Z5).

Statistics are always fitted on the train rows only, in one aggregate pass
over all features, and applied to every split by a join on the feature key
(long form) or a one-row broadcast (wide form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_active(df: DataFrame, col: str = "Activity_Flag", flag: str = "A") -> DataFrame:
    return df.where(F.col(col) == flag)


def drop_invalid(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose derived column is not null (policy 1 of T1)."""
    return df.where(F.col(col).isNotNull())


def count_invalid(df: DataFrame, col: str) -> DataFrame:
    """Kept / dropped counts in one pass."""
    return df.agg(F.count_if(F.col(col).isNotNull()).alias("kept"),
                  F.count_if(F.col(col).isNull()).alias("dropped"))


def invalid_to_zero(df: DataFrame, col: str) -> DataFrame:
    """Replace a null bit list by the empty list = all-zero vector (policy 2)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.array().cast("array<int>")))


def drop_self_loops(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col(src) != F.col(dst))


def mask_missing(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label)))


def select_target(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys, F.col(name).alias("y"))


# ---- wide form --------------------------------------------------------------

def fit_column_means(train: DataFrame, cols: Sequence[str]) -> dict:
    """One aggregate pass; returns one number per column (bounded)."""
    row = train.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return row.asDict()


def drop_zero_mean(train: DataFrame, keys: Sequence[str], cols: Sequence[str], *others: DataFrame):
    means = fit_column_means(train, cols)
    kept = [c for c in cols if means[c] is not None and means[c] != 0]
    return [d.select(*keys, *kept) for d in (train, *others)]


def drop_null_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    return df.select(*keys, *[c for c in cols if row[c] == 0])


def align_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select ``cols`` in order; a missing column is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*cols)


# ---- long form (feature, value) ---------------------------------------------

def zero_mean_features(train_long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return train_long.groupBy(feature).agg(F.avg(value).alias("_m")).where(
        F.col("_m").isNotNull() & (F.col("_m") != 0)).select(feature)


def keep_features(df_long: DataFrame, kept: DataFrame, feature: str = "feature") -> DataFrame:
    """Semi join on the kept-feature table: one row per column of the wide
    table, so its broadcast is bounded by the schema, not by the rows."""
    return df_long.join(F.broadcast(kept), feature, "left_semi")


def nonnull_features(df_long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return df_long.groupBy(feature).agg(F.count_if(F.col(value).isNull()).alias("_n")).where(
        "_n = 0").select(feature)


def fit_zscore(train_long: DataFrame, by: Sequence[str] = ("feature",), value: str = "value",
               ddof: int = 0) -> DataFrame:
    std = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return train_long.groupBy(*by).agg(F.avg(value).alias("mu"), std.alias("sigma"))


def apply_zscore(df_long: DataFrame, stats: DataFrame, by: Sequence[str] = ("feature",),
                 value: str = "value", out: str = "z") -> DataFrame:
    """(x - mu) / sigma; sigma 0 -> scale 1 (as the usual scaler does).
    ``stats`` has one row per feature: a broadcast bounded by the schema."""
    j = df_long.join(F.broadcast(stats), list(by)) if by else df_long.crossJoin(F.broadcast(stats))
    sig = F.when(F.col("sigma") == 0, F.lit(1.0)).otherwise(F.col("sigma"))
    return j.withColumn(out, (F.col(value) - F.col("mu")) / sig).drop("mu", "sigma")


def invert_zscore(df_long: DataFrame, stats: DataFrame, by: Sequence[str] = ("feature",),
                  z: str = "z", out: str = "value") -> DataFrame:
    j = df_long.join(F.broadcast(stats), list(by)) if by else df_long.crossJoin(F.broadcast(stats))
    sig = F.when(F.col("sigma") == 0, F.lit(1.0)).otherwise(F.col("sigma"))
    return j.withColumn(out, F.col(z) * sig + F.col("mu")).drop("mu", "sigma")


def variance_select(train_long: DataFrame, threshold: float = 0.05, feature: str = "feature",
                    value: str = "value") -> DataFrame:
    """Features with population variance > threshold on train."""
    return train_long.groupBy(feature).agg(F.var_pop(value).alias("_v")).where(
        F.col("_v") > threshold).select(feature)


def bit_variance_select(bits: DataFrame, n_rows: Column | int, threshold: float = 0.05,
                        bit: str = "bit") -> DataFrame:
    """Sparse on-bit table (row, bit): variance of a 0/1 column is p(1-p)
    with p = ones / rows; bits never set have variance 0 and are skipped."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    g = bits.groupBy(bit).agg(F.count(F.lit(1)).alias("_ones"))
    p = F.col("_ones") / n
    return g.where(p * (F.lit(1.0) - p) > threshold).select(bit)
