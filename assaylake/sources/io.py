"""File sources and sinks (S1-S9, S11): CSV/TSV/text scans with explicit
schemas, partitioned snapshots and result appends. Paths are given by the
caller; for derived test inputs they live in the shared checkpoint folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True,
             drop_first: bool = False) -> DataFrame:
    df = spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)
    return df.drop(df.columns[0]) if drop_first else df


def with_constant_label(df: DataFrame, name: str = "label", value: float = 0.0) -> DataFrame:
    return df.withColumn(name, F.lit(float(value)))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def materialize_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if it was written to its end, else compute, write and
    read it back; an unfinished folder is written again."""
    if not _exists(spark, path.rstrip("/") + "/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scan_triples(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Whitespace-separated ``head relation tail`` lines; ``file`` is the
    base name of the source file. Missing fields of a short line are null."""
    t = spark.read.text(list(paths)).withColumn("_f", F.input_file_name())
    parts = F.split(F.trim("value"), r"\s+")
    return t.where(F.trim("value") != "").select(
        *[F.get(parts, i).alias(c) for i, c in enumerate(("head", "relation", "tail"))],
        F.regexp_extract("_f", r"([^/]+?)(\.[^./]*)?$", 1).alias("file"))


def scan_delimited_text(spark: SparkSession, paths: Sequence[str], sep: str = "|") -> DataFrame:
    """``text|label`` lines: strip, '/' -> ' ', split on the separator, keep
    field 0 as text and field 1 as INT label (null if missing or no number)."""
    t = spark.read.text(list(paths))
    line = F.regexp_replace(F.trim("value"), "/", " ")
    parts = F.split(line, "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)
    return t.select(F.get(parts, 0).alias("text"), F.get(parts, 1).try_cast("int").alias("label"))


def snapshot(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, by: str | None = None, value: str | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.where(F.col(by) == value) if by else d  # partition pruning on ``by``


def chunked_store(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Data stored in one folder per fold chunk; readers load the chunks
    that exist. A fold is written by several tasks: rows are dealt out by fold
    and a hash of the row."""
    df.repartition(F.col(fold), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(fold).parquet(path)


def write_submission(df: DataFrame, path: str, id_col: str = "ID", value_col: str = "IC50_nM") -> None:
    df.select(id_col, value_col).write.mode("overwrite").option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (one record per metric / parameter set)."""
    df.write.mode("append").json(path)


def join_path(base: str, *parts: str) -> str:
    return os.path.join(base, *parts)
