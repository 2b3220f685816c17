"""Session helpers: building a local session for tests/bench and finding the
shared scratch folder (``spark.checkpoint.dir``) for checkpoints and written
intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "assaylake") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is
    used instead and none of these settings are forced."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Order: the context's checkpoint dir, then ``spark.checkpoint.dir`` from the
    session conf. Only when neither is set (local tests) a fresh folder under
    the system temp dir is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="assaylake-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, grows: bool = False) -> DataFrame:
    """``df`` written once into the shared folder and read again: later scans
    read only the columns they need, and a lost executor costs no recomputation.

    ``grows``: a table that grows with the input is shuffled in joins. Spark
    estimates it, and what is exploded from it, by its files, which for
    repetitive rows are a hundred times smaller than the rows; it would send
    them whole through the driver as a broadcast."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if grows else out


#: rows that one task sorts or groups
TASK_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of about ``TASK_ROWS`` rows, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def by_rows(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of about ``TASK_ROWS`` rows.
    Coalesced shuffle parts are sized by their compressed bytes, so of
    repetitive rows one task would get many times its share of memory.
    ``rows``: their number if known, else they are counted."""
    return df.repartition(parts_for(df.sparkSession, df.count() if rows is None else rows), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a small input by ``key`` across the cluster's default
    parallelism before CPU-heavy row-local work (structure parsing,
    fingerprints). Inputs that already have enough partitions (any large
    table) are left alone, so no shuffle is added at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)
