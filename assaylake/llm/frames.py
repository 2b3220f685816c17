"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import scratch_path

#: for :func:`written` with ``small_batches``: rows, and bytes, of a batch between Spark and Python
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def written(df: DataFrame, name: str, codec: str = "zstd", small_batches: bool = False) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it again: a cut
    in the lineage that survives lost executors and keeps column pruning.

    ``small_batches``: rows go to Python and back ``BATCH`` at a time, so a task
    holds few of them at once on either side (for functions that do not depend
    on where batches end)."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    # nothing reads this job's shuffle files once the table is written
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (BATCH if small_batches else {})
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """At a task's end: return what it freed to the machine, since the Python
    worker stays for the tasks after it (a hint; does nothing where the C library
    has no such call)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, with :func:`give_back` once its own variables are gone."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return whole


def map_text(df: DataFrame, text: str, fn: Callable[[str], str]) -> DataFrame:
    """``df`` with ``fn`` applied to the strings of one column (nulls stay)."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if (s := t.as_py()) is None else fn(s) for t in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)
    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32(doc_id as text) mod ``parts`` = ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
