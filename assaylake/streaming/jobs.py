"""Structured Streaming jobs (T-S1, T-S2).

* ``stream_bounded_buffer`` keeps the latest ``capacity`` records per key with
  ``applyInPandasWithState``; the state per key is bounded by ``capacity``.
* ``stream_metric`` is a watermarked tumbling-window aggregate in append mode:
  a window is emitted once the watermark passes its end; rows later than the
  watermark are dropped by Spark.

Both write through ``foreachBatch`` / the file sink into a folder the caller
names (the shared checkpoint folder on a cluster) and keep their streaming
checkpoint there, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ntz_epoch_micros
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUFFER_SCHEMA = "user_id LONG, event_id LONG, ts_us LONG, value DOUBLE"


def _keep_latest(capacity: int):
    cols = ["event_id", "ts_us", "value"]
    types = {"event_id": "int64", "ts_us": "int64", "value": "float64"}

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            (old,) = state.get
            cur = pd.DataFrame([list(x) for x in old], columns=cols).astype(types)
        else:
            cur = pd.DataFrame({c: pd.Series(dtype=t) for c, t in types.items()})
        # the group arrives in Arrow chunks: merge chunk by chunk and keep only
        # the latest ``capacity`` rows, so memory stays bounded for a hot key
        for chunk in pdfs:
            chunk = chunk[cols].astype(types)
            cur = pd.concat([cur, chunk], ignore_index=True) if len(cur) else chunk
            cur = cur.sort_values(["ts_us", "event_id"]).tail(capacity)
        state.update(([(int(a), int(b), float(c)) for a, b, c in cur.itertuples(index=False)],))
        yield cur.assign(user_id=key[0])[["user_id", "event_id", "ts_us", "value"]]
    return fn


def stream_bounded_buffer(stream: DataFrame, capacity: int) -> DataFrame:
    """Per ``user_id`` the latest ``capacity`` records by (ts, event_id);
    each trigger emits the current buffer of the keys it touched."""
    s = stream.select("user_id", "event_id", ntz_epoch_micros("ts").alias("ts_us"), "value")
    return s.groupBy("user_id").applyInPandasWithState(
        _keep_latest(capacity), outputStructType=BUFFER_SCHEMA,
        stateStructType="buf ARRAY<STRUCT<event_id:LONG,ts_us:LONG,value:DOUBLE>>", outputMode="update",
        timeoutConf=GroupStateTimeout.NoTimeout)


def stream_metric(stream: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    # event time from the wall clock as UTC (independent of the session zone)
    s = stream.withColumn("ts", F.timestamp_micros(ntz_epoch_micros("ts"))).withWatermark("ts", watermark)
    return s.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def replace_batch(out: str):
    """A ``foreachBatch`` sink that writes every micro-batch to its own part of
    ``out``, over whatever is there: a batch that is played again after a
    failure replaces its first writing."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return sink


def latest_batches(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The rows of each key from the last batch that has it (null is a key)."""
    emitted = spark.read.parquet(out)
    last = emitted.groupBy(F.col(key).alias("_key")).agg(F.max("batch_id").alias("_last"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch_id") == F.col("_last"))
    return emitted.join(last, same).drop("_key", "_last")


def events_stream(spark: SparkSession, src_dir: str) -> DataFrame:
    schema = spark.read.parquet(src_dir).schema
    return spark.readStream.schema(schema).parquet(src_dir)


def run_available(q_writer, checkpoint: str):
    """Start with the availableNow trigger and wait for completion."""
    q = q_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
