"""Registered streaming queries (T-S1, T-S2): the ``events`` table is copied
by Spark into a stream source folder, processed by a Structured Streaming
query (availableNow) and the sink output is returned as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import tables as S
from ..streaming import jobs as J
from .registry import query


def _source(spark, sf):
    src = scratch_path(spark, "events_src")
    S.table(spark, sf, "events").write.parquet(src)
    return src


@query("stream_bounded_buffer", """
SELECT user_id, event_id, round(value, 6) AS value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
  FROM events) t WHERE k <= 3""")
def q_stream_bounded_buffer(spark, sf):
    src = _source(spark, sf)
    out = scratch_path(spark, "buffer_out")
    stream = J.stream_bounded_buffer(J.events_stream(spark, src), capacity=3)
    J.run_available(stream.writeStream.outputMode("update").foreachBatch(J.replace_batch(out)), scratch_path(spark, "buffer_ckpt"))
    # the buffer of a key is its rows from the last batch that touched it
    return J.latest_batches(spark, out, "user_id").select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("stream_metric_epoch", """
SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_metric(spark, sf):
    src = _source(spark, sf)
    out = scratch_path(spark, "metric_out")
    agg = J.stream_metric(J.events_stream(spark, src), "1 day", "1 hour")
    J.run_available(agg.writeStream.outputMode("append").format("parquet").option("path", out),
                    scratch_path(spark, "metric_ckpt"))
    res = spark.read.parquet(out)
    return res.select(F.unix_seconds("window.start").alias("window_start"), "n",
                      F.round("mean_value", 6).alias("mean_value"))
