"""Joins with a dictionary: broadcast up to a checked size, in lanes beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parts_for, written

#: a dictionary of at most this many rows is broadcast
BROADCAST_ROWS = 10_000
LANES = 16


def lookup(df: DataFrame, dictionary: DataFrame, on: str, how: str = "inner", max_rows: int = BROADCAST_ROWS,
           rows: int | None = None) -> DataFrame:
    """``df`` joined with the rows of ``dictionary`` that have its value of
    ``on``. The dictionary is written and counted once. A small one is
    broadcast, so a frequent value is never a shuffle key; of a larger one every
    entry goes to ``LANES`` lanes over which the rows of ``df`` are dealt, so a
    frequent value spreads over as many tasks, in parts by the number of rows
    (``rows``: that of ``df`` if known, else it is counted)."""
    entries = written(dictionary, "dictionary")
    n = entries.count()
    if n <= max_rows:
        return df.join(F.broadcast(entries), on, how)
    lane = F.pmod(F.xxhash64(*df.columns), F.lit(LANES))
    lanes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint")))
    parts = parts_for(df.sparkSession, max(df.count() if rows is None else rows, n * LANES))
    left, right = (x.withColumn("_lane", v).repartition(parts, on, "_lane") for x, v in ((df, lane), (entries, lanes)))
    return left.join(right.hint("merge"), [on, "_lane"], how).drop("_lane")
