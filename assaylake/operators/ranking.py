"""Global order without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task, and a
window per key moves a hot key into one. :func:`placed` gives ranks, counts and
running sums of any order instead:

1. the rows are range-partitioned and sorted by (keys, order) and written once
   with their part number and their place in the part; equal leading values are
   split by the columns after them, so one value (or one key) that holds a large
   share of the rows still spreads over many parts;
2. totals per part, or per (part, key): at most parts + keys rows;
3. each row adds its part's offset to its place.

No cut points are sampled by a query of their own and nothing is counted twice:
the count comes back with the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: monotonically_increasing_id holds the partition above this many bits
_PART_BITS = 33


def ordered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in the order of ``order`` (nulls first), written once, with
    ``_part`` (number of the range) and ``_at`` (place in it, from 0).

    Rows that agree in all of ``order`` lie in one part: pass enough ties."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    d = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    return written(d.select(*df.columns, F.shiftright("_id", _PART_BITS).cast("int").alias("_part"),
                            F.col("_id").bitwiseAND((1 << _PART_BITS) - 1).alias("_at")), "ordered")


def placed(df: DataFrame, order: Sequence[str], *, by: Sequence[str] = (), rank: str | None = None,
           count: str | None = None, sums: dict[str, Column] | None = None, exclusive: bool = False) -> DataFrame:
    """``df`` with, restarted for each value of ``by`` (null is a value):

    * ``rank``: the 1-based place in ``order``, which must be a total order
      within ``by`` for a defined result;
    * ``count``: the number of rows;
    * ``sums``: running sums by name, of a row and all before it (``exclusive``:
      of those before it).
    """
    keys, sums = list(by), sums or {}
    t = ordered(df.withColumns({f"_v_{s}": v for s, v in sums.items()}), [*keys, *order])
    spans = t.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"),
                                          *[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
    # without keys these windows see one row a part, with keys the parts of one key
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(group).alias("_total"),
                         *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    out = t.join(spans if keys else F.broadcast(spans), same)
    cols = {}
    if rank:
        cols[rank] = (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("bigint")
    if count:
        cols[count] = F.col("_total").cast("bigint")
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    for s in sums:
        cols[s] = F.coalesce(F.sum(f"_v_{s}").over(inside), F.lit(0)) + F.col(f"_o_{s}")
    return out.select(*[c for c in df.columns if c not in cols], *[v.alias(k) for k, v in cols.items()])


def sequence_shift(df: DataFrame, key: str, order: str, tie: Sequence[str], cols: Sequence[str],
                   offset: int, suffix: str = "_shift") -> DataFrame:
    """Values of ``cols`` from the row ``offset`` positions later (negative:
    earlier) in the same key sequence; null past the ends. Rows with a null key
    are one sequence. A lag/lead that joins on (key, position) - unique per row,
    so a hot key's rows spread evenly over the join partitions instead of one
    window task."""
    ranked = placed(df, [order, *tie], by=[key], rank="_seq")
    other = ranked.select(F.col(key).alias("_key"), (F.col("_seq") - offset).alias("_to"),
                          *[F.col(c).alias(c + suffix) for c in cols])
    return (ranked.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_seq") == F.col("_to")), "left")
            .drop("_key", "_to", "_seq"))
