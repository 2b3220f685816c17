"""Selection of the n-th smallest value of a group, and draws by rank, without
sorting or collecting a group.

A group's values are narrowed 16 bits at a time: count the next digit of the
rows that still agree with the prefix found so far, pick the digit that holds
the wanted rank, go on inside it. Four rounds settle 64 bits; each round sends
at most 65,536 counts a group and wanted rank, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

_DIGIT = 16
#: a hot group's rows meet the group's state in this many lanes
_LANES = 32


def _digits(bits: Column, n: int) -> Column:
    """The leading ``n`` digits of signed 64-bit keys, in the keys' order."""
    return F.shiftright(bits, 64 - _DIGIT * n)


def nth_smallest(df: DataFrame, bits: str, wanted: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, pick, bits) with the key of 1-based rank ``wanted[pick]`` among the
    LONG column ``bits`` of each group (null is a group; null keys do not
    count), and ``left``: the rank that remains among the rows with that key.

    ``wanted`` are expressions over ``_n``, the number of keys of the group; a
    rank under 1 or above ``_n`` gives no row."""
    keys = list(by)
    # equal keys are one row from here on, so a frequent value costs nothing more
    per = (df.where(F.col(bits).isNotNull()).groupBy(*keys, F.col(bits).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_lane", F.pmod(F.xxhash64("_b"), F.lit(_LANES))))
    per = written(per, "selection")     # read once a round
    picks = F.array(*[F.struct(F.lit(k).alias("pick"), v.cast("bigint").alias("need")) for k, v in wanted.items()])
    state = (per.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*keys, F.inline(picks), "_n")
             .where("need between 1 and _n").select(*keys, "pick", "need", F.lit(0).cast("bigint").alias("_at")))
    for n in range(1, 64 // _DIGIT + 1):
        st = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "pick", "need", "_at",
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_LANES - 1).cast("bigint"))).alias("_l"))
        on = [F.col("_lane") == F.col("_l"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
        if n > 1:
            on.append(_digits(F.col("_b"), n - 1) == F.col("_at"))
        counts = (per.join(st, on).groupBy(*keys, "pick", _digits(F.col("_b"), n).alias("_d"))
                  .agg(F.sum("_c").alias("_c"), F.first("need").alias("need")))
        # at most 2^16 rows in one window
        w = Window.partitionBy(*keys, "pick").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        state = (counts.withColumn("_upto", F.sum("_c").over(w))
                 .where((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("_c") < F.col("need")))
                 .select(*keys, "pick", (F.col("need") - F.col("_upto") + F.col("_c")).alias("need"), F.col("_d").alias("_at")))
    return state.select(*keys, "pick", F.col("_at").alias("bits"), F.col("need").alias("left"))


def _flip(bits: np.ndarray) -> np.ndarray:
    """IEEE bits <-> signed keys in the order of the doubles (its own inverse)."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def with_bits(df: DataFrame, value: str, name: str = "_bits") -> DataFrame:
    """``df`` with the DOUBLE ``value`` as a LONG key of the same order. -0.0
    counts as 0.0, a null or NaN has no key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(value).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            yield b.append_column(name, pa.array(_flip(x.view(np.int64)), pa.int64(), mask=np.isnan(x)))
    df = df.withColumn(value, F.col(value).cast("double"))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def from_bits(df: DataFrame, bits: str, value: str) -> DataFrame:
    """``df`` with the key column ``bits`` turned back into a DOUBLE ``value``."""
    cols = [c for c in df.columns if c != bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _flip(b.column(bits).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.float64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(x)], [*cols, value])
    return df.mapInArrow(run, T.StructType([*df.select(*cols).schema.fields, T.StructField(value, T.DoubleType())]))


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(by, median): the mean of the two middle values of each group, exactly;
    a group without values has no row."""
    n = F.col("_n")
    got = nth_smallest(with_bits(df.select(*by, value), value), "_bits",
                       {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1}, by)
    return from_bits(got.drop("left"), "bits", "_x").groupBy(*by).agg(F.avg("_x").alias(name))


def latest(df: DataFrame, order: str, tie: str, capacity: int) -> DataFrame:
    """The ``capacity`` rows with the largest (``order``, ``tie``), both LONG;
    all rows if there are no more. Nulls count as the smallest LONG. The cut is
    found by :func:`nth_smallest` on the order and, among the rows that share
    it, on the tie; the rows are never ranked. Rows that agree in both stay or
    go together."""
    lowest = F.lit(-(1 << 63)).cast("bigint")
    d = df.withColumns({"_o": F.coalesce(F.col(order).cast("bigint"), lowest), "_t": F.coalesce(F.col(tie).cast("bigint"), lowest)})
    cut = written(nth_smallest(d, "_o", {"cut": F.greatest(F.col("_n") - capacity + 1, F.lit(1))}).select(
        F.col("bits").alias("_cut"), F.col("left").alias("_left")), "cut")  # one row, none for an empty table
    at = d.join(F.broadcast(cut), F.col("_o") == F.col("_cut"))
    least = nth_smallest(at, "_t", {"cut": F.col("_left")}, by=["_left", "_cut"]).select("_cut", F.col("bits").alias("_least"))
    return (d.crossJoin(F.broadcast(least)).where((F.col("_o") > F.col("_cut")) | (F.col("_o") == F.col("_cut")) & (F.col("_t") >= F.col("_least")))
            .select(*df.columns))
