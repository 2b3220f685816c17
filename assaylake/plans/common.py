"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE/FLOAT column (and double arrays) to ``digits`` places
    so engine-level summation order does not change the value hash."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType,
                                                                  (T.DoubleType, T.FloatType)):
            cols.append(F.transform(f.name, lambda x: F.round(x.cast("double"), digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of :func:`rounded` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"


#: added before rounding where values may lie on a half, more than summation order can change
NUDGE = 1e-9


def rounded_off_halves(df: DataFrame, col: str, digits: int = DIGITS) -> DataFrame:
    """:func:`rounded` for a column of means, whose exact value may be a half of
    the last place: a small shift puts both engines on the same side."""
    return df.withColumn(col, F.round(F.col(col) + F.lit(NUDGE), digits))


def r_off_halves(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of :func:`rounded_off_halves`."""
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}, {digits})"
