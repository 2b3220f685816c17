"""Scalar Column expressions (E1-E14 of the inventory). All are built-in
Spark expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_ic50(p) -> Column:
    """pIC50 -> IC50 in nM: 10^(9 - p)."""
    return F.pow(F.lit(10.0), F.lit(9.0) - _c(p))


def to_pic50(x) -> Column:
    """IC50 in nM -> pIC50: 9 - log10(x)."""
    return F.lit(9.0) - F.log10(_c(x))


def convert_units(c, factor: float) -> Column:
    return _c(c) / F.lit(float(factor))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def swish(c) -> Column:
    return _c(c) * sigmoid(c)


def neg_abs_err(a, b) -> Column:
    return -F.abs(_c(a) - _c(b))


def piecewise(step, first: float, last: float, start: int, end: int) -> Column:
    """Constant ``first`` before ``start``, constant ``last`` after ``end``,
    linear in between."""
    s = _c(step)
    lin = F.lit(first) - (s - F.lit(start)) / F.lit(float(end - start)) * F.lit(first - last)
    return F.when(s < start, F.lit(first)).when(s > end, F.lit(last)).otherwise(lin)


def normalize_name(c) -> Column:
    """Lower case, with ``-``, ``_`` and spaces removed."""
    return F.regexp_replace(F.lower(_c(c)), "[-_ ]", "")


def position_encoding(pos, dim, d_model: int) -> Column:
    """sin for even dims, cos for odd dims of pos / 10000^(2i/d)."""
    i2 = (_c(dim) - F.pmod(_c(dim), F.lit(2))).cast("double")
    angle = _c(pos).cast("double") * F.exp(i2 * F.lit(-math.log(10000.0) / d_model))
    return F.when(F.pmod(_c(dim), F.lit(2)) == 0, F.sin(angle)).otherwise(F.cos(angle))


def ntz_epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ wall clock,
    independent of the session time zone (no cast to a zoned timestamp)."""
    t = _c(c)
    secs = (F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))
    return secs * 1000000 + F.date_format(t, "SSSSSS").cast("bigint")
