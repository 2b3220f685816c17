"""Array-column helpers built from Spark higher-order functions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arr_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(arr) -> Column:
    return let(_c(arr), lambda a: let(F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)),
                                      lambda norm: F.transform(a, lambda x: x / norm)))


def logsumexp(arr) -> Column:
    return let(_c(arr), lambda a: let(F.array_max(a), lambda m: m + F.log(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("bigint")


def softmax_at(arr, idx) -> Column:
    """Softmax probability at 0-based position ``idx``."""
    x = F.element_at(_c(arr), (_c(idx) + 1).cast("int"))
    return F.exp(x - logsumexp(arr))


def one_hot(c, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == _c(c)).cast("int"))


def one_hot_argmax(arr) -> Column:
    return argmax(arr)


def offset_encode(arr, offset: int = 512, extra: int = 0) -> Column:
    """Feature j gets ``1 + offset*j`` (+extra) so all features share one id space."""
    return F.transform(_c(arr), lambda x, i: x + F.lit(1 + extra) + F.lit(offset) * i)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn`` as a lambda
    variable. Reusing a Python Column inside a lambda would copy (and
    re-evaluate) the whole expression at every lambda iteration, because the
    optimizer may inline a projected alias into its consumer."""
    return F.element_at(F.transform(F.array(value), fn), 1)
