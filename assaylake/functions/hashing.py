"""Deterministic, engine-portable hashing.

Spark's ``hash``/``xxhash64`` and ``rand`` are not reproducible in other
engines, so every seeded choice (splits, samples, marks) uses the first 32 bits
of an md5 over ``"<seed>:<key>"``. The same expression is written for DuckDB
in :func:`sql_hash32` so oracle queries pick the same members.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(cols, seed) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.concat_ws(":", *parts)


def hash32(*cols, seed: int = 0) -> Column:
    """Unsigned 32-bit hash in [0, 2^32) as BIGINT."""
    return F.conv(F.substring(F.md5(_key(cols, seed)), 1, 8), 16, 10).cast("bigint")


def hash32_of(*values, seed: int = 0) -> int:
    """:func:`hash32` of whole numbers or strings, inside a task."""
    return int(hashlib.md5(":".join(map(str, (seed, *(v for v in values if v is not None)))).encode()).hexdigest()[:8], 16)


def uniform(*cols, seed: int = 0) -> Column:
    """Deterministic pseudo-uniform double in [0, 1)."""
    return hash32(*cols, seed=seed) / F.lit(TWO_32)


def sql_hash32(*exprs: str, seed: int = 0) -> str:
    """DuckDB twin of :func:`hash32`; ``exprs`` are SQL expressions."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT"


def sql_uniform(*exprs: str, seed: int = 0) -> str:
    return f"({sql_hash32(*exprs, seed=seed)} / 4294967296.0)"
