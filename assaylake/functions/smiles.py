"""SMILES token expressions (built-in regex + higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The SMILES token pattern, longest alternatives first
# (bracket atom, two-digit ring label, two-letter halogens, organic-subset
# atoms, ring digit, bond / branch / charge symbols).
TOKEN_RE = r"\[[^\]]+\]|%[0-9]{2}|Br|Cl|[BCNOPSFIbcnops]|[0-9]|[()=#$:/\\.+-]"
RING_RE = r"^(%[0-9]{2}|[0-9])$"
ATOM_RE = r"^(\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops])$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(smiles) -> Column:
    return F.regexp_extract_all(_c(smiles), F.lit(TOKEN_RE), 0)


def valid_smiles(smiles) -> Column:
    """Structural validity: non-empty, tokens cover the whole string, branch
    parentheses balanced (never closing below depth 0), every ring label used
    an even number of times."""
    from .vectors import let
    s = _c(smiles)

    def check(toks):
        covered = F.array_join(toks, "") == s
        depth = F.aggregate(
            toks, F.lit(0),
            lambda acc, t: F.when(acc < 0, acc).when(t == "(", acc + 1).when(t == ")", acc - 1).otherwise(acc))
        even = let(F.filter(toks, lambda t: t.rlike(RING_RE)), lambda rings: F.forall(
            F.array_distinct(rings), lambda lab: F.pmod(F.size(F.filter(rings, lambda x: x == lab)), F.lit(2)) == 0))
        return (F.length(s) > 0) & covered & (depth == 0) & even

    return F.coalesce(let(tokens(s), check), F.lit(False))


def sql_tokens(expr: str) -> str:
    """DuckDB twin of :func:`tokens`."""
    return f"regexp_extract_all({expr}, '{TOKEN_RE}')"
