"""The manifest against trees built level by level in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assaylake.llm import merkle


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(digests):
    """(top, proofs as lists of (side, sibling))."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            proofs[k].append("-" if j >= len(level) else ("L" if j < i else "R") + level[j])
        at = [i // 2 for i in at]
        level = [_h(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _h(*[_field(v) for v in r])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([d for *_, d in sorted(groups[g])]) for g in order}
    root, over = _tree([trees[g][0] for g in order])
    out = []
    for g, last in zip(order, over, strict=True):
        for (known, i, d), p in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((i if known else None, g, d, trees[g][0], root, tuple(p + last)))
    return sorted(out, key=repr)


def _manifest(df, bits):
    parts = [F.col("doc_id"), F.col("lang"), F.col("text")]
    got = merkle.manifest(df, parts, F.col("lang"), F.col("doc_id"), keep={"doc_id": F.col("doc_id")}, bits=bits)
    assert got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    return sorted(((r["doc_id"], r["grp_value"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"])) for r in got.collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 12])
def test_trees_over_several_rounds(spark, bits):
    rows = [(i, "big", f"t{i}") for i in range(37)] + [(i, "mid", "x") for i in range(100, 116)]
    rows += [(7, "one", "\u00e4" * 5), (8, None, None), (None, None, "y"), (9, "\u00e9", "z"), (9, "Z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    assert _manifest(df, bits) == _brute(rows)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a", "t")] * 9 + [(2, "a", "u"), (None, "a", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    df = df.withColumns({c: F.lit("q") for c in ("grp", "pos", "n", "digest", "proof", "block", "g", "o", "tie", "root", "_part", "_at")})
    assert _manifest(df, 2) == _brute(rows)


def test_one_row_is_its_own_root_and_no_row_has_none(spark):
    df = spark.createDataFrame([(5, "a", "t" * 3_000_000)], "doc_id long, lang string, text string")
    (row,) = _manifest(df, 12)
    assert row[2] == row[3] == row[4] and row[5] == ()
    assert _manifest(df.limit(0), 12) == []


def test_any_change_is_noticed(spark):
    df = spark.createDataFrame([(i, "a", f"t{i}") for i in range(11)], "doc_id long, lang string, text string")
    other = merkle.digest(F.col("doc_id"), F.col("lang"), F.lit("t3"))
    got = merkle.manifest(df, [F.col(c) for c in df.columns], F.col("lang"), F.col("doc_id"),
                          keep={"doc_id": F.col("doc_id"), "now": other}, bits=2)
    same = got.where(merkle.fold(F.col("now"), F.col("proof")) == F.col("root")).collect()
    assert [r["doc_id"] for r in same] == [3]
