"""Periodic runs against a plain scan of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from assaylake.llm import queries, runs

from ..conftest import SF_SMALL


def _brute(w, least=6, power=4):
    """Every maximal stretch of every period, the smallest period of each."""
    found, seen = [], set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, power * q) and (i, size) not in seen:
                seen.add((i, size))
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _words(rng):
    k = rng.randrange(1, 4)
    w = [rng.choice([b"a", b"b", b"c"][:k]) for _ in range(rng.randrange(40))]
    if w and rng.random() < 0.6:
        w += w[-rng.randrange(1, 9):] * rng.randrange(1, 8) + [rng.choice([b"a", b"b"]) for _ in range(3)]
    return w


@pytest.mark.parametrize("power,least", [(4, 6), (2, 2), (3, 4), (4, 20)])
def test_runs_equal_brute_force(power, least):
    rng = random.Random(power * 100 + least)
    for _ in range(300):
        docs = [_words(rng) for _ in range(rng.randrange(1, 6))]
        assert runs.runs_of(docs, least, power) == [_brute(w, least, power) for w in docs]


def test_nested_and_touching_runs():
    for text in ("x y z a a a a " * 5, "a a a a a a b " * 4, "a b " * 9 + "c " + "b c " * 8, "q " * 50, "a b a a b " * 6):
        w = text.encode().split()
        assert runs.runs_of([w]) == [_brute(w)]


def test_suffix_array_and_prefix_lengths():
    import numpy as np
    rng = random.Random(3)
    t = np.array([rng.randrange(2) for _ in range(200)] + [9])
    sa, rank, lcp = runs.suffix_array(t)
    suffixes = [t[i:].tolist() for i in sa]
    assert suffixes == sorted(suffixes) and (rank[sa] == np.arange(201)).all()
    for k in range(1, 201):
        a, b = suffixes[k - 1], suffixes[k]
        assert lcp[k] == next(i for i in range(len(b)) if i >= len(a) or a[i] != b[i])


def test_query_equals_brute_force_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        w = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = _brute(w)
        r = got[d["doc_id"]]
        with_runs += bool(found)
        assert r["n_runs"] == len(found)
        lines = "".join(f"{s},{x},{q}\n" for s, x, q in found)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        gone = {i for s, x, q in found for i in range(s + q, s + x)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        top = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
    assert with_runs > 5


def test_odd_rows(spark):
    long = "alpha beta gamma " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 5), (4, "x " * 6), (4, "x " * 6), (5, long), (6, "a\u00a0b \u00e9 " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit(0) for c in ("id", "runs", "collapsed", "n_words", "start")})
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                  for r in runs.periodic_runs(df).collect()), key=repr)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 10, [(0, 10, 2)], "a b"),
                          (4, 6, [(0, 6, 1)], "x"), (4, 6, [(0, 6, 1)], "x"), (5, 180_000, [(0, 180_000, 3)], "alpha beta gamma"),
                          (6, 8, [(0, 8, 2)], "a\u00a0b \u00e9")], key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0
