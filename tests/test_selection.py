"""Ranks, selection by counts and draws, on rows the driver tables do not hold."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from assaylake.operators import ranking as R
from assaylake.operators import selection as SE
from assaylake.operators import splits as SP
from assaylake.plans.q_aggs import stat_pool


def test_buffer_keeps_the_latest_longs_beyond_doubles(spark):
    big = 1 << 60
    df = spark.createDataFrame([(big + k, k) for k in range(6)], "o long, t long")
    assert sorted(r["t"] for r in SP.bounded_buffer(df, "o", "t", 2).collect()) == [4, 5]
    rng = random.Random(4)
    rows = [(rng.choice([None, -5, 7, 7, 7, big, -big, rng.randrange(-50, 50)]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "o long, t long")
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), r[1]))
    for capacity in (1, 250, 1000):
        got = sorted(r["t"] for r in SP.bounded_buffer(df, "o", "t", capacity).collect())
        assert got == sorted(t for _, t in order[-capacity:])
    assert SP.bounded_buffer(df.limit(0), "o", "t", 3).count() == 0
    assert SP.bounded_buffer(df, "o", "t", 0).count() == 0


def test_sample_needs_as_many_rows_as_it_draws(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert SP.buffer_sample(spark, df, "k", 11).count() == 0
    got = SP.buffer_sample(spark, df, "k", 10).collect()
    assert sorted(r["draw"] for r in got) == list(range(10)) and {r["k"] for r in got} <= set(range(10))


def test_every_group_gets_its_draws(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 > 0, F.lit("a")).alias("g"))
    got = SP.draw_per_group(df, "g", "id", 3).groupBy("g").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3]


def test_shift_finds_neighbours_of_null_keys(spark, many_parts):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 > 0, F.lit("a")).alias("k"))
    got = R.sequence_shift(df, "k", "id", [], ["id"], -1).collect()
    assert sum(r["id_shift"] is None for r in got) == 2
    assert all(r["id_shift"] in (None, r["id"] - 2) for r in got)


def test_running_sums_and_counts_over_many_parts(spark, many_parts):
    rng = random.Random(1)
    rows = [(rng.choice(["x"] * 6 + ["y", None]), rng.randrange(40), k, rng.randrange(9)) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v int")
    out = R.placed(df, ["o", "id"], by=["g"], rank="r", count="n", sums={"s": F.col("v")})
    got = {r["id"]: (r["r"], r["n"], r["s"]) for r in out.collect()}
    for g in ("x", "y", None):
        mine, total = sorted((o, k, v) for h, o, k, v in rows if h == g), 0
        for i, (_, k, v) in enumerate(mine, 1):
            total += v
            assert got[k] == (i, len(mine), total)


@pytest.mark.parametrize("n", [2, 501])
def test_median_of_a_hot_group(spark, n):
    rng = random.Random(n)
    hot = [rng.choice([0.0, -0.0, 1.5, rng.gauss(0, 1e3), rng.random() * 1e-200]) for _ in range(n)]
    rows = [("hot", x) for x in hot] + [("one", 3.25), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["median"] for r in stat_pool(df, ["g"]).collect()}
    assert got == {"hot": pytest.approx(statistics.median(hot), rel=1e-15), "one": 3.25, "none": None, None: 3.0}
    assert SE.exact_median(df.limit(0), ["g"], "x").count() == 0
