"""Every registered query with an oracle matches DuckDB on sf0.001
(row count, column names, order-insensitive values rounded to 6 places)."""

import duckdb
import pytest

import __spark_entry__ as entry
from assaylake.sources.tables import DRIVER_TABLES
from tools.check_oracle import digest

from .conftest import SF_SMALL

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


NAMES = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    (row,) = df.collect()
    assert 0.0 <= row["score"] <= 1.0 and row["mae"] <= row["rmse"] < 6.0
    # a fifth of the molecules, rounded up, is scored
    assert row["n"] == -(-spark.read.parquet(f"{SF_SMALL}/part.parquet").count() // 5)
