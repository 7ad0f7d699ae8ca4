"""Every query with an SQL oracle equals DuckDB on the smallest tables."""
import pytest

import __spark_entry__ as E
from tools.compare import compare

from .conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck_small, name):
    r = compare(spark, duck_small, name, E.queries()[name], SQL[name], SF_SMALL)
    assert r["cols_ok"] and r["types_ok"], r
    assert r["rows"] == r["drows"], r
    assert r["vals_ok"], r


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["market_segment", "total_bookings", "cancellations", "cancellation_rate"]
    assert sum(r["total_bookings"] for r in rows) == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
