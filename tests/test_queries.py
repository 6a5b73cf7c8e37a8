"""Every registered relational query against its DuckDB twin, at sf0.001."""

import datetime
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from millrace.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.strftime("%F %T.%f")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert rows
    if name in catalogue.oracle_sql():
        want = oracle.sql(catalogue.oracle_sql()[name])
        names = want.columns
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
