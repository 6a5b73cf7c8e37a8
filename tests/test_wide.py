"""Queries whose keys have few values: the rows of their SQL, and no task that holds a key whole."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalogue

duckdb = pytest.importorskip("duckdb")

NAN = float("nan")


def by_task(df):
    return {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}


def rows(df):
    return Counter(map(repr, df.collect()))


@pytest.fixture
def customers(spark, tmp_path):
    """One key of 600 rows, small keys, a right side without a left one, nulls, NaN and repeated rows."""
    data = [(i, 1, 9500.0 if i % 3 else 10.0, "A") for i in range(600)] + [(1000 + i, 2 + i % 40, 9999.0, "B") for i in range(120)]
    data += [(2000 + i, 7, 0.0, "C") for i in range(300)] + [(5, 1, 9500.0, "A")] * 3
    data += [(None, 1, 9500.0, "A"), (9000, None, 9500.0, "A"), (9001, 1, 9500.0, None), (9002, 1, NAN, "A"), (9003, 1, None, "A")]
    spark.createDataFrame(data, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{tmp_path}/customer.parquet").createOrReplaceTempView("customer")
    return str(tmp_path)


def test_join_self_deals_out_a_large_key(spark, customers, monkeypatch):
    from millrace.operators import blocks

    want = rows(spark.sql(catalogue.SHARED["join_self"]))
    for block, pairs, tasks in ((64, 4096, 20_000), (64, 4096, 5), (4096, 1 << 24, 20_000)):
        for name, value in (("BLOCK", block), ("PAIRS", pairs), ("MAX_TASKS", tasks)):
            monkeypatch.setattr(blocks, name, value)
        out = catalogue.queries()["join_self"](spark, customers)
        assert rows(out) == want
        if tasks > 5 and block == 64:
            assert max(by_task(out).values()) < 3 * pairs < sum(want.values()) / 5


def test_join_self_without_pairs(spark, tmp_path):
    spark.createDataFrame([], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert catalogue.queries()["join_self"](spark, str(tmp_path)).collect() == []


@pytest.fixture
def orders(spark, tmp_path):
    """A status with most rows, null statuses, priorities and keys, keys far apart, and a row that occurs twice."""
    data = [(i * i if i % 2 else -i, "F" if i % 10 else "O", f"{i % 4}-X" if i % 7 else "5-LOW") for i in range(2000)]
    data += [(100_000 + i, None, None if i % 2 else "5-LOW") for i in range(50)] + [(None, "F", "1-X"), (None, "O", None), (2**60, "F", "2-X"), (7777, "F", "1-X"), (7777, "F", "1-X")]
    spark.createDataFrame(data, "o_orderkey long, o_orderstatus string, o_orderpriority string").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def oracle(folder, table, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return con.sql(catalogue.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("most", [100, 1 << 19])
def test_win_nulls_cuts_a_large_partition(spark, orders, monkeypatch, most):
    from millrace.operators import ranks

    monkeypatch.setattr(ranks, "ROWS", most)
    out = catalogue.queries()["win_nulls"](spark, orders)
    got, want = [tuple(r) for r in out.collect()], oracle(orders, "orders", "win_nulls")
    # the SQL leaves open which of two equal rows comes first, in each of its orders
    for column in (1, 2):
        assert Counter((r[0], r[column]) for r in got) == Counter((r[0], r[column]) for r in want)
    if most == 100:
        assert max(by_task(out).values()) < 2 * most


def test_win_nulls_with_values_beyond_the_broadcast(spark, orders, monkeypatch):
    from millrace.operators import ranks

    monkeypatch.setattr(ranks, "ROWS", 100)
    monkeypatch.setattr(ranks, "FEW", 5)
    got = [tuple(r) for r in catalogue.queries()["win_nulls"](spark, orders).collect()]
    want = oracle(orders, "orders", "win_nulls")
    for column in (1, 2):
        assert Counter((r[0], r[column]) for r in got) == Counter((r[0], r[column]) for r in want)


def test_win_nulls_without_rows(spark, tmp_path):
    spark.createDataFrame([], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert catalogue.queries()["win_nulls"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("few", [1, 1 << 17])
@pytest.mark.parametrize("name", ["win_rank", "win_range_peers", "win_partition_agg", "win_expr_partition"])
def test_windows_on_few_partitions(spark, customers, monkeypatch, name, few):
    from millrace.operators import ranks

    monkeypatch.setattr(ranks, "ROWS", 100)
    monkeypatch.setattr(ranks, "FEW", few)
    out = catalogue.queries()[name](spark, customers)
    assert Counter(map(repr, map(tuple, out.collect()))) == Counter(map(repr, oracle(customers, "customer", name)))
    assert max(by_task(out).values()) < 600 or few == 1
    assert dict(out.dtypes) == dict(spark.sql(catalogue.SHARED[name]).dtypes)
