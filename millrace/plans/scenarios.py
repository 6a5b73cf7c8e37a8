"""Queries through the DataFrame helpers, the recursive operator, streaming and the statement front end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational
from ..operators.recursive import recursive_sql
from ..streaming import events as streams


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{where.rstrip('/')}/engine-{uuid.uuid4().hex}" if where else f"file://{tempfile.mkdtemp(prefix='millrace-')}"


def except_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    return relational.except_by_count(nation.select(F.col("n_regionkey").alias("k")), region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("k")))


def recursive_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    spark.sql("SELECT n_nationkey AS src, (n_nationkey * 2 + n_regionkey) % 25 AS dst FROM nation").createOrReplaceTempView("edges")
    return recursive_sql(spark, "reach", ["node"], "SELECT 3", "SELECT e.dst FROM edges e JOIN reach r ON e.src = r.node")


def fn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    name = F.col("p_name")
    return p.select(
        "p_partkey",
        scalars.initcap(F.concat(name, F.lit("-x_y"))).alias("title"),
        scalars.substring(name, F.lit(-2), F.lit(3)).alias("clamped"),
        scalars.lpad(name, 5, "").alias("no_pad"),
        scalars.rpad(name, 30, "ab").alias("padded"),
        scalars.split_part(name, " ", 0).alias("part_zero"),
        scalars.chr_(F.col("p_size") + 24352).alias("han"),
        F.ascii(name).alias("code"),
        scalars.to_boolean(F.lit("yes")).alias("is_true"),
        scalars.floor_double(F.col("p_retailprice")).alias("down"),
    )


def fn_extract_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[scalars.extract(f, F.col("o_orderdate")).alias(f.lower()) for f in ("YEAR", "QUARTER", "WEEK", "DOW", "DOY", "SECOND", "MILLISECOND")])


def sort_high_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return relational.top_k(o, [relational.desc("p"), relational.asc("o_orderkey")], 25, 5)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of the whole events table; tests run the same function on a stream."""
    out = streams.windowed_counts(_read(spark, sf_dir, "events"), "6 hours")
    return out.withColumn("total", F.round("total", 2))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.sessions(_read(spark, sf_dir, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def _session(spark: SparkSession, sf_dir: str, *names: str):
    """A session that sees the named tables as src_NAME."""
    from .engine import Engine

    session = Engine(spark, _root(spark)).session()
    for name in names:
        session.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"src_{name}")
    return session


def _with_orders(spark: SparkSession, sf_dir: str, first: str = "true"):
    """A session with a copy of two of the tables; of the orders those for which ``first`` holds."""
    session = _session(spark, sf_dir, "customer", "orders")
    session.execute("CREATE SCHEMA shop")
    session.execute("USE SCHEMA shop")
    session.execute("CREATE TABLE customers (id BIGINT PRIMARY KEY, segment VARCHAR(20) NOT NULL, balance DOUBLE)")
    session.execute("CREATE TABLE orders (id BIGINT PRIMARY KEY, customer BIGINT REFERENCES customers (id), status VARCHAR(1), total DOUBLE)")
    session.execute("INSERT INTO customers SELECT c_custkey, c_mktsegment, c_acctbal FROM src_customer")
    session.execute("INSERT INTO orders SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM src_orders WHERE " + first)
    return session


def view_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("CREATE VIEW rich (id, seg) AS SELECT id, segment FROM customers WHERE balance > 5000")
    s.execute("CREATE VIEW rich_orders AS SELECT r.seg, o.id AS order_id FROM rich r JOIN shop.orders o ON o.customer = r.id")
    return s.execute("SELECT seg, count(*) AS n FROM rich_orders GROUP BY seg")


def mv_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("CREATE MATERIALIZED VIEW per_status AS SELECT status, count(*) AS n, min(id) AS lo, max(id) AS hi FROM orders GROUP BY status")
    return s.execute("SELECT status, count(*) AS n, min(id) AS lo, max(id) AS hi FROM orders GROUP BY status;")


def mv_after_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the orders comes in when the view is there."""
    s = _with_orders(spark, sf_dir, "o_orderkey % 2 = 0")
    s.execute("CREATE MATERIALIZED VIEW per_status AS SELECT status, count(*) AS n, sum(id) AS ids, max(id) AS hi FROM orders GROUP BY status")
    s.execute("INSERT INTO orders SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM src_orders WHERE o_orderkey % 2 = 1")
    s.execute("DELETE FROM orders WHERE total < 1000 OR customer IN (SELECT id FROM customers WHERE balance < 0)")
    return s.execute("SELECT * FROM per_status")


def dml_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("UPDATE orders SET status = 'X', total = total * 2 WHERE status = 'O' AND total > 100000")
    s.execute("DELETE FROM orders WHERE status = 'P'")
    s.execute("ALTER TABLE orders ADD COLUMN note VARCHAR(5) DEFAULT 'new'")
    s.execute("COMPACT TABLE orders")
    return s.execute("SELECT status, note, count(*) AS n, round(sum(total), 2) AS total FROM orders GROUP BY status, note")


def tx_own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("BEGIN")
    s.execute("DELETE FROM orders WHERE status <> 'F'")
    inside = s.execute("SELECT 'inside' AS seen, count(*) AS n FROM orders")
    other = s.engine.session().execute("SELECT 'other' AS seen, count(*) AS n FROM shop.orders")
    inside, other = inside.collect(), other.collect()
    s.execute("ROLLBACK")
    after = s.execute("SELECT 'after' AS seen, count(*) AS n FROM orders").collect()
    return spark.createDataFrame(inside + other + after, "seen string, n long")


def information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    return s.execute("SELECT table_name, column_name, ordinal_position, data_type, is_nullable, column_key FROM information_schema.columns WHERE table_schema = 'shop'")


def explain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    return s.execute("EXPLAIN ANALYZE SELECT c.segment, count(*) AS n FROM customers c JOIN orders o ON o.customer = c.id GROUP BY c.segment")


def recursive_front_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    return s.execute("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 3) % 11 FROM r) SELECT count(*) AS n, max(n) AS top FROM r")


def sql_string_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "part").execute(
        """SELECT p_partkey, INITCAP(p_name || '-x_y') AS title, SUBSTRING(p_name, -2, 3) AS clamped, SUBSTRING(p_name FROM 2 FOR 4) AS some, LPAD(p_name, 5, '') AS no_pad, RPAD(p_name, 30, 'ab') AS padded,
        SPLIT_PART(p_name, ' ', 0) AS part_zero, SPLIT_PART(p_name, '', 1) AS whole, CHR(p_size + 24352) AS han, CAST('yes' AS BOOLEAN) AS is_true FROM src_part"""
    )


def sql_extract_dow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "orders").execute("SELECT o_orderkey, EXTRACT(DOW FROM o_orderdate) AS dow, EXTRACT(MILLISECOND FROM o_orderdate) AS ms, EXTRACT(YEAR FROM o_orderdate) AS y FROM src_orders")


def sql_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "orders").execute("SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM src_orders ORDER BY p DESC, o_orderkey LIMIT 25 OFFSET 5")


def sql_window_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "customer").execute(
        """SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING')) AS up,
        rank() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') DESC) AS down FROM src_customer"""
    )


def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of ALTER TABLE, CREATE TABLE LIKE, RENAME and DROP, then the columns that are left."""
    s = _with_orders(spark, sf_dir)
    for statement in (
        "CREATE TABLE copy LIKE orders", "ALTER TABLE copy ADD COLUMN note VARCHAR(5) DEFAULT 'new'", "ALTER TABLE copy RENAME COLUMN status TO state", "ALTER TABLE copy ALTER COLUMN total SET DATA TYPE DECIMAL(14, 2)",
        "ALTER TABLE copy ALTER COLUMN state SET NOT NULL", "ALTER TABLE copy ALTER COLUMN note SET NOT NULL", "ALTER TABLE copy ALTER COLUMN note DROP NOT NULL", "ALTER TABLE copy DROP PRIMARY KEY",
        "ALTER TABLE copy ADD COLUMN spare INT", "ALTER TABLE copy DROP COLUMN spare", "ALTER TABLE copy RENAME TO copied", "INSERT INTO copied (id, state, total) SELECT id, status, total FROM orders", "DROP TABLE orders",
    ):
        s.execute(statement)
    return s.execute(
        """SELECT column_name, ordinal_position, data_type, is_nullable, (SELECT count(*) FROM copied) AS n, (SELECT CAST(round(sum(total), 0) AS BIGINT) FROM copied) AS total
        FROM information_schema.columns WHERE table_schema = 'shop' AND table_name = 'copied'"""
    )


def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements the constraints refuse, and what is left."""
    from .errors import EngineError

    s = _with_orders(spark, sf_dir)
    s.execute("CREATE UNIQUE INDEX seg ON customers (id, segment)")
    refused = []
    for what, statement in (
        ("null key", "INSERT INTO customers VALUES (NULL, 'X', 0.0)"), ("same key", "INSERT INTO customers SELECT id, segment, balance FROM customers"), ("null in NOT NULL", "INSERT INTO customers VALUES (-1, NULL, 0.0)"),
        ("good row", "INSERT INTO customers VALUES (-1, 'X', 0.0)"), ("no parent", "INSERT INTO orders VALUES (-1, -99, 'O', 1.0)"), ("null parent", "INSERT INTO orders VALUES (-1, NULL, 'O', 1.0)"),
        ("parent in use", "DELETE FROM customers WHERE id > 0"), ("free parent", "DELETE FROM customers WHERE id = -1"), ("key moved on another", "UPDATE orders SET id = 5 WHERE id < 100"), ("drop a parent", "DROP TABLE customers"),
        ("truncate a parent", "TRUNCATE TABLE customers"), ("truncate a child", "TRUNCATE TABLE orders"),
    ):
        try:
            s.execute(statement)
            refused.append((what, False))
        except EngineError:
            refused.append((what, True))
    left = s.execute("SELECT (SELECT count(*) FROM customers) AS a, (SELECT count(*) FROM orders) AS b").first()
    return spark.createDataFrame([(*r, left["a"], left["b"]) for r in refused], "what string, refused boolean, customers long, orders long")


def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_orders(spark, sf_dir).execute("SELECT id, total FROM orders WHERE status = ? AND total > ?", ["O", 150000.0])


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("INSERT INTO orders VALUES (-7, NULL, 'Z', 0.5)")
    s.execute("COMPACT TABLE orders")
    return s.execute("SELECT id, status FROM orders WHERE id IN (-7, 1, 3) OR id = 100 OR id BETWEEN 200 AND 210")


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("CREATE INDEX by_customer ON orders (customer)")
    return s.execute("SELECT id, customer FROM orders WHERE customer = 7 OR customer BETWEEN 20 AND 22")


def metadata_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import info

    s = _with_orders(spark, sf_dir)
    s.execute("CREATE VIEW rich AS SELECT id FROM customers WHERE balance > 5000")
    return info.get_tables(s, "sh%", "%r%", ["BASE TABLE", "VIEW"]).select("table_name")


def explain_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of EXPLAIN that no figure of a run enters."""
    s = _with_orders(spark, sf_dir)
    out = s.execute("EXPLAIN SELECT status, count(*) AS n FROM orders WHERE total > 1000 GROUP BY status")
    kinds = "CASE WHEN operation ILIKE '%aggregate%' THEN 'aggregate' WHEN operation ILIKE '%scan%' OR operation ILIKE '%relation' THEN 'scan' WHEN operation ILIKE '%filter%' THEN 'filter' END"
    return out.selectExpr(f"{kinds} AS kind").where("kind IS NOT NULL").distinct()


_QUERIES = (
    sql_string_gaps, sql_extract_dow, sql_null_order, sql_window_null_order, ddl_alter, constraint_checks, prepared_statement, point_lookup, index_scan, metadata_tables, explain_operations,
    except_counting, recursive_reach, fn_gaps, fn_extract_api, sort_high_nulls, stream_windows, stream_sessions, view_nested, mv_aggregate, mv_after_dml,
    dml_update_delete, tx_own_writes, information_schema, explain_table, recursive_front_end,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_TITLE = "list_aggregate(list_transform(regexp_extract_all(p_name || '-x_y', '([\\p{L}\\p{Nd}]+|[^\\p{L}\\p{Nd}]+)'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')"


def oracle_sql() -> dict[str, str]:
    return {
        "except_counting": "SELECT DISTINCT k FROM (SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region WHERE r_regionkey < 3) t",
        "recursive_reach": "WITH RECURSIVE reach(node) AS (SELECT 3 UNION SELECT (n.n_nationkey * 2 + n.n_regionkey) % 25 FROM nation n JOIN reach r ON n.n_nationkey = r.node) SELECT node FROM reach",
        "fn_gaps": f"""SELECT p_partkey, {_TITLE} AS title, substring(p_name, 1, 3) AS clamped, '' AS no_pad, rpad(p_name, 30, 'ab') AS padded, '' AS part_zero,
            chr(p_size + 24352) AS han, ascii(p_name) AS code, false AS is_true, floor(p_retailprice) AS down FROM part""",
        "fn_extract_api": """SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS year, extract(QUARTER FROM o_orderdate) AS quarter, extract(WEEK FROM o_orderdate) AS week, extract(ISODOW FROM o_orderdate) AS dow,
            extract(DOY FROM o_orderdate) AS doy, CAST(floor(extract(SECOND FROM o_orderdate)) AS BIGINT) AS second, extract(MILLISECOND FROM o_orderdate) % 1000 AS millisecond FROM orders""",
        "sort_high_nulls": "SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) t ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 5",
        "stream_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "stream_sessions": """WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)
            SELECT user_id, CAST(sum(fresh) AS BIGINT) AS n_sessions, count(*) AS n_events FROM g GROUP BY user_id""",
        "sql_string_gaps": f"""SELECT p_partkey, {_TITLE} AS title, substring(p_name, 1, 3) AS clamped, substring(p_name, 2, 4) AS some, '' AS no_pad, rpad(p_name, 30, 'ab') AS padded, '' AS part_zero, p_name AS whole,
            chr(p_size + 24352) AS han, false AS is_true FROM part""",
        "sql_extract_dow": "SELECT o_orderkey, extract(ISODOW FROM o_orderdate) AS dow, extract(MILLISECOND FROM o_orderdate) % 1000 AS ms, extract(YEAR FROM o_orderdate) AS y FROM orders",
        "sql_null_order": "SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) t ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 5",
        "sql_window_null_order": """SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST) AS up,
            rank() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST) AS down FROM customer""",
        "ddl_alter": """SELECT c.*, (SELECT count(*) FROM orders) AS n, (SELECT CAST(round(sum(CAST(o_totalprice AS DECIMAL(14, 2))), 0) AS BIGINT) FROM orders) AS total FROM (VALUES ('id', 1, 'BIGINT', 'NO'),
            ('customer', 2, 'BIGINT', 'YES'), ('state', 3, 'VARCHAR(1)', 'NO'), ('total', 4, 'DECIMAL(14, 2)', 'YES'), ('note', 5, 'VARCHAR(5)', 'YES')) AS c(column_name, ordinal_position, data_type, is_nullable)""",
        "constraint_checks": """SELECT c.*, (SELECT count(*) FROM customer) AS customers, CAST(0 AS BIGINT) AS orders FROM (VALUES ('null key', true), ('same key', true), ('null in NOT NULL', true), ('good row', false),
            ('no parent', true), ('null parent', false), ('parent in use', true), ('free parent', false), ('key moved on another', true), ('drop a parent', true), ('truncate a parent', true),
            ('truncate a child', false)) AS c(what, refused)""",
        "prepared_statement": "SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000",
        "point_lookup": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (1, 3, 100) OR o_orderkey BETWEEN 200 AND 210 UNION ALL SELECT -7, 'Z'",
        "index_scan": "SELECT o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_custkey IN (7, 20, 21, 22)",
        "metadata_tables": "SELECT * FROM (VALUES ('customers'), ('orders'), ('rich')) AS t(table_name)",
        "explain_operations": "SELECT * FROM (VALUES ('aggregate'), ('scan'), ('filter')) AS t(kind)",
        "view_nested": "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY c_mktsegment",
        "mv_aggregate": "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderstatus",
        "mv_after_dml": """SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids, max(o_orderkey) AS hi FROM orders
            WHERE NOT (o_totalprice < 1000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY o_orderstatus""",
        "dml_update_delete": """SELECT status, 'new' AS note, count(*) AS n, round(sum(total), 2) AS total FROM (
            SELECT CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS total
            FROM orders WHERE o_orderstatus <> 'P') t GROUP BY status""",
        "tx_own_writes": """SELECT 'inside' AS seen, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'other', count(*) FROM orders
            UNION ALL SELECT 'after', count(*) FROM orders""",
        "information_schema": """SELECT * FROM (VALUES ('customers', 'id', 1, 'BIGINT', 'NO', 'PRI'), ('customers', 'segment', 2, 'VARCHAR(20)', 'NO', ''), ('customers', 'balance', 3, 'DOUBLE', 'YES', ''),
            ('orders', 'id', 1, 'BIGINT', 'NO', 'PRI'), ('orders', 'customer', 2, 'BIGINT', 'YES', ''), ('orders', 'status', 3, 'VARCHAR(1)', 'YES', ''), ('orders', 'total', 4, 'DOUBLE', 'YES', ''))
            AS t(table_name, column_name, ordinal_position, data_type, is_nullable, column_key)""",
        "recursive_front_end": "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 3) % 11 FROM r) SELECT count(*) AS n, max(n) AS top FROM r",
    }
