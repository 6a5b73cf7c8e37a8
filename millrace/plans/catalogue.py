"""The registered queries of the relational engine and their oracle SQL.

``SHARED`` runs as it stands on Spark and on the oracle; ``PAIRED`` has one text for
each where the dialects differ.  ``scenarios`` holds queries made with the DataFrame
API, the recursive operator or the statement front end.  ``wide`` runs some of
``SHARED`` in another form on Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import scenarios, wide

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FLAGSHIP = """
SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n_lines,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l.l_returnflag <> 'A'
GROUP BY c.c_mktsegment, o.o_orderpriority
ORDER BY revenue DESC NULLS LAST, c_mktsegment, o_orderpriority LIMIT 10
"""

SHARED = {
    "flagship": FLAGSHIP,
    # scans, projections, predicates
    "scan_project": "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS gross FROM orders WHERE o_totalprice > 100000",
    "values_literal": "SELECT k, v, upper(v) AS u FROM (VALUES (1, 'a'), (2, 'b'), (CAST(NULL AS INT), 'c'), (4, CAST(NULL AS VARCHAR(5)))) AS t(k, v)",
    "filter_three_valued": """SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders
        WHERE NOT (nullif(o_orderpriority, '1-URGENT') = '2-HIGH' AND o_totalprice > 1000) OR (nullif(o_orderstatus, 'F') = 'O' AND o_totalprice < 50000)""",
    "filter_between_in": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('R', 'A') AND l_linenumber NOT IN (3, 5)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '_T%' AND p_brand LIKE 'Brand%'",
    "null_safe_eq": """SELECT o_orderkey, nullif(o_orderstatus, 'O') IS DISTINCT FROM nullif(o_orderstatus, 'F') AS differs,
        nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS nothing FROM orders""",
    "is_true_false": """SELECT o_orderkey, (nullif(o_orderstatus, 'O') = 'F') IS TRUE AS a, (nullif(o_orderstatus, 'O') = 'F') IS NOT TRUE AS b,
        (nullif(o_orderstatus, 'O') = 'F') IS FALSE AS c, (nullif(o_orderstatus, 'O') = 'F') IS NOT FALSE AS d, (nullif(o_orderstatus, 'O') = 'F') IS NULL AS e FROM orders""",
    "case_coalesce": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band,
        CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code,
        coalesce(nullif(c_mktsegment, 'BUILDING'), nullif(c_name, ''), 'none') AS seg FROM customer""",
    "cast_family": """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(CAST(o_orderkey AS VARCHAR(20)) AS BIGINT) AS back,
        CAST(round(o_totalprice, 2) AS DECIMAL(14, 2)) AS dec, CAST(o_orderdate AS DATE) AS d, CAST('2020-02-29' AS DATE) AS leap, CAST(1 AS BOOLEAN) AS yes FROM orders""",
    "cast_to_text": "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR(30)) AS t, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(12)) AS d, CAST(o_orderkey > 5 AS VARCHAR(5)) AS b, CAST(CAST('1996-02-29 12:34:56' AS TIMESTAMP) AS DATE) AS leap FROM orders",
    "like_special": """SELECT s, s LIKE 'a_b' AS one, s LIKE 'a%b' AS any_, s LIKE 'a.b' AS dot, s LIKE '100!%' ESCAPE '!' AS pct, s LIKE '%[x]%' AS brackets
        FROM (VALUES ('a' || chr(10) || 'b'), ('a.b'), ('axb'), ('100%'), ('1000'), ('q[x]q'), ('ab'), (CAST(NULL AS VARCHAR(5)))) AS t(s)""",
    "sort_unicode": """SELECT s, row_number() OVER (ORDER BY s) AS place, char_length(s) AS n, substring(s, 2, 1) AS second FROM (VALUES ('z'), ('é'), ('漢字'), ('かな'), ('Z'), ('😀a'), ('a'), (''), ('ﬁ'), ('𝒜')) AS t(s)""",
    "sort_derived": "SELECT max(k) AS hi, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) t",
    "current_moment": "SELECT r_regionkey, current_date >= DATE '2024-01-01' AS today, CAST(current_timestamp AS DATE) >= DATE '2024-01-01' AS now FROM region",
    "agg_avg_decimal": "SELECT o_orderstatus, round(CAST(avg(CAST(round(o_totalprice, 2) AS DECIMAL(14, 2))) AS DOUBLE), 4) AS mean, sum(CAST(round(o_totalprice, 2) AS DECIMAL(14, 2))) AS total FROM orders GROUP BY o_orderstatus",
    "win_nulls": """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_orderpriority, '5-LOW') ASC NULLS LAST, o_orderkey) AS up,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_orderpriority, '5-LOW') DESC NULLS FIRST, o_orderkey) AS down FROM orders""",
    "cte_reused": "WITH per AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT (SELECT count(*) FROM per) AS n, (SELECT max(q) FROM per) AS hi, (SELECT count(*) FROM per WHERE q > (SELECT avg(q) FROM per)) AS above",
    # shapes of decision-support workloads
    "ds_multi_fact": """SELECT seg, sum(n_orders) AS n_orders, sum(n_lines) AS n_lines FROM (SELECT c_mktsegment AS seg, count(*) AS n_orders, 0 AS n_lines FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
        UNION ALL SELECT c_mktsegment, 0, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment) t GROUP BY seg""",
    "ds_year_over_year": """WITH y AS (SELECT c_nationkey AS nation, CAST(extract(YEAR FROM o_orderdate) AS INT) AS yr, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT a.nation, a.yr, a.n AS now, b.n AS before, a.n - b.n AS more FROM y a JOIN y b ON a.nation = b.nation AND a.yr = b.yr + 1""",
    "ds_window_over_aggregate": """SELECT p_brand, p_size, n, rank() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS place, sum(n) OVER (PARTITION BY p_brand) AS of_brand
        FROM (SELECT p_brand, p_size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_size) t""",
    "ds_above_average": """WITH t AS (SELECT o_custkey, c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey)
        SELECT o_custkey, n FROM t WHERE n > (SELECT 1.2 * avg(n) FROM t x WHERE x.c_nationkey = t.c_nationkey)""",
    "ds_pivot_by_case": """SELECT s_nationkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""",
    "ds_rollup_rank": """SELECT r_name, n_name, n, rank() OVER (PARTITION BY g ORDER BY n DESC, r_name, n_name) AS place FROM (SELECT r_name, n_name, count(*) AS n, grouping(n_name) + grouping(r_name) AS g
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) t""",
    "ds_buyers_of_both": """SELECT count(*) AS n FROM (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
        EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000) t""",
    "ds_never_returned": "SELECT p_partkey FROM part WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 30)",
    "ds_running_share": """SELECT m, n, sum(n) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS so_far, round(n * 100.0 / sum(n) OVER (), 4) AS pct FROM (SELECT CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1) t""",
    "ds_ratio_of_sums": """SELECT n_name, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name HAVING count(*) > 5""",
    # joins
    "join_inner": "SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_left": """SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o.o_custkey = c.c_custkey""",
    "join_right": """SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey""",
    "join_full": """SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM (SELECT * FROM customer WHERE c_acctbal > 3000) a
        FULL JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.c_custkey = b.c_custkey""",
    "join_using": "SELECT s_suppkey, n_name FROM supplier JOIN (SELECT n_nationkey AS s_nationkey, n_name FROM nation) n USING (s_nationkey)",
    "join_comma": "SELECT count(*) AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA'",
    "join_multi_key": """SELECT a.c_nationkey, a.c_mktsegment, a.n AS n_a, b.n AS n_b FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) a
        JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey, c_mktsegment) b
        ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment""",
    "join_three_way": """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000""",
    "join_theta": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_nested_loop": "SELECT a.r_name AS a_name, b.n_name AS b_name FROM region a JOIN nation b ON a.r_regionkey > b.n_regionkey",
    "join_residual": """SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30""",
    "join_expr_key": "SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a JOIN region b ON a.n_nationkey % 5 = b.r_regionkey + 0",
    "join_null_keys": """SELECT a.id AS a_id, a.v AS a_v, b.id AS b_id, b.v AS b_v FROM (VALUES (1, 'x'), (2, 'y'), (3, 'y'), (CAST(NULL AS INT), 'z')) AS a(id, v)
        FULL JOIN (VALUES (2, 'y'), (3, 'y'), (4, 'w'), (CAST(NULL AS INT), 'z')) AS b(id, v) ON a.id = b.id""",
    "join_null_safe": """SELECT a.id AS a_id, b.id AS b_id FROM (VALUES (1), (CAST(NULL AS INT))) AS a(id) JOIN (VALUES (1), (CAST(NULL AS INT)), (2)) AS b(id) ON a.id IS NOT DISTINCT FROM b.id""",
    "join_self": "SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE a.c_acctbal > 9000",
    "semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "not_in_null": "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)",
    "not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "cross_join": "SELECT r.r_name, s.segment FROM region r CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s",
    # sort, limit, distinct
    "sort_nulls_asc": "SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) t ORDER BY p ASC NULLS LAST, o_orderkey LIMIT 50",
    "sort_nulls_desc": "SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) t ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 50",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 35",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 7",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sort_hidden": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12",
    # aggregation
    "agg_global": "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_nf, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders",
    "agg_empty": "SELECT count(*) AS n, sum(o_custkey) IS NULL AS no_sum, max(o_orderdate) AS last FROM orders WHERE o_orderkey < 0",
    "agg_empty_grouped": "SELECT g, n FROM (SELECT o_orderstatus AS g, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus UNION ALL SELECT 'rows', count(*) FROM region) t",
    "agg_group": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "agg_null_group": "SELECT nullif(o_orderpriority, '1-URGENT') AS p, count(*) AS n FROM orders GROUP BY nullif(o_orderpriority, '1-URGENT')",
    "agg_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000",
    "agg_distinct": """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 4) AS a, min(DISTINCT o_custkey) AS lo FROM orders GROUP BY o_orderpriority""",
    "agg_variance": """SELECT o_orderstatus, round(var_samp(o_totalprice), 0) AS vs, round(var_pop(o_totalprice), 0) AS vp, round(stddev_samp(o_totalprice), 3) AS ss, round(stddev_pop(o_totalprice), 3) AS sp FROM orders GROUP BY o_orderstatus""",
    "agg_variance_one": "SELECT g, var_samp(x) AS vs, var_pop(x) AS vp, stddev_samp(x) AS ss FROM (VALUES (1, CAST(5 AS DOUBLE)), (2, CAST(1 AS DOUBLE)), (2, CAST(3 AS DOUBLE))) AS t(g, x) GROUP BY g",
    "agg_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_grouping_fn": "SELECT c_mktsegment, CAST(grouping(c_mktsegment) AS BIGINT) AS g, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)",
    # windows
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d FROM customer",
    "win_lead_lag": "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prv FROM orders",
    "win_lag_default": "SELECT o_orderkey, lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prv2 FROM orders",
    "win_first_last": """SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
        last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders""",
    "win_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "win_partition_agg": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS mean, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top FROM customer",
    "win_rows_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders",
    "win_expr_partition": "SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey % 7, upper(c_mktsegment) ORDER BY c_custkey) AS rn FROM customer",
    "win_range_peers": "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM customer",
    "win_over_agg": "SELECT o_orderstatus, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) t",
    # set operations and CTE
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "intersect_all": "SELECT o_orderstatus AS k FROM orders WHERE o_orderkey < 400 INTERSECT ALL SELECT l_linestatus FROM lineitem WHERE l_orderkey < 100",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT a.o_custkey, a.n, b.n AS same FROM per a JOIN per b ON a.o_custkey = b.o_custkey WHERE a.n > 1",
    # scalar functions
    "fn_math": "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(ceiling(-c_acctbal) AS BIGINT) AS d FROM customer",
    "fn_round": "SELECT o_orderkey, round(CAST(o_orderkey AS DECIMAL(12, 3)) / 8, 1) AS r1, round(CAST(-2.5 AS DECIMAL(4, 1)), 0) AS r2, CAST(round(o_custkey, -1) AS BIGINT) AS tens FROM orders",
    "fn_case_trim": "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, trim(BOTH 'C' FROM c_name) AS t, trim(LEADING 'Cu' FROM c_name) AS tl, trim(TRAILING '0123456789' FROM c_name) AS tt, char_length(c_name) AS n FROM customer",
    "fn_substring_position": "SELECT p_partkey, substring(p_name, 2, 4) AS s, position('a' IN p_name) AS p, left(p_name, 3) AS l, right(p_name, 3) AS r FROM part",
    "fn_pad_repeat": "SELECT n_nationkey, lpad(n_name, 12, '*') AS lp, rpad(n_name, 4, '-') AS rp, repeat(n_name, 2) AS rr, reverse(n_name) AS rv FROM nation",
    "fn_split_replace": "SELECT p_partkey, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', 99) AS none, replace(p_name, 'a', '_') AS rep FROM part",
    "fn_concat": "SELECT c_custkey, c_name || '/' || c_mktsegment AS j, c_name || nullif(c_mktsegment, 'BUILDING') AS maybe FROM customer",
    # subqueries
    "sub_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "sub_scalar_corr": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') AS n FROM customer c",
    "sub_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0)",
    "sub_exists_corr": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)",
    "sub_derived": "SELECT seg, round(avg(total), 2) AS mean FROM (SELECT c.c_mktsegment AS seg, sum(o.o_totalprice) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment, c.c_custkey) t GROUP BY seg",
    "or_factoring": "SELECT count(*) AS n FROM lineitem l JOIN part p ON (p.p_partkey = l.l_partkey AND p.p_size < 10 AND l.l_quantity < 5) OR (p.p_partkey = l.l_partkey AND p.p_size > 40 AND l.l_quantity > 45)",
}

PAIRED = {
    "agg_grouping_id": (
        "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    ),
    "cast_to_int": (
        "SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS whole, CAST(CAST(round(c_acctbal, 2) AS DECIMAL(12, 2)) AS INT) AS exact, CAST(' 12 ' AS INT) AS trimmed FROM customer",
        "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(trunc(CAST(round(c_acctbal, 2) AS DECIMAL(12, 2))) AS INT) AS exact, 12 AS trimmed FROM customer",
    ),
    "literals": (
        "SELECT r_regionkey, hex(X'CAFE') AS b, TRUE AS t, CAST(NULL AS INT) AS nothing, DATE '2024-02-29' AS d, 1.50 AS dec, 1e3 AS dbl, 'it''s' AS s, CAST(7 AS SMALLINT) AS small FROM region",
        "SELECT r_regionkey, 'CAFE' AS b, TRUE AS t, CAST(NULL AS INT) AS nothing, DATE '2024-02-29' AS d, 1.50 AS dec, CAST(1e3 AS DOUBLE) AS dbl, 'it''s' AS s, CAST(7 AS SMALLINT) AS small FROM region",
    ),
    "int_division": ("SELECT o_orderkey, o_orderkey DIV 7 AS d, CAST(-o_orderkey DIV 7 AS BIGINT) AS nd FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, CAST((-o_orderkey) // 7 AS BIGINT) AS nd FROM orders"),
    "fn_extract": (
        """SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m,
        CAST(extract(WEEK FROM o_orderdate) AS BIGINT) AS w, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(extract(DAYOFWEEK_ISO FROM o_orderdate) AS BIGINT) AS dow,
        CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS doy, CAST(extract(HOUR FROM o_orderdate) AS BIGINT) AS h, CAST(extract(MINUTE FROM o_orderdate) AS BIGINT) AS mi, CAST(extract(SECOND FROM o_orderdate) AS BIGINT) AS s FROM orders""",
        """SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(QUARTER FROM o_orderdate) AS q, extract(MONTH FROM o_orderdate) AS m, extract(WEEK FROM o_orderdate) AS w, extract(DAY FROM o_orderdate) AS d,
        extract(ISODOW FROM o_orderdate) AS dow, extract(DOY FROM o_orderdate) AS doy, extract(HOUR FROM o_orderdate) AS h, extract(MINUTE FROM o_orderdate) AS mi, CAST(floor(extract(SECOND FROM o_orderdate)) AS BIGINT) AS s FROM orders""",
    ),
    "recursive_counter": (
        "WITH RECURSIVE n(n) MAX RECURSION LEVEL 1000 AS (SELECT 1 UNION ALL SELECT n + 1 FROM n WHERE n < 200) SELECT n FROM n",
        "WITH RECURSIVE n(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM n WHERE n < 200) SELECT n FROM n",
    ),
    "recursive_fibonacci": (
        "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f",
        "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f",
    ),
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables of a directory."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    import re

    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in names:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(FLAGSHIP)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _sql(text) for name, text in SHARED.items()}
    out |= {name: _sql(text) for name, (text, _) in PAIRED.items()}
    return out | wide.queries() | scenarios.queries()


def oracle_sql() -> dict[str, str]:
    return SHARED | {name: text for name, (_, text) in PAIRED.items()} | scenarios.oracle_sql()
