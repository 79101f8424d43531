"""Relational queries: filters, joins, aggregates, windows, sorts, sets, CTEs and subqueries.

Each is one text that the session and the oracle both run: nothing but shared SQL is needed, NULL order is always written
out, and sums of money run over decimals, so the answers agree to the last digit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import asof_join, less_join
from tessera.plans.catalogue import query, table
from tessera.session import Session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def on_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL by a session over the Parquet tables it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return Session(spark, cache_entries=0).sql(sql)


def shared(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return on_tables(spark, sf_dir, sql)

    run.__name__ = name
    query(oracle or sql)(run)


_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
SUM_PRICE, SUM_TOTAL = _MONEY.format("l_extendedprice"), _MONEY.format("o_totalprice")

for _name, _sql in {
    "filter_eq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_or_same_column": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'HOUSEHOLD'",
    "filter_range_int": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20",
    "filter_range_float": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0.05 AND l_discount <= 0.07",
    "filter_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "filter_prefix": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'",
    "filter_contains": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%001%'",
    "filter_contains_all": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0%1%2%'",
    "filter_null": "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal < -900 WHERE c_custkey IS NULL",
    "filter_not_null": "SELECT count(*) AS n FROM events WHERE value IS NOT NULL AND props IS NOT NULL",
    "filter_residual": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice > 100000) AND CASE WHEN o_custkey % 2 = 0 THEN true ELSE false END",
    "count_where": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30",
    "count_metadata": "SELECT count(*) AS n FROM lineitem",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "project_computed": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "join_cross": "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation",
    "join_self": "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_fk_star": f"SELECT r_name, n_name, count(*) AS n, {SUM_TOTAL} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "join_count": "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'",
    "join_agg": f"SELECT count(*) AS n, {SUM_PRICE} AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 15",
    "join_topk": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_rollup": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {SUM_TOTAL} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_single": "SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F'",
    "agg_empty": "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderkey < 0",
    "agg_moments": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS dev, round(var_pop(l_quantity), 6) AS spread, round(corr(l_quantity, l_extendedprice), 6) AS r, bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS steep FROM lineitem GROUP BY l_returnflag",
    "window_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ASC NULLS LAST) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ASC NULLS LAST) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST)",
    "window_lag_lead": "SELECT event_id, lag(event_id, 1) OVER w AS before, lead(event_id, 2, -1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST)",
    "window_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice ASC NULLS LAST, o_orderkey ASC NULLS LAST) AS quarter FROM orders",
    "window_percent_rank": "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice ASC NULLS LAST)",
    "window_running": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, max(event_id) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events",
    "window_first_last": "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size ASC NULLS LAST RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part",
    "window_empty_over": "SELECT n_nationkey, count(*) OVER () AS n FROM nation",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS rn FROM lineitem) t WHERE rn <= 5",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 50",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders",
    "intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "subquery_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "subquery_correlated": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "recursive_tree": "WITH RECURSIVE t AS (SELECT n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey AS id, t.depth + 1 AS depth FROM nation n JOIN t ON (n.n_nationkey - 1) DIV 2 = t.id AND n.n_nationkey > 0) SELECT id, depth FROM t",
}.items():
    shared(_name, _sql, _sql.replace(" DIV ", " // ") if " DIV " in _sql else None)

for _name, _sql, _oracle in (
    ("agg_group_concat", "SELECT n_regionkey, group_concat(n_name, '|') AS names FROM (SELECT * FROM nation WHERE n_nationkey = n_regionkey) GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|') AS names FROM nation WHERE n_nationkey = n_regionkey GROUP BY n_regionkey"),
    ("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    ("dt_trunc_extract", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y FROM orders", None),
    ("series", "SELECT value FROM series(1, 25, 3)", "SELECT unnest(generate_series(1, 25, 3)) AS value"),
    ("json_extract", "SELECT event_id, json_extract(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
):
    shared(_name, _sql, _oracle)


@query("SELECT event_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", F.col("o_orderkey").alias("last_order"))
    return asof_join(events, orders, "k", "ts", "o_orderdate", "event_id", "last_order")


@query("SELECT a.p_partkey AS cheap, b.p_partkey AS dear FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_retailprice < b.p_retailprice - 800")
def join_theta(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cheap = part.select("p_brand", F.col("p_partkey").alias("cheap"), F.col("p_retailprice").alias("low"))
    dear = part.select("p_brand", F.col("p_partkey").alias("dear"), (F.col("p_retailprice") - 800).alias("high"))
    return less_join(cheap, dear, "p_brand", "low", "high").select("cheap", "dear")
