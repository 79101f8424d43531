"""Queries over the function libraries, with SQL twins that spell the meaning out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions import datetime as D
from tessera.functions import json as J
from tessera.functions import math as M
from tessera.functions import strings as S
from tessera.plans.catalogue import query, table


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d') AS later, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start FROM events")
def dt_date(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", D.date(ts, kind="timestamp").alias("d"), D.time(ts, kind="timestamp").alias("t"), D.datetime(ts, kind="timestamp").alias("dt"), D.date(ts, "+36 hours", kind="timestamp").alias("later"), D.datetime(ts, "start of day", kind="timestamp").alias("start"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y') || ' at ' || strftime(ts, '%H') || 'h%' AS f FROM events")
def dt_strftime(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.strftime("%d/%m/%Y at %Hh%%", F.col("ts"), kind="timestamp").alias("f"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts)) / 86400.0 + 2440587.5 AS j FROM events")
def dt_unixepoch(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.unixepoch(F.col("ts"), kind="timestamp").alias("s"), D.julianday(F.col("ts"), kind="timestamp").alias("j"))


@query("SELECT o_orderkey, (epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) / 1000.0 AS secs FROM orders")
def dt_timediff(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.timediff(F.col("o_orderdate").cast("string"), F.lit("1995-01-01")).alias("secs"))


@query("SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS whole, json_valid(props)::INT AS valid, coalesce(json_array_length(props), 0)::BIGINT AS n FROM events")
def json_type(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", (J.json_type(p, "$.k") == "integer").alias("whole"), J.json_valid(p).alias("valid"), J.json_array_length(p).alias("n"))


@query("SELECT event_id, j.key, j.value::VARCHAR AS value FROM events, json_each(props) j")
def json_each(spark, sf_dir):
    return J.json_each(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


@query("""SELECT event_id, '{"k":' || (props->>'$.k') || ',"v":' || event_id || '}' AS put, '{}' AS cut FROM events""")
def json_edit(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", J.json_set(p, "$.v", F.col("event_id")).alias("put"), J.json_remove(p, "$.k").alias("cut"))


@query("""SELECT c_custkey, instr(c_name, '#') AS at, upper(hex(c_name)) AS hx, c_name || '' AS cat, (c_name ILIKE 'customer%1')::INT AS lk,
 (c_name GLOB '*[0-3]')::INT AS gl, regexp_matches(c_name, '0+5')::INT AS rx, length(c_name)::INT AS n, substr(c_name, 3, 4) AS sub, right(c_name, 3) AS tail,
 unicode(c_name)::BIGINT AS uc, '''' || c_name || '''' AS q, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS nf FROM customer""")
def str_basic(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", S.instr(n, F.lit("#")).cast("bigint").alias("at"), S.hex(n).alias("hx"), S.concat(n, F.lit(None)).alias("cat"), S.like("customer%1", n).alias("lk"), S.glob("*[0-3]", n).alias("gl"), S.regexp("0+5", n).alias("rx"), S.length(n).alias("n"), S.substr(n, F.lit(3), F.lit(4)).alias("sub"), S.substr(n, F.lit(-3)).alias("tail"), S.unicode(n).alias("uc"), S.quote(n).alias("q"), S.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("nf"))


@query("SELECT p_partkey, printf('%05d|%-8s|%.2f', p_partkey, substr(p_brand, 1, 5), p_retailprice) AS f, trim(p_brand, 'B#') AS t FROM part")
def str_printf(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.printf("%05d|%-8.5s|%.2f", F.col("p_partkey"), F.col("p_brand"), F.col("p_retailprice")).alias("f"), S.trim(F.col("p_brand"), "B#").alias("t"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE round(ln(l_discount), 9) END AS ln, round(sqrt(l_quantity), 9) AS rt,
 CASE WHEN l_quantity - 25 > 0 THEN 1 WHEN l_quantity < 25 THEN -1 ELSE 0 END::BIGINT AS sg, fmod(l_quantity, 7) AS md, round(log10(l_quantity), 9) AS lg,
 ceil(l_tax) AS ce, CASE WHEN l_quantity > 1 THEN NULL ELSE round(acos(l_quantity), 9) END AS ac FROM lineitem""")
def math_basic(spark, sf_dir):
    q, r = F.col("l_quantity"), lambda c: F.round(c, 9)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(M.ln(F.col("l_discount"))).alias("ln"), r(M.sqrt(q)).alias("rt"), M.sign(q - 25).alias("sg"), M.mod(q, F.lit(7.0)).alias("md"), r(M.log(q)).alias("lg"), M.ceil(F.col("l_tax")).alias("ce"), r(M.acos(q)).alias("ac"))


@query("""SELECT p_brand, coalesce(CAST(sum(p_size) AS DOUBLE), 0.0) AS tot, round(quantile_cont(p_retailprice, 0.5), 6) AS med, round(quantile_cont(p_retailprice, 0.9), 6) AS p90,
 list_sort(list(p_retailprice))[1 + floor(0.3 * (count(p_retailprice) - 1))::INT] AS disc FROM part GROUP BY p_brand""")
def agg_percentiles(spark, sf_dir):
    v = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(A.total(F.col("p_size")).alias("tot"), F.round(A.median(v), 6).alias("med"), F.round(A.percentile(v, 90), 6).alias("p90"), A.percentile_disc(v, 0.3).alias("disc"))


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[1 + floor(0.75 * (count(*) - 1))::INT] AS value FROM lineitem GROUP BY l_returnflag")
def agg_percentile_disc(spark, sf_dir):
    return A.percentile_disc_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.75, ["l_returnflag"])


@query("SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS med FROM events")
def window_percentile(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(), "event_id").rowsBetween(-3, 0)
    return table(spark, sf_dir, "events").select("event_id", F.percentile("value", 0.5).over(w).alias("med"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal IS NULL THEN NULL ELSE greatest(s_acctbal, s_suppkey * 10.0) END AS hi, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE least(s_suppkey, 50) END AS lo FROM supplier")
def scalar_extrema(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.scalar_max(F.col("s_acctbal"), k * F.lit(10.0)).alias("hi"), S.scalar_min(F.when(k % 3 != 0, k), F.lit(50).cast("bigint")).alias("lo"))
