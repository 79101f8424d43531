"""Queries of sources, sinks, event-time windows and virtual tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.plans.catalogue import query, table
from tessera.plans.search import _store
from tessera.sources import io
from tessera.streaming.windows import sessions, windowed


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    made = windowed(table(spark, sf_dir, "events").withColumn("one", F.lit(1)), "ts", ["event_type"], "one", "1 hour")
    last = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.max("event_id").alias("last")).select(F.col("w.start").alias("start"), "event_type", "last")
    return made.select("start", "event_type", "n").join(last, ["start", "event_type"])


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g.g""")
def event_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours").select("user_id", "start", "n")


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment || chr(9) || '\\' || chr(10) END AS odd FROM customer")
def tsv_round_trip(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{shared.rstrip('/')}/tessera-tsv-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='tessera-tsv-')}/t"
    io.write_tsv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("CASE WHEN c_acctbal > 0 THEN concat(c_mktsegment, char(9), '\\\\', char(10)) END").alias("odd")), path)
    return io.read_tsv(spark, path, "c_custkey long, c_name string, odd string")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'idiot')) AS a, len(list_filter(ws, lambda x: x = 'clown')) AS b, len(list_filter(ws, lambda x: x = 'moron')) AS m FROM w)
SELECT doc_id, (a + b)::DOUBLE AS rank FROM c WHERE a > 0 AND b > 0 AND m = 0""")
def sql_match(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.sql("CREATE VIRTUAL TABLE pages_text USING fts_docs")
    s.store.insert("pages_text", table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id IS NOT NULL"))
    s.store.commit()
    return s.sql("SELECT doc_id, rank FROM pages_text WHERE pages_text MATCH 'idiot clown -moron'")


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY ALL UNION ALL SELECT 'all', count(*), min(o_orderkey), max(o_orderkey) FROM orders")
def store_statistics(spark, sf_dir):
    s = _store(spark, sf_dir)
    whole = s.sql("SELECT count(*) AS n, min(k) AS low, max(k) AS high FROM o").selectExpr("'all' AS status", "*")
    return s.sql("SELECT status, count(*) AS n, min(k) AS low, max(k) AS high FROM o GROUP BY status").unionByName(whole)
