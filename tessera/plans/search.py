"""Queries of the retrieval, text, recursion, approximation and store operators."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import retrieval as V
from tessera.operators import text as T
from tessera.operators.conditions import Query, between, contains, eq, is_in, page, prefix
from tessera.plans.catalogue import query, table
from tessera.plans.relational import on_tables
from tessera.session import Session


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, embedding::DOUBLE[] AS v, e FROM embeddings, q)"


@query(f"{_Q} SELECT vec_id, round(1 - list_cosine_similarity(v, e), 6) AS d, row_number() OVER (ORDER BY 1 - list_cosine_similarity(v, e), vec_id) AS search_rank FROM s QUALIFY search_rank <= 10")
def vector_topk_cosine(spark, sf_dir):
    found = V.vector_search(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id")
    return found.select("vec_id", F.abs(F.round("ann_cosine_distance", 6)).alias("d"), F.col("search_rank").cast("bigint").alias("search_rank"))


@query(f"{_Q} SELECT vec_id, round(list_distance(v, e), 6) AS d FROM s ORDER BY list_distance(v, e), vec_id LIMIT 10")
def vector_topk_l2(spark, sf_dir):
    return V.vector_search(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id", "l2").select("vec_id", F.round("exact_score", 6).alias("d"))


@query(f"{_Q} SELECT vec_id, round(list_inner_product(v, e), 6) AS d FROM s ORDER BY list_inner_product(v, e) DESC, vec_id LIMIT 10")
def vector_topk_dot(spark, sf_dir):
    return V.vector_search(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id", "dot").select("vec_id", F.round("exact_score", 6).alias("d"))


@query(f"{_Q}, h AS (SELECT vec_id, len(list_filter(list_zip(v, e), lambda p: (p[1] > 0) <> (p[2] > 0)))::INTEGER AS d FROM s) SELECT vec_id, d FROM h ORDER BY d, vec_id LIMIT 10")
def vector_hamming_topk(spark, sf_dir):
    return V.hamming_search(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id").select("vec_id", F.col("ann_distance").alias("d"))


@query(f"{_Q} SELECT vec_id FROM (SELECT vec_id, list_cosine_similarity(v, e) AS c, list_distance(v, e) AS d FROM s ORDER BY d, vec_id LIMIT 50) ORDER BY c DESC, vec_id LIMIT 5")
def vector_rerank(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    return V.rerank(V.vector_search(table(spark, sf_dir, "embeddings"), "embedding", q, 50, "vec_id", "l2"), "embedding", q, 5, "vec_id").select("vec_id")


@query()
def vector_ivf(spark, sf_dir):
    """Every row whose id is divisible by 20 against all rows, through an index; the tests measure its recall."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.IvfIndex(e, "embedding", "vec_id", cells=16).search_all(e.filter("vec_id % 20 = 0"), 10, probes=IVF_PROBES)


IVF_PROBES = 12


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS search_rank FROM p QUALIFY search_rank <= 10""")
def vector_exact_all(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = V.exact_search_all(e, e.filter("vec_id % 20 = 0"), "embedding", "vec_id", 10)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("search_rank").cast("bigint").alias("search_rank"))


@query("WITH t AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER AS token, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL), q AS (SELECT token, n FROM t WHERE doc_id = 3) SELECT t.doc_id, sum(t.n * q.n)::DOUBLE AS score FROM t JOIN q USING (token) GROUP BY t.doc_id ORDER BY score DESC, doc_id LIMIT 10")
def sparse_topk(spark, sf_dir):
    token = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.struct(token(w).alias("token"), F.lit(1.0).cast("float").alias("weight"))).alias("sparse"))
    q = V.sparse_vector(json.dumps([[r["token"], r["weight"]] for r in docs.filter("doc_id = 3").first()["sparse"]]))
    return V.sparse_search(docs, "sparse", q, 10, "doc_id").select("doc_id", F.col("sparse_score").alias("score"))


_SETS = "WITH s AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS m FROM documents), q AS (SELECT m AS qm FROM s WHERE doc_id = 3), j AS (SELECT doc_id, len(list_intersect(m, qm)) AS i, len(m) + len(qm) AS n FROM s, q)"


def _sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("m"))
    return docs, list(docs.filter("doc_id = 3").first()["m"])


@query(f"{_SETS} SELECT doc_id, round(i::DOUBLE / (n - i), 9) AS score FROM j ORDER BY i::DOUBLE / (n - i) DESC, doc_id LIMIT 10")
def jaccard_topk(spark, sf_dir):
    docs, q = _sets(spark, sf_dir)
    return V.jaccard_search(docs, "m", q, 10, "doc_id").select("doc_id", F.round("exact_jaccard", 9).alias("score"))


@query()
def minhash_candidates(spark, sf_dir):
    """Every document whose id is divisible by 20 against all documents: its 20 most similar of a similarity of 0.5 and more."""
    docs = members(_sets(spark, sf_dir)[0])
    return V.minhash_search_all(docs, docs.filter("doc_id % 20 = 0"), "m", "doc_id", 20, 0.5)


def members(docs):
    """Word sets as arrays of canonical JSON members."""
    return docs.select("doc_id", F.transform("m", lambda w: F.regexp_extract(F.to_json(F.struct(w.alias("v"))), r'^\{"v":(.*)\}$', 1)).alias("m"))


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 100),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders QUALIFY r <= 100),
f AS (SELECT id, sum(w / (60.0::DOUBLE + r)) AS s FROM (SELECT id, r, 1.0::DOUBLE AS w FROM a UNION ALL SELECT id, r, 2.0::DOUBLE FROM b) GROUP BY id)
SELECT id AS o_orderkey, round(s, 12) AS score FROM f ORDER BY s DESC, id LIMIT 20""")
def hybrid_rrf(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    lists = [V.Retriever("price", V.top(orders, F.col("o_totalprice"), 100, "o_orderkey", "s")), V.Retriever("late", V.top(orders, F.col("o_orderdate"), 100, "o_orderkey", "s"), 2.0)]
    return V.fuse(lists, "o_orderkey", 20).select("o_orderkey", F.round("fused_score", 12).alias("score"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(ws, lambda x: x = 'and'))::DOUBLE AS b FROM w)
SELECT doc_id, round(b * 2.2 / (b + 1.2) + 2 * a * 2.2 / (a + 1.2), 9) AS r FROM c""")
def fts_rank(spark, sf_dir):
    from tessera.functions.strings import fts_rank as rank

    return table(spark, sf_dir, "documents").select("doc_id", F.round(rank(F.col("text"), "the and The"), 9).alias("r"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'idiot')) AS a, len(list_filter(ws, lambda x: x = 'clown')) AS b, len(list_filter(ws, lambda x: x = 'moron')) AS m FROM w)
SELECT doc_id, (a + b)::DOUBLE AS rank FROM c WHERE a > 0 AND b > 0 AND m = 0""")
def fts_match(spark, sf_dir):
    return T.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "idiot clown -moron").select("doc_id", "rank")


_RECT = "SELECT o_orderkey AS id, o_custkey % 100 * 1.0 AS x0, o_custkey % 100 + o_orderkey % 4 * 1.0 AS x1, o_orderkey % 90 * 1.0 AS y0, o_orderkey % 90 + o_custkey % 3 * 1.0 AS y1 FROM orders"


@query(f"SELECT id FROM ({_RECT}) WHERE x0 <= 12 AND x1 >= 10 AND y0 <= 33 AND y1 >= 30")
def rtree_intersects(spark, sf_dir):
    r = on_tables(spark, sf_dir, _RECT)
    box = tuple(F.lit(float(v)) for v in (10, 12, 30, 33))
    return r.filter(T.rtree_intersects(tuple(F.col(c) for c in ("x0", "x1", "y0", "y1")), box)).select("id")


@query()  # its SQL joins by inequalities alone, too slow on whole tables; the tests hold it against brute force
def rectangle_join(spark, sf_dir):
    r = on_tables(spark, sf_dir, _RECT)
    return T.rectangle_join(r, r, ("x0", "x1", "y0", "y1"), 5.0, "id", "id")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r AS (SELECT 0 AS id UNION SELECT e.b FROM e JOIN r ON e.a = r.id) SELECT id FROM r")
def recursive_union(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    seed = edges.filter("a = 0").select(F.col("a").alias("id"))
    return R.recursive(seed, lambda fresh: edges.join(fresh, edges["a"] == fresh["id"]).select(F.col("b").alias("id")))


@query()
def approx_agg(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    made = [(kind, *R.approx_aggregate(li, kind, c, "k", F.col("l_returnflag") == "R").__dict__.values()) for kind, c in (("count", None), ("sum", "l_quantity"), ("avg", "l_quantity"))]
    return spark.createDataFrame(made, "kind string, point double, low double, high double, n_population long, n_sample long, n_passing long")


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 30 AND p_name LIKE '%a%' AND p_brand LIKE 'Brand%' ORDER BY p_partkey LIMIT 40 OFFSET 5")
def query_builder(spark, sf_dir):
    q = Query(columns=("p_partkey", "p_name"), limit=40, offset=5, order=("p_partkey",)).where(between("p_size", 5, 30), contains("p_name", "a"), prefix("p_brand", "Brand"))
    return q.run(table(spark, sf_dir, "part"))


@query("SELECT count(*)::BIGINT AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def query_exact(spark, sf_dir):
    return Query().where(eq("o_orderstatus", "F"), is_in("o_orderpriority", ["1-URGENT", "2-HIGH"])).exact(table(spark, sf_dir, "orders"), "count")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 25")
def keyset_page(spark, sf_dir):
    df, out, cursor = table(spark, sf_dir, "customer").withColumn("_row_id", F.col("c_custkey")), [], None
    for size in (10, 15):
        request = {"conditions": [{"kind": "eq", "column": "c_mktsegment", "value": "BUILDING"}], "projection": ["c_custkey"], "limit": size} | ({"cursor": cursor} if cursor else {})
        rows, cursor = page(df, request, b"secret")
        out += rows
    return spark.createDataFrame([(r["c_custkey"],) for r in out], "c_custkey long")


def _store(spark, sf_dir) -> Session:
    shared = spark.conf.get("spark.checkpoint.dir", None)  # a temporary folder only where no shared one is named
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster names its shared folder in spark.checkpoint.dir")
    s = Session(spark, f"{shared.rstrip('/')}/tessera-store-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tessera-store-"))
    s.sql("CREATE TABLE o (k BIGINT PRIMARY KEY, cust BIGINT NOT NULL, status TEXT NOT NULL, cents BIGINT NOT NULL)")
    s.store.insert("o", table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS cust", "o_orderstatus AS status", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents"))
    s.store.commit()
    return s


_O = "SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"


@query(f"SELECT k, cust, CASE WHEN k % 2 = 0 THEN 'X' ELSE status END AS status, CASE WHEN k % 2 = 0 THEN cents + 1 ELSE cents END AS cents FROM ({_O}) WHERE k % 5 <> 0 UNION ALL SELECT -5, 1, 'N', 7")
def store_upsert_delete(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.sql("INSERT INTO o SELECT k, cust, status, 1 AS cents FROM o WHERE k % 2 = 0 ON CONFLICT (k) DO UPDATE SET cents = cents + excluded.cents, status = 'X'; DELETE FROM o WHERE k % 5 = 0; INSERT INTO o VALUES (-5, 1, 'N', 7)")
    return s.sql("SELECT * FROM o")


@query(_O)
def store_as_of(spark, sf_dir):
    s = _store(spark, sf_dir)
    epoch = s.store.epoch
    s.sql("UPDATE o SET status = 'Z'; DELETE FROM o WHERE k < 100")
    return s.sql(f"SELECT * FROM o AS OF EPOCH {epoch}")


@query(f"SELECT cust, count(*) AS n, sum(cents)::BIGINT AS total FROM ({_O}) WHERE k % 3 <> 0 GROUP BY cust")
def mv_incremental(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.sql("CREATE MATERIALIZED VIEW m AS SELECT cust, count(*) AS n, sum(cents) AS total FROM o GROUP BY cust; DELETE FROM o WHERE k % 3 = 0")
    if s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] != "incremental":
        raise RuntimeError("the view was refreshed in full")
    return s.sql("SELECT cust, n, total FROM m")


@query(f"SELECT 'insert' AS op, count(*) AS n FROM ({_O}) UNION ALL SELECT 'delete', count(*) FROM ({_O}) WHERE k % 4 = 0")
def change_stream(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.sql("DELETE FROM o WHERE k % 4 = 0")
    out = f"{s.store.path}-changes"  # files: a memory sink would gather all changes on the driver
    q = s.store.change_stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("op").agg(F.count("*").alias("n"))


@query(f"SELECT k, cents FROM ({_O}) WHERE status = 'P' UNION ALL SELECT k, -1 FROM ({_O}) WHERE status = 'F'")
def store_triggers(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.sql("CREATE TABLE audit (k BIGINT PRIMARY KEY, cents BIGINT); CREATE TRIGGER gone AFTER DELETE ON o WHEN OLD.status = 'P' BEGIN INSERT INTO audit VALUES (OLD.k, OLD.cents); END")
    s.sql("CREATE TRIGGER moved AFTER UPDATE OF status ON o BEGIN INSERT INTO audit VALUES (NEW.k, -1); END; DELETE FROM o WHERE status = 'P'; UPDATE o SET status = 'G' WHERE status = 'F'; UPDATE o SET cents = 0 WHERE status = 'G'")
    return s.sql("SELECT k, cents FROM audit")


@query(f"SELECT k, NULL::BIGINT AS cust, sha256(status) AS status, cents FROM ({_O}) WHERE cents % 7 = 3")
def store_policies(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.sql("ALTER TABLE o ENABLE ROW LEVEL SECURITY; CREATE POLICY few ON o FOR SELECT TO PUBLIC USING (cents % 7 = 3 AND CURRENT_USER = 'ann'); CREATE MASK c ON o (cust) USING NULL; CREATE MASK t ON o (status) USING SHA256")
    return Session(spark, s.store.path, principal="ann").sql("SELECT k, cust, status, cents FROM o")
