"""Retrieval, text and sampling operators against brute force and golden values."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import retrieval as V
from tessera.operators import text as T
from tessera.operators.conditions import page
from tessera.sources import io
from tessera.sources.store import Files

SF = "/root/testdata/sf0.001"

#: Fixed values of the member hash.
GOLDEN = {'"1"': 4601219942126179299, '"雪"': 1583573578914089563, "1": 6001628596940409521, "1.5": 2954746858305776003, "true": 16169524375275942869, "false": 8386526569404862294}


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(1)
    return spark.createDataFrame([(i, [float(x) for x in rnd.standard_normal(8)]) for i in range(200)], "id long, v array<float>").cache()


def test_vectors_against_numpy(spark, vectors):
    rows = {r["id"]: np.array(r["v"], dtype=np.float64) for r in vectors.collect()}
    q = [0.3, -1.0, 0.2, 0.9, 0.0, -0.4, 1.1, 0.5]
    for metric, key in (("l2", lambda v: np.linalg.norm(v - q)), ("dot", lambda v: -v @ q), ("cosine", lambda v: -v @ q / np.linalg.norm(v))):
        got = [r["id"] for r in V.vector_search(vectors, "v", q, 7, "id", metric).orderBy("search_rank").collect()]
        assert got == sorted(rows, key=lambda i: (key(rows[i]), i))[:7]
    got = [(r["id"], r["ann_distance"]) for r in V.hamming_search(vectors, "v", q, 5, "id").orderBy("search_rank").collect()]
    away = {i: int(((v > 0) != (np.array(q) > 0)).sum()) for i, v in rows.items()}
    assert got == sorted(away.items(), key=lambda x: (x[1], x[0]))[:5]
    with pytest.raises(Exception, match="dimension"):
        V.vector_search(vectors, "v", [1.0, 2.0], 3, "id").collect()
    ivf = V.IvfIndex(vectors, "v", "id", cells=8)
    exact = {r["id"] for r in V.vector_search(vectors, "v", q, 10, "id", "l2").collect()}
    assert {r["id"] for r in ivf.search(q, 10, probes=8).collect()} == exact
    assert len({r["id"] for r in ivf.search(q, 10, probes=4).collect()} & exact) >= 5
    assert vectors.select(V.sign_bits(F.col("v")).alias("b"), "v").first()["b"][0] == sum(1 << i for i, x in enumerate(rows[0]) if x > 0)


def test_sets_and_minhash(spark):
    assert {m: V.member_hash(m) for m in GOLDEN} == GOLDEN
    assert V.set_members('["b", 1, "a", "a", true]') == ['"a"', '"b"', "1", "true"]
    assert V.sparse_vector("[[2, 1.5], [1, 1], [2, 0.5]]") == [(1, 1.0), (2, 2.0)]
    rnd = random.Random(2)
    sets = [sorted({f'"{rnd.randrange(60)}"' for _ in range(30)}) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, m array<string>")
    q = sets[3][:-1]
    want = sorted(((len(set(q) & set(s)) / len(set(q) | set(s)), -i) for i, s in enumerate(sets)), reverse=True)[:5]
    got = [(r["exact_jaccard"], -r["id"]) for r in V.jaccard_search(df, "m", q, 5, "id").orderBy("search_rank").collect()]
    assert got == want
    near = V.set_similarity(df, "m", q, 50, 0.9, 5, "id").collect()
    assert [r["id"] for r in near] == [3] and abs(near[0]["estimated_jaccard"] - near[0]["exact_jaccard"]) < 0.15
    assert V.set_similarity(df, "m", [], 50, 0.1, 5, "id").collect() == []


def test_sparse_and_fusion(spark):
    df = spark.createDataFrame([(1, [(1, 2.0), (5, 1.0)]), (2, [(1, 1.0)]), (3, [(9, 9.0)])], "id long, s array<struct<token: int, weight: float>>")
    assert [(r["id"], r["sparse_score"]) for r in V.sparse_search(df, "s", [(1, 3.0), (5, 1.0)], 5, "id").orderBy("search_rank").collect()] == [(1, 7.0), (2, 3.0)]
    with pytest.raises(ValueError):
        V.sparse_search(df, "s", [], 5, "id")
    a = V.Retriever("a", spark.createDataFrame([(1, 1), (2, 2), (2, 5)], "id long, search_rank int"))
    b = V.Retriever("b", spark.createDataFrame([(3, 1)], "id long, search_rank int"))
    one = [tuple(r)[:3] for r in V.fuse([a, b], "id", 5).orderBy("search_rank").collect()]
    assert one == [tuple(r)[:3] for r in V.fuse([b, a], "id", 5).orderBy("search_rank").collect()] == [(1, 1, 1 / 61), (3, 2, 1 / 61), (2, 3, 1 / 62)]
    with pytest.raises(ValueError):
        V.fuse([a, a], "id", 5)


def test_hybrid_filters_before_ranking(spark):
    rows = [(i, "x" if i > 1 else "y", [float(i), 1.0], [(1, float(i))]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "id long, kind string, v array<float>, s array<struct<token: int, weight: float>>")
    request = {"must": [{"kind": "eq", "column": "kind", "value": "x"}], "limit": 2, "projection": ["kind"], "retrievers": [{"name": "v", "kind": "ann", "column": "v", "query": [0.0, 1.0], "k": 1}, {"name": "s", "kind": "sparse", "column": "s", "query": [[1, 1.0]], "k": 1, "weight": 0.5}]}
    got = V.hybrid_search(df, request, "id").orderBy("search_rank").collect()
    assert [(r["id"], r["fused_score"]) for r in got] == [(2, 1 / 61), (5, 0.5 / 61)] and json.loads(got[0]["components"])[0]["name"] == "v"


def test_text_search(spark):
    texts = [(11, "Tidal mill by the old harbour"), (12, "A wind mill on the hill"), (13, "The harbour at low tide"), (14, None), (15, "mill mill stone")]
    df = spark.createDataFrame(texts, "id long, t string")
    ids = lambda q: sorted(r["id"] for r in T.search(df, "t", q, "id").collect())
    assert ids("mill") == [11, 12, 15] and ids("mill -wind") == [11, 15] and ids("tide OR hill") == [12, 13] and ids('"wind mill"') == [12] and ids("tid*") == [11, 13] and ids("NOT mill") == []
    assert [(r["id"], r["rank"]) for r in T.search(df, "t", "mill", "id").orderBy("search_rank").collect()] == [(15, 2.0), (11, 1.0), (12, 1.0)]
    row = T.search(df, "t", "harbour tidal", "id").first()
    assert (row["rank"], row["snippet"], row["highlight"]) == (2.0, "[Tidal] mill by the old ...", "<b>Tidal</b> mill by the old <b>harbour</b>")
    long = spark.createDataFrame([(1, "one two three four five mast six seven mast nine ten")], "id long, t string")
    assert T.search(long, "t", "mast", "id").first()["snippet"] == "... three four five [mast] six seven [mast] nine ..."


def test_rectangles(spark):
    rects = [(21, 0.0, 1.0, 0.0, 1.0), (22, 1.0, 3.5, 1.0, 2.0), (23, 7.0, 9.0, 0.5, 8.0), (24, 8.5, 8.6, 7.9, 8.4), (25, 0.0, None, 0.0, 1.0)]
    df = spark.createDataFrame(rects, "id long, a double, b double, c double, d double")
    box = tuple(map(F.lit, (3.0, 7.5, 1.5, 6.0)))
    assert sorted(r["id"] for r in df.filter(T.rtree_intersects(tuple(F.col(c) for c in "abcd"), box)).collect()) == [22, 23]
    whole = [r for r in rects if None not in r]
    want = sorted((p[0], q[0]) for p in whole for q in whole if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])
    for cell in (0.4, 1.0, 50.0):
        assert sorted(tuple(r) for r in T.rectangle_join(df, df, ("a", "b", "c", "d"), cell, "id", "id").collect()) == want


def test_recall_of_the_registered_indexes(spark):
    from tessera.plans.search import IVF_PROBES, members

    sf = SF.replace("0.001", "0.01")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    assert V.IvfIndex(e, "embedding", "vec_id", cells=16).recall(e.filter("vec_id % 20 = 0"), 10, IVF_PROBES) >= 0.9
    docs = members(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("m"))).cache()
    asked = docs.filter("doc_id % 5 = 0")
    found = {(r["query_id"], r["id"]): r["exact_jaccard"] for r in V.minhash_search_all(docs, asked, "m", "doc_id", 20, 0.5).collect()}
    rows = {r["doc_id"]: set(r["m"]) for r in docs.filter("m IS NOT NULL").collect()}
    want = {}
    for q in (i for i in rows if i % 5 == 0 and rows[i]):
        near = sorted(((len(rows[q] & rows[i]) / len(rows[q] | rows[i]), -i) for i in rows if i != q and rows[i]), reverse=True)
        want |= {(q, -i): s for s, i in near[:20] if s >= 0.5}
    assert len(want) > 20 and set(found) <= set(want) and len(found) >= 0.9 * len(want) and all(abs(found[k] - want[k]) < 1e-12 for k in found)


def test_copies_are_searched_once(spark):
    words = lambda i: [f'"{i // 50}-{j}"' for j in range(12)]
    df = spark.createDataFrame([(i, words(i)) for i in range(200)] + [(500, []), (501, None)], "id long, m array<string>")
    got = V.minhash_search_all(df, df.filter("id % 20 = 0"), "m", "id", 3, 0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["id"])
    assert {q: sorted(v) for q, v in by.items()} == {q: [i for i in range(q // 50 * 50, q // 50 * 50 + 50) if i != q][:3] for q in range(0, 200, 20)}


def test_stored_cells(spark, vectors, tmp_path):
    ix = V.IvfIndex(vectors, "v", "id", cells=8, path=str(tmp_path / "cells"))
    plan = ix.search([0.1] * 8, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_cell" in plan or "PartitionFilters: [_cell" in plan
    assert ix.recall(vectors.filter("id % 20 = 0"), 10, 8) == 1.0


def test_plans_evaluate_once(spark):
    from tessera.plans.registry import queries

    text = lambda n: queries()[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text("jaccard_topk").count("array_intersect(") == 1 and text("fts_rank").count("regexp_extract_all(") == 1
    assert "Join" not in text("sparse_topk") and "Join" not in text("join_asof")


def test_sampled_and_incremental_aggregates(spark, tmp_path):
    df = spark.range(20_000).select("id", (F.col("id") % 10).alias("c"), (F.col("id") * 2 + 1).alias("v"))
    e = R.approx_aggregate(df, "sum", "v", "id")
    true = sum(2 * i + 1 for i in range(20_000))
    assert e.low <= true <= e.high and abs(e.point - true) < 0.05 * true and e.n_sample == 8192
    small = R.approx_aggregate(df.filter("id < 1000"), "count", None, "id", F.col("c") == 3)
    assert (small.point, small.low, small.high) == (100.0, 100.0, 100.0)
    assert R.approx_aggregate(df, "count", None, "id").point == 20_000
    files = Files(spark, str(tmp_path))
    state = R.IncrementalAggregate(files)
    after = lambda e: spark.range(e + 1, 11).select("id")
    assert state.call(after, 10, 0, "id")["incremental"] is False
    later = R.IncrementalAggregate(files).call(lambda e: spark.range(e + 1, 21).select("id"), 20, 0, "id")
    assert (later["sum"], later["count"], later["incremental"], later["delta_rows"]) == (210, 21, True, 10)
    assert R.IncrementalAggregate(files).call(lambda e: spark.range(5).select("id"), 20, 1, "id")["incremental"] is False


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 10), (3, 1, 11), (4, 2, 9), (5, None, 9), (6, 1, None)], "id long, k long, t long")
    right = spark.createDataFrame([(1, 6, 60), (1, 10, 100), (1, 10, 101), (2, 10, 1), (None, 1, 7), (1, None, 8)], "k long, t long, v long")
    assert sorted(tuple(r) for r in R.asof_join(left, right, "k", "t", "t", "id", "v").collect()) == [(2, 101), (3, 101)]


@pytest.mark.parametrize("n", [0, 1, 7, 40_000])
def test_percentile_disc_of_a_table(spark, n):
    from tessera.functions.aggregates import percentile_disc_table

    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).otherwise("g").alias("g"), ((F.col("id") * 7919) % 9973).cast("double").alias("v"))
    for p in (0.0, 0.3, 0.5, 0.999, 1.0):
        got = {r["g"]: r["value"] for r in percentile_disc_table(df, "v", p, ["g"]).collect()}
        want = {}
        for g in (None, "g"):
            if own := sorted(float((i * 7919) % 9973) for i in range(n) if (i % 3 == 0) == (g is None)):
                want[g] = own[int(p * (len(own) - 1))]
        assert got == want


def test_series_recursion_and_pages(spark):
    assert [r[0] for r in R.series(spark, 5, 1, -2).collect()] == [5, 3, 1] and R.series(spark, 5, 1).count() == 0 and R.series(spark, 3).count() == 4
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    seed = spark.createDataFrame([(1,)], "id long")
    assert R.recursive(seed, lambda f: edges.join(f, edges["a"] == f["id"]).select("b")).count() == 3
    df = spark.range(1, 8).select(F.col("id").alias("_row_id"), (F.col("id") * 10).alias("v"))
    rows, cursor = page(df, {"limit": 4, "conditions": [{"kind": "range", "column": "v", "min": 20}]}, b"k")
    more, end = page(df, {"limit": 4, "conditions": [{"kind": "range", "column": "v", "min": 20}], "cursor": cursor}, b"k")
    assert [r["v"] for r in rows + more] == [20, 30, 40, 50, 60, 70] and end is None
    with pytest.raises(ValueError):
        page(df, {"cursor": cursor[:-1] + "0"}, b"k")


def test_tsv_modules_and_functions(spark, tmp_path):
    rows = [(1, "a\tb\\n"), (2, None), (3, "line\nend")]
    df = spark.createDataFrame(rows, "id long, s string")
    io.write_tsv(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in io.read_tsv(spark, str(tmp_path / "t"), "id long, s string").collect()) == rows
    io.register_module(spark, "squares", "n long, sq long", lambda options, part, parts: ((i, i * i) for i in range(part, int(options["upto"]), parts)), parts=3)
    assert spark.read.format("squares").option("upto", 10).load().filter("n > 7").count() == 2
    io.register_scalar(spark, "plus_one", lambda s: s + 1, "bigint")
    io.register_aggregate(spark, "spread", lambda v: float(v.max() - v.min()), "double")
    io.register_table_function(spark, "digits", lambda n: ((int(c),) for c in str(n)), "digit int")
    assert [r[0] for r in spark.sql("SELECT digit FROM digits(407)").collect()] == [4, 0, 7]
    assert spark.sql("SELECT id, digit FROM range(9, 12), LATERAL digits(id)").count() == 5
    windowed = spark.sql("SELECT id, spread(id) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM range(5)")
    assert [r["s"] for r in windowed.collect()] == [4.0] * 5
    told = tmp_path / "told"
    told.mkdir()

    def put(options, rows):
        n = 0
        with open(f"{options['folder']}/part-{next(iter(()), 0)}-{id(rows)}", "w") as f:
            for row in rows:
                f.write(f"{row[0]}\\n")
                n += 1
        return n

    def end(options, counts):
        with open(f"{options['folder']}/total", "w") as f:
            f.write(str(sum(counts)))

    io.register_module(spark, "lines_out", "n long", lambda options, part, parts: iter(()), write=put, commit=end)
    spark.range(25).withColumnRenamed("id", "n").write.format("lines_out").option("folder", str(told)).mode("append").save()
    assert (told / "total").read_text() == "25"
    io.bulk_load(spark.range(100), str(tmp_path / "bulk"), sort_by=["id"])
    assert spark.read.parquet(str(tmp_path / "bulk")).count() == 100 and sum(1 for _ in io.stream_rows(spark.range(10))) == 10 and io.to_arrow(spark.range(3)).num_rows == 3
    assert spark.sql("SELECT plus_one(id) AS v FROM range(3)").count() == 3 and spark.sql("SELECT spread(id) AS v FROM range(9)").first()[0] == 8.0


def test_fts_match_returns_more_rows_than_ranked_search(spark, tmp_path):
    from tessera.plans.registry import queries

    spark.range(10_050).selectExpr("id AS doc_id", "'Idiot clown' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries()["fts_match"](spark, str(tmp_path)).filter("rank = 2").count() == 10_050


def test_all_queries_meet_blocks_and_rows_without_a_vector_have_no_rank(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "QUERY_ROWS", 3)
    rows = [(i, [float(i % 7), float(i % 5), 0.5]) for i in range(60)] + [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = V.exact_search_all(df, df.filter("id % 10 = 0"), "v", "id", 4)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    whole = [(i, v) for i, v in rows if v and len(v) == 3 and None not in v]
    want = []
    for q, x in whole:
        if q % 10 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5, i) for i, y in whole)[:4]
            want += [(q, i, d, n + 1) for n, (d, i) in enumerate(near)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    index = V.IvfIndex(df.filter("id < 100"), "v", "id", cells=4)
    assert sorted(map(tuple, index.search_all(df.filter("id < 100 AND id % 10 = 0"), 4, probes=4).collect())) == sorted(want)


def test_less_join_makes_no_pair_that_the_runs_rule_out(spark):
    rnd = random.Random(4)
    left = [(rnd.choice("abc"), i, float(rnd.randrange(40))) for i in range(300)] + [(None, 900, 1.0), ("a", 901, None)]
    right = [(rnd.choice("abd"), i, float(rnd.randrange(-5, 45))) for i in range(200)] + [(None, 900, 50.0), ("a", 901, None)]
    a, b = spark.createDataFrame(left, "k string, i long, low double"), spark.createDataFrame(right, "k string, j long, high double")
    found = R.less_join(a, b, "k", "low", "high", room=16)
    want = sorted((i, j) for k, i, x in left for m, j, y in right if k == m and k and None not in (x, y) and x < y)
    assert sorted(map(tuple, found.select("i", "j").collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_run" in plan and R.less_join(a, b.withColumn("high", b["high"] - 900), "k", "low", "high").count() == 0


def test_equal_rectangles_meet_as_one_row(spark):
    rnd = random.Random(6)
    boxes = [(x, x + rnd.randrange(4), y, y + rnd.randrange(4)) for x, y in ((rnd.randrange(12), rnd.randrange(12)) for _ in range(12))]
    rows = [(i, *map(float, boxes[i % 12])) for i in range(150)] + [(None, *map(float, boxes[0]))]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double")
    found = T.rectangle_join(df, df, ("x0", "x1", "y0", "y1"), 5.0, "id", "id", most=4)
    want = [(a[0], b[0]) for a in rows for b in rows if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_bitmaps_rule_out_no_similar_pair(spark):
    rnd = random.Random(8)
    base = [json.dumps(f"w{i}") for i in range(400)]
    pairs = []
    for _ in range(60):
        a = set(rnd.sample(base, rnd.randrange(1, 120)))
        b = (a | set(rnd.sample(base, rnd.randrange(20)))) - set(rnd.sample(sorted(a), len(a) // rnd.randrange(2, 9)))
        pairs.append((sorted(a), sorted(b), len(a & b) / len(a | b)))
    pairs += [(sorted(rnd.sample(base, 100)), sorted(rnd.sample(base, 100)), 0.0) for _ in range(20)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>, s double")
    marked = df.select("s", F.size("a").alias("na"), F.size("b").alias("nb"), V.bitmaps(F.col("a")).alias("x"), V.bitmaps(F.col("b")).alias("y"))
    got = marked.select("s", V._may_reach(F.col("na"), F.col("x"), F.col("nb"), F.col("y"), 0.5).alias("may")).collect()
    assert all(r["may"] for r in got if r["s"] >= 0.5) and not any(r["may"] for r in got[60:])
