"""The opN_ queries and the pipeline against their SQL on the smallest tables; the native ones run no Python."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, same

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm.queries import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    same(queries()[name](spark, SF), connection(SF), oracle_sql()[name])


def test_pipeline(spark):
    same(corpus_pipeline.run(spark, SF), connection(SF), corpus_pipeline.ORACLE_SQL)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "mixing"]


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_decontamination"])
def test_native(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, rows without an id, clashing names; then no rows at all."""
    good = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"term{i}" for i in range(80))
    leak = " ".join(f"leak{i}" for i in range(20))
    line = "this very line stands in many documents of this table"
    rows = [(1, good, "en", "a", 1), (2, good + " more", None, "a", None), (3, None, "en", None, 0), (4, "", "en", "b", 0), (5, "short", "en", "b", 5)]
    rows += [(6, f"{other}\n{line}", "en", "b", 9), (7, f"{' '.join(f'x{i}' for i in range(90))}\n{line}", "en", "b", 9), (8, f"{' '.join(f'y{i}' for i in range(90))}\n{line}", "en", "b", 9)]
    rows += [(9, f"{' '.join(f'z{i}' for i in range(100))} {leak}", "en", "c", 9), (10, " ".join(f"v{i}" for i in range(30_000)), "en", "c", 9), (11, " ".join(f"u{i}" for i in range(70)), "en", "c", 9), (11, " ".join(f"u{i}" for i in range(70)), "en", "c", 9)]
    rows += [(None, " ".join(f"t{i}" for i in range(70)), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit("c")).withColumn("_gone", F.lit("g")).withColumn("n_words", F.lit(2))
    spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {"quality_rules": [0, 1, 2, 6, 7, 8, 9, 10, 11, 11], "line_dedup": [0, 1, 2, 6, 7, 8, 9, 10, 11, 11], "ngram_join": [0, 1, 6, 7, 8, 9, 10, 11, 11], "decontamination": [0, 1, 6, 7, 8, 10, 11, 11]}
    now, none = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now, none = stage(spark, now, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert none.collect() == []
        if name in ids:
            assert now.columns == docs.columns and sorted(r["doc_id"] or 0 for r in now.collect()) == ids[name], name
        if name == "line_dedup":
            kept = {r["doc_id"]: r for r in now.collect()}
            assert line not in kept[6]["text"] and line not in kept[7]["text"] and line in kept[8]["text"] and kept[6]["n_chars"] == len(kept[6]["text"])
    assert now.columns == [*docs.columns, "epoch", "block_order", "doc_order"]
    assert {r["doc_id"] or 0 for r in now.filter("epoch = 0").collect()} == {0, 1, 6, 7, 8, 10, 11} and now.filter("doc_id = 11 AND epoch = 0").count() == 2


def test_pipeline_leaves_its_last_table_alone(spark, tmp_path):
    from tessera.llm.common import shared_dir

    home = f"{shared_dir(spark)}/tessera"
    before = set(os.listdir(home)) if os.path.isdir(home) else set()
    rows = corpus_pipeline.run(spark, SF).count()
    left = set(os.listdir(home)) - before
    assert rows > 0 and len(left) == 1 and next(iter(left)).startswith("stage-mixing")


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They go with the write, whether or not the driver collects its garbage; settings are as they were."""
    from tessera.llm.common import CLEANUP, materialize

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for top in folders for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    earlier, settings = files(), {n: spark.conf.get(n) for n in CLEANUP}
    docs = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(map(tuple, materialize(docs, "counts").collect())) == [(k, 715 if k < 2 else 714) for k in range(7)]
    end = time.monotonic() + 10  # files are removed beside the job
    while files() - earlier and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - earlier and {n: spark.conf.get(n) for n in CLEANUP} == settings
