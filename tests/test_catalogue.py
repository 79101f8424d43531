"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.plans.registry import oracle_sql, queries
from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, con, name):
    same(queries()[name](spark, SF), con, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(queries()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push(spark):
    plan = queries()["filter_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
    assert "Python" not in queries()["vector_topk_l2"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rectangle_join_of_whole_tables(spark):
    from tessera.plans.relational import on_tables
    from tessera.plans.search import _RECT

    r = [tuple(map(float, x)) for x in on_tables(spark, SF, _RECT).select("id", "x0", "x1", "y0", "y1").collect()]
    want = sorted((int(a[0]), int(b[0])) for a in r for b in r if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4])
    assert sorted(tuple(x) for x in queries()["rectangle_join"](spark, SF).collect()) == want


@pytest.mark.parametrize("name", ["store_upsert_delete", "store_as_of", "mv_incremental", "change_stream"])
def test_store_queries_of_whole_tables_have_no_id_bound(spark, tmp_path, name):
    for t in os.listdir(SF):
        os.symlink(f"{SF}/{t}", tmp_path / t)
    os.remove(tmp_path / "orders.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 100_000).write.parquet(str(tmp_path / "orders.parquet"))
    con = connection(SF)
    con.execute("CREATE OR REPLACE VIEW orders AS SELECT * FROM read_parquet('" + str(tmp_path / "orders.parquet") + "/*.parquet')")
    same(queries()[name](spark, str(tmp_path)), con, oracle_sql()[name])


@pytest.mark.parametrize(("name", "source"), [("math_basic", "lineitem"), ("project_computed", "lineitem"), ("join_right", "customer"), ("join_full", "customer"), ("window_rank", "orders")])
def test_whole_queries_keep_every_row(spark, name, source):
    rows = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert queries()[name](spark, SF).count() >= rows
