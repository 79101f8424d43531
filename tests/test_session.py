"""The SQL session and its store: DDL, DML, constraints, transactions, time travel, views, changes."""

import pytest
from pyspark.sql import functions as F

from tessera.session import Session, rewrite, split_statements
from tessera.sources.store import ConflictError, ConstraintError, Store, StoreError, ttl_nanos


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "db"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_and_rewrite():
    assert split_statements("a; b ';' ; -- x;\n c; $$d;e$$;") == ["a", "b ';'", "c", "$$d;e$$"]
    assert split_statements("create trigger t after insert on a begin select 1; select case when 1 then 2 end; end; select 2")[1] == "select 2"
    assert rewrite("select group_concat(x), max(a), 'max(1,2)'") == "select string_agg(x, ','), max(a), 'max(1,2)'"
    assert "greatest(a, b)" in rewrite("max(a, b)") and rewrite("total(x)") == "coalesce(CAST(sum(x) AS DOUBLE), 0.0D)"


def test_insert_update_delete_and_time_travel(s):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v BIGINT, s TEXT DEFAULT 'x')")
    s.sql("INSERT INTO t (id, v) VALUES (1, 10), (2, 20); INSERT INTO t VALUES (3, 30, 'y')")
    before = s.store.epoch
    s.sql("UPDATE t SET v = v + 1 WHERE id >= 2; DELETE FROM t WHERE id = 1")
    assert rows(s.sql("SELECT * FROM t")) == [(2, 21, "x"), (3, 31, "y")]
    assert rows(s.sql(f"SELECT id, v FROM t AS OF EPOCH {before}")) == [(1, 10), (2, 20), (3, 30)]
    with pytest.raises(StoreError, match="future"):
        s.sql("SELECT * FROM t AS OF EPOCH 99")
    s.sql("INSERT INTO t VALUES (2, 5, 'n'), (4, 40, 'n') ON CONFLICT (id) DO NOTHING")
    s.sql("INSERT INTO t VALUES (2, 5, 'z'), (5, 50, 'z') ON CONFLICT (id) DO UPDATE SET v = v + excluded.v")
    assert rows(s.sql("SELECT * FROM t")) == [(2, 26, "x"), (3, 31, "y"), (4, 40, "n"), (5, 50, "z")]
    s.sql("DELETE FROM t ORDER BY v DESC LIMIT 1")
    assert s.changes() == 1 and rows(s.sql("SELECT id FROM t")) == [(2,), (3,), (4,)]
    s.sql("COMPACT t")
    assert rows(s.sql("SELECT id FROM t")) == [(2,), (3,), (4,)]
    s.sql("TRUNCATE t")
    assert rows(s.sql("SELECT id FROM t")) == []


def test_constraints(s):
    s.sql("CREATE TABLE p (id BIGINT PRIMARY KEY, price BIGINT CHECK (price >= 0), q BIGINT, kind ENUM('a','b'), CHECK (price * q <= 1000))")
    s.sql("INSERT INTO p VALUES (1, 10, 20, 'a'), (2, 5, NULL, NULL)")
    for bad in ("(3, -1, 1, 'a')", "(4, 100, 20, 'a')", "(5, 1, 1, 'c')", "(1, 1, 1, 'a')", "(NULL, 1, 1, 'a')"):
        with pytest.raises(ConstraintError):
            s.sql(f"INSERT INTO p VALUES {bad}")
    s.sql("CREATE TABLE c (id BIGINT PRIMARY KEY, p BIGINT REFERENCES p (id) ON DELETE CASCADE); CREATE TABLE d (id BIGINT PRIMARY KEY, p BIGINT REFERENCES p (id) ON DELETE SET NULL)")
    s.sql("INSERT INTO c VALUES (1, 1), (2, 2); INSERT INTO d VALUES (1, 1), (2, NULL)")
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO c VALUES (3, 9)")
    s.sql("DELETE FROM p WHERE id = 1")
    assert rows(s.sql("SELECT * FROM p")) == [(2, 5, None, None)]
    assert rows(s.sql("SELECT * FROM c")) == [(2, 2)] and [tuple(r) for r in s.sql("SELECT * FROM d ORDER BY id").collect()] == [(1, None), (2, None)]


def test_transactions_and_conflicts(s, spark):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    s.sql("BEGIN; INSERT INTO t VALUES (1); SAVEPOINT a; INSERT INTO t VALUES (2); ROLLBACK TO a; INSERT INTO t VALUES (3)")
    assert rows(s.sql("SELECT * FROM t")) == [(1,), (3,)]
    other = Store(spark, s.store.path)
    assert rows(other.read("t")) == []
    s.sql("COMMIT")
    other.insert("t", spark.createDataFrame([(9,)], "id long"))
    with pytest.raises(ConflictError):
        other.commit()
    s.sql("BEGIN; DELETE FROM t; ROLLBACK")
    assert rows(s.sql("SELECT * FROM t")) == [(1,), (3,)]


def test_views_recursion_prepared_and_procedures(s):
    s.sql("CREATE TABLE tree (id BIGINT PRIMARY KEY, parent BIGINT, amount DOUBLE); INSERT INTO tree VALUES (1, NULL, 10), (2, 1, 20), (3, 2, 30), (4, 2, 40)")
    q = "WITH RECURSIVE r (id) AS (SELECT id FROM tree WHERE parent IS NULL UNION SELECT t.id FROM tree t JOIN r ON t.parent = r.id) SELECT id FROM r"
    assert rows(s.sql(q)) == [(1,), (2,), (3,), (4,)]
    s.sql("CREATE VIEW big AS SELECT id FROM tree WHERE amount > 15")
    assert rows(s.sql("SELECT * FROM big")) == [(2,), (3,), (4,)]
    s.sql("PREPARE p AS SELECT id FROM tree WHERE id > ? AND amount < ?")
    assert rows(s.sql("EXECUTE p (1, 35)")) == [(2,), (3,)]
    s.sql("""CREATE PROCEDURE add AS '{"params": ["k"], "steps": [{"kind": "put", "table": "tree", "row": {"id": ":k", "parent": "1", "amount": "5.0"}}, {"kind": "query", "sql": "SELECT count(*) AS n FROM tree"}]}'""")
    assert rows(s.sql("CALL add(7)")) == [(5,)]
    s.sql("CREATE TABLE copy AS SELECT id, amount FROM tree")
    assert s.sql("SELECT count(*) AS n FROM copy").first()[0] == 5
    assert [r["name"] for r in s.sql("PRAGMA table_info(tree)").collect()] == ["id", "parent", "amount"]
    assert s.sql("EXPLAIN QUERY PLAN SELECT * FROM tree").count() > 0


def test_incremental_view_and_changes(s):
    s.sql("CREATE TABLE trips (trip BIGINT PRIMARY KEY, harbour TEXT NOT NULL, crates BIGINT NOT NULL)")
    s.sql("INSERT INTO trips VALUES (10, 'oslo', 4), (11, 'riga', 9), (12, 'riga', 2), (13, 'oslo', 1)")
    s.sql("CREATE MATERIALIZED VIEW m AS SELECT harbour, count(*) AS n, sum(crates) AS total FROM trips GROUP BY harbour")
    assert rows(s.sql("SELECT * FROM m")) == [("oslo", 2, 5), ("riga", 2, 11)]
    s.sql("INSERT INTO trips VALUES (14, 'turku', 6); DELETE FROM trips WHERE trip IN (10, 13, 12)")
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "incremental"
    assert rows(s.sql("SELECT * FROM m")) == [("riga", 1, 9), ("turku", 1, 6)]
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "incremental"
    assert rows(s.sql("SELECT * FROM m")) == [("riga", 1, 9), ("turku", 1, 6)]
    s.sql("UPDATE trips SET crates = 8 WHERE trip = 11")
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "full"
    assert rows(s.sql("SELECT * FROM m")) == [("riga", 1, 8), ("turku", 1, 6)]
    events = s.store.changes().filter("table = 'trips'").orderBy("epoch", "step", "row_id").collect()
    assert [e["op"] for e in events] == ["insert"] * 5 + ["delete"] * 3 + ["update"]
    s.sql("TRUNCATE trips; INSERT INTO trips VALUES (20, 'ghent', 3)")
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "full" and rows(s.sql("SELECT * FROM m")) == [("ghent", 1, 3)]
    assert "truncate" in {e["op"] for e in s.store.changes().collect()}
    s.store.trim_changes(2)
    s.store.commit()
    with pytest.raises(StoreError, match="no longer retained"):
        s.store.changes(1)


def test_view_made_in_the_transaction_of_its_rows(s):
    s.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, g TEXT NOT NULL)")
    s.sql("BEGIN; INSERT INTO t VALUES (1, 'a'); CREATE MATERIALIZED VIEW m AS SELECT g, count(*) AS n FROM t GROUP BY g; INSERT INTO t VALUES (2, 'b'); COMMIT")
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "incremental"
    assert rows(s.sql("SELECT * FROM m")) == [("a", 1), ("b", 1)]


def test_views_over_nulls_are_refreshed_in_full(s):
    s.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, g TEXT, v BIGINT); INSERT INTO t VALUES (1, NULL, NULL), (2, 'a', NULL), (3, 'a', NULL), (4, 'b', 5)")
    s.sql("CREATE MATERIALIZED VIEW m AS SELECT g, count(*) AS n, sum(v) AS total FROM t GROUP BY g")
    key = lambda r: str(r)
    assert sorted(map(tuple, s.sql("SELECT * FROM m").collect()), key=key) == sorted([(None, 1, None), ("a", 2, None), ("b", 1, 5)], key=key)
    s.sql("DELETE FROM t WHERE k = 3")
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "full"
    assert sorted(map(tuple, s.sql("SELECT * FROM m").collect()), key=key) == sorted([(None, 1, None), ("a", 1, None), ("b", 1, 5)], key=key)


def test_set_null_tells_of_its_rows(s):
    s.sql("CREATE TABLE p (id BIGINT PRIMARY KEY); CREATE TABLE c (id BIGINT PRIMARY KEY, p BIGINT REFERENCES p (id) ON DELETE SET NULL)")
    s.sql("INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (7, 1), (8, 2)")
    s.sql("DELETE FROM p WHERE id = 2")
    assert [(e["op"], e["row"]) for e in s.store.changes().filter("table = 'c' AND op <> 'insert'").collect()] == [("update", '{"id":8,"p":null}')]


def test_triggers_of_rows(s):
    s.sql("CREATE TABLE stock (item BIGINT PRIMARY KEY, pieces BIGINT, shelf TEXT); CREATE TABLE moves (id BIGINT AUTO_INCREMENT, item BIGINT, was BIGINT, now BIGINT); CREATE TABLE sums (shelf TEXT PRIMARY KEY, pieces BIGINT)")
    s.sql("INSERT INTO sums VALUES ('x', 0), ('y', 0)")
    s.sql("CREATE TRIGGER a AFTER INSERT ON stock FOR EACH ROW WHEN NEW.pieces > 1 BEGIN INSERT INTO moves (item, was, now) VALUES (NEW.item, 0, NEW.pieces); UPDATE sums SET pieces = pieces + NEW.pieces WHERE shelf = NEW.shelf; END")
    s.sql("CREATE TRIGGER b AFTER UPDATE OF pieces ON stock BEGIN INSERT INTO moves (item, was, now) VALUES (OLD.item, OLD.pieces, NEW.pieces); END")
    s.sql("CREATE TRIGGER c BEFORE DELETE ON stock BEGIN SELECT RAISE(ABORT, 'not empty') WHERE OLD.pieces > 100; DELETE FROM sums WHERE shelf = OLD.shelf; END")
    s.sql("INSERT INTO stock VALUES (1, 5, 'x'), (2, 7, 'x'), (3, 1, 'y'), (4, 200, 'y')")
    assert rows(s.sql("SELECT item, was, now FROM moves")) == [(1, 0, 5), (2, 0, 7), (4, 0, 200)]
    assert rows(s.sql("SELECT * FROM sums")) == [("x", 12), ("y", 200)]
    s.sql("UPDATE stock SET shelf = 'x' WHERE item = 3")
    assert s.sql("SELECT count(*) AS n FROM moves").first()[0] == 3
    s.sql("UPDATE stock SET pieces = pieces - 1 WHERE item < 3")
    assert rows(s.sql("SELECT item, was, now FROM moves WHERE was > 0")) == [(1, 5, 4), (2, 7, 6)]
    with pytest.raises(StoreError, match="not empty"):
        s.sql("DELETE FROM stock")
    assert s.sql("SELECT count(*) AS n FROM stock").first()[0] == 4 and s.sql("SELECT count(*) AS n FROM sums").first()[0] == 2
    s.sql("DELETE FROM stock WHERE item = 1")
    assert rows(s.sql("SELECT shelf FROM sums")) == [("y",)]
    s.sql("CREATE VIEW low AS SELECT item, pieces FROM stock WHERE pieces < 10; CREATE TRIGGER d INSTEAD OF INSERT ON low BEGIN INSERT INTO stock VALUES (NEW.item, NEW.pieces, 'z'); END")
    s.sql("INSERT INTO low VALUES (9, 2)")
    assert rows(s.sql("SELECT shelf FROM stock WHERE item = 9")) == [("z",)]
    s.sql("DROP VIEW low")
    assert [r[0] for r in s.sql("SHOW TRIGGERS").collect()] == ["a", "b", "c"]
    s.sql("CREATE TRIGGER e AFTER INSERT ON moves BEGIN INSERT INTO moves (item) VALUES (NEW.item); END")
    with pytest.raises(StoreError, match="deeper"):
        s.sql("INSERT INTO moves (item) VALUES (1)")


def test_rules_follow_a_renamed_table(s, spark):
    s.sql("CREATE TABLE a (id BIGINT PRIMARY KEY, who TEXT); CREATE TABLE log (id BIGINT); CREATE TRIGGER t AFTER INSERT ON a BEGIN INSERT INTO log VALUES (NEW.id); END")
    s.sql("ALTER TABLE a ENABLE ROW LEVEL SECURITY; CREATE POLICY p ON a USING (who = CURRENT_USER); ALTER TABLE a RENAME TO b; INSERT INTO b VALUES (1, 'kim'), (2, 'lee')")
    assert rows(s.sql("SELECT id FROM log")) == [(1,), (2,)]
    kim = Session(spark, s.store.path, principal="kim")
    assert rows(kim.sql("SELECT id, CURRENT_USER AS me FROM b")) == [(1, "kim")]
    with pytest.raises(StoreError, match="exists"):
        s.sql("ALTER TABLE log RENAME TO b")


def test_views_of_spark_are_not_cached(spark):
    plain = Session(spark)
    for n in (1, 2):
        spark.range(n).createOrReplaceTempView("tessera_moving")
        assert plain.sql("SELECT count(*) AS n FROM tessera_moving").first()[0] == n


def test_ddl(s):
    s.sql("CREATE TABLE audit (id BIGINT AUTO_INCREMENT, note TEXT); INSERT INTO audit (note) VALUES ('one'), ('two')")
    s.sql("ALTER TABLE audit ADD COLUMN extra BIGINT; ALTER TABLE audit RENAME COLUMN note TO words; ALTER TABLE audit RENAME TO log")
    assert rows(s.sql("SELECT words FROM log")) == [("one",), ("two",)] and s.sql("SELECT extra FROM log").count() == 2
    s.sql("ALTER TABLE log ALTER COLUMN extra SET DEFAULT 7; INSERT INTO log (words) VALUES ('three')")
    assert rows(s.sql("SELECT extra FROM log WHERE words = 'three'")) == [(7,)]
    with pytest.raises(StoreError, match="holds nulls"):
        s.sql("ALTER TABLE log ALTER COLUMN extra SET NOT NULL")
    with pytest.raises(ConstraintError):
        s.sql("ALTER TABLE log ADD CONSTRAINT long CHECK (length(words) > 3)")
    s.sql("CREATE INDEX w ON log USING fm (words); DROP INDEX w")
    with pytest.raises(StoreError, match="no index"):
        s.sql("DROP INDEX w")
    assert rows(s.sql("SELECT table_name FROM information_schema.tables")) == [("log",)]
    assert s.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'log'").count() == 3
    assert s.sql("PRAGMA user_version = 5").first()[0] == 5 and s.sql("PRAGMA integrity_check").first()[0] == "ok"
    assert s.sql("PRAGMA function_list").filter("name = 'strftime'").count() == 1 and s.sql("PRAGMA nothing_known").count() == 0


def test_counters_queries_and_messages(s):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY); INSERT INTO t VALUES (1), (2), (3)")
    assert tuple(s.sql("SELECT changes(), total_changes(), last_insert_rowid() > 0").first()) == (3, 3, True)
    assert s.sql("SELECT id FROM t FOR UPDATE", query_id="q").count() == 3 and s.status("q")["state"] == "done"
    with pytest.raises(StoreError, match="not loaded"):
        s.sql("SELECT load_extension('x')")
    s.sql("LISTEN c; NOTIFY c, 'one'; NOTIFY c, 'two'")
    assert s.notifications("c") == ["one", "two"] and s.notifications("c") == []
    s.sql("UNLISTEN c; NOTIFY c, 'three'")
    assert s.notifications("c") == []
    first = s.sql("SELECT sum(id) AS n FROM t")
    assert s.sql("SELECT  sum(id) AS n FROM t") is first and first.is_cached
    s.sql("INSERT INTO t VALUES (4)")
    assert s.sql("SELECT sum(id) AS n FROM t").first()[0] == 10 and not first.is_cached


def test_batches_with_a_key_happen_once(s):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT)")
    steps = [{"op": "put", "table": "t", "rows": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]}, {"op": "upsert", "table": "t", "rows": [{"id": 2, "v": "c"}]}, {"op": "delete_by_pk", "table": "t", "key": 1}]
    first = s.store.batch(steps, "k1")
    assert first["changes"] == [2, 1, 1] and not first["replayed"]
    again = s.store.batch(steps, "k1")
    assert again["replayed"] and again["epoch"] == first["epoch"]
    assert rows(s.sql("SELECT * FROM t")) == [(2, "c")]


def test_runs_of_one_shape_are_one_scan_and_many_runs_are_compacted(s, monkeypatch):
    from tessera.sources import store as module

    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    for i in range(4):
        s.sql(f"INSERT INTO t VALUES ({i})")
    assert "Union" not in s.store.read("t")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(module, "MOST_RUNS", 3)
    s.sql("INSERT INTO t VALUES (9)")
    assert len(s.store.base["tables"]["t"]["runs"]) == 1 and rows(s.sql("SELECT id FROM t")) == [(0,), (1,), (2,), (3,), (9,)]


def test_security_in_sql(s, spark):
    s.sql("CREATE TABLE notes (id BIGINT PRIMARY KEY, writer TEXT, body TEXT, pay BIGINT); INSERT INTO notes VALUES (1, 'mia', 'hers', 5), (2, 'tom', 'his', 6), (3, 'tom', NULL, 7)")
    s.sql("ALTER TABLE notes ENABLE ROW LEVEL SECURITY; CREATE POLICY own ON notes FOR ALL TO PUBLIC USING (writer = CURRENT_USER) WITH CHECK (writer = CURRENT_USER)")
    s.sql("CREATE MASK hide ON notes (body) USING REDACT '###' EXCEPT mia; CREATE MASK pay ON notes (pay) USING NULL; CREATE VIEW all_notes AS SELECT id, body FROM notes")
    tom, mia = (Session(spark, s.store.path, principal=p) for p in ("tom", "mia"))
    assert rows(tom.sql("SELECT id, coalesce(body, '-'), coalesce(pay, -1) FROM notes")) == [(2, "###", -1), (3, "-", -1)]
    assert rows(mia.sql("SELECT * FROM all_notes")) == [(1, "hers")] and s.sql("SELECT count(*) AS n FROM notes").first()[0] == 3
    with pytest.raises(ConstraintError, match="policy"):
        tom.sql("INSERT INTO notes VALUES (4, 'mia', 'forged', 1)")
    tom.sql("INSERT INTO notes VALUES (4, 'tom', 'real', 1); DELETE FROM notes")
    s.store.refresh()
    assert rows(s.sql("SELECT id FROM notes")) == [(1,)]
    s.sql("DROP POLICY own ON notes; CREATE POLICY few ON notes AS RESTRICTIVE FOR SELECT USING (id > 5)")
    mia.store.refresh()
    assert rows(mia.sql("SELECT id FROM notes")) == []
    s.sql("ALTER TABLE notes DISABLE ROW LEVEL SECURITY; CREATE USER mia; CREATE ROLE reader; GRANT SELECT (id, writer) ON notes TO reader")
    mia.store.refresh()
    with pytest.raises(StoreError, match="no select"):
        mia.sql("SELECT id FROM notes")
    s.sql("GRANT reader TO mia")
    mia.store.refresh()
    assert mia.sql("SELECT * FROM notes").columns == ["id", "writer"]
    with pytest.raises(StoreError, match="no delete"):
        mia.sql("DELETE FROM notes")
    with pytest.raises(StoreError, match="may not"):
        mia.sql("CREATE USER eve")
    s.sql("REVOKE reader FROM mia; DROP MASK hide ON notes; DROP USER mia")


def test_virtual_tables_and_match(s):
    s.sql("CREATE VIRTUAL TABLE pages USING fts_docs(stopwords='of')")
    s.sql("INSERT INTO pages (doc_id, text) VALUES (5, 'Harvest of winter barley'), (6, 'Winter storms and sailing'), (7, 'Sailing a small boat')")
    assert rows(s.sql("SELECT doc_id FROM pages WHERE pages MATCH 'winter'")) == [(5,), (6,)]
    assert rows(s.sql("SELECT p.doc_id FROM pages AS p WHERE p MATCH 'sailing -storms'")) == [(7,)]
    assert rows(s.sql("SELECT doc_id, rank, snippet, highlight FROM pages WHERE query = 'winter sail*'")) == [(6, 2.0, "[Winter] storms and [sailing]", "<b>Winter</b> storms and <b>sailing</b>")]
    assert rows(s.sql("SELECT doc_id FROM pages WHERE text MATCH 'boat OR barley' AND doc_id > 5")) == [(7,)]
    s.sql("UPDATE pages SET text = 'Spring tide' WHERE doc_id = 7")
    assert rows(s.sql("SELECT doc_id FROM pages WHERE pages MATCH 'tide'")) == [(7,)] and s.sql("SELECT * FROM pages").count() == 3
    s.sql("CREATE VIRTUAL TABLE kv USING kv_store; INSERT INTO kv VALUES ('a', '1') ; INSERT INTO kv VALUES ('a', '2') ON CONFLICT (key) DO UPDATE SET value = excluded.value")
    assert rows(s.sql("SELECT * FROM kv")) == [("a", "2")]
    s.sql("CREATE VIRTUAL TABLE areas USING rtree_rects; INSERT INTO areas VALUES (4, 0, 5, 0, 5), (5, 7, 9, 7, 9), (6, 5, 6, 5, 6)")
    assert rows(s.sql("SELECT id FROM areas WHERE rtree_intersects(min_x, max_x, min_y, max_y, 4.0, 5.0, 4.0, 5.0)")) == [(4,), (6,)]
    s.sql("CREATE VIRTUAL TABLE odd USING series(1, 9, 4)")
    assert rows(s.sql("SELECT value FROM odd")) == [(1,), (5,), (9,)] and s.sql("SELECT name FROM schema_tables WHERE name = 'pages'").count() == 1


def test_scored_searches_in_sql(s, spark):
    s.sql("CREATE TABLE d (id BIGINT PRIMARY KEY, v EMBEDDING(4), sparse TEXT, members TEXT)")
    df = spark.createDataFrame([(1, [1.0, 0.5, 0.2, 0.1], "[[1, 2.0], [5, 1.0]]", '["x", "y", 3]'), (2, [-1.0, 0.5, -0.2, 0.1], "[[5, 4.0]]", '["x", "y", "3"]'), (3, [-1.0, -1.0, 1.0, 0.0], "[[9, 1.0]]", '["q"]')], "id long, v array<float>, sparse string, members string")
    s.store.insert("d", df)
    s.store.commit()
    assert rows(s.sql("SELECT id, search_rank FROM ann_search_scored('d', 'v', '[1, 0.5, 0.2, 0.1]', 2, 'id')")) == [(1, 1), (2, 2)]
    assert rows(s.sql("SELECT id FROM d WHERE ann_search(v, '[1, 0.5, 0.2, 0.1]', 1)")) == [(1,)]
    s.sql("CREATE INDEX a ON d USING ann (v) WITH (quantization = 'binary_sign')")
    assert rows(s.sql("SELECT id, ann_distance FROM ann_search_scored('d', 'v', '[1, 1, 1, 1]', 3, 'id')")) == [(1, 0), (2, 2), (3, 3)]
    assert [r[0] for r in s.sql("SELECT id FROM ann_search_exact('d', 'v', '[-1, 0.5, -0.2, 0.1]', 3, 2, 'l2', 'id') ORDER BY search_rank").collect()] == [2, 3]
    assert rows(s.sql("SELECT id, sparse_score FROM sparse_search_scored('d', 'sparse', '[[5, 2], [1, 1]]', 5, 'id')")) == [(1, 4.0), (2, 8.0)]
    assert rows(s.sql("SELECT t.id FROM d AS t WHERE sparse_match(t.sparse, '[[9, 1]]', 5)")) == [(3,)]
    assert rows(s.sql("""SELECT id, exact_jaccard FROM set_similarity_scored('d', 'members', '["y", "x", 3]', 10, 0.4, 5, 'id')""")) == [(1, 1.0), (2, 0.5)]
    assert rows(s.sql("""SELECT id, estimated_jaccard FROM minhash_search_scored('d', 'members', '["q"]', 1, 'id')""")) == [(3, 1.0)]
    q = """SELECT id, fused_score FROM hybrid_search_scored('d', '{"must": [{"kind": "in", "column": "id", "values": [1, 2]}], "retrievers": [{"name": "dense", "ann": {"column": "v", "query": [1, 1, 1, 1], "k": 2}}, {"name": "words", "weight": 2, "sparse": {"column": "sparse", "query": [[5, 1.0]], "k": 2}}], "limit": 5}', 'id')"""
    assert rows(s.sql(q)) == [(1, 1 / 61 + 2 / 62), (2, 1 / 62 + 2 / 61)]
    with pytest.raises(ValueError, match="no column"):
        s.sql("SELECT * FROM ann_search_scored('d', 'nope', '[1]', 1)")


def test_ttl_masks_attach_backup(s, spark, tmp_path):
    assert ttl_nanos("7 days") == 604_800_000_000_000
    s.sql("CREATE TABLE e (id BIGINT PRIMARY KEY, at TIMESTAMP) TTL_COLUMN at TTL '7 days'")
    s.sql("INSERT INTO e SELECT 1 AS id, current_timestamp() - INTERVAL 8 DAYS AS at; INSERT INTO e SELECT 2 AS id, current_timestamp() AS at")
    assert rows(s.sql("SELECT id FROM e")) == [(2,)]
    s.sql("CREATE TABLE u (id BIGINT PRIMARY KEY, owner TEXT, ssn TEXT); INSERT INTO u VALUES (1, 'ann', '1'), (2, 'bob', NULL)")
    s.policy("u", "owner = 'ann'", roles=["ann"])
    s.mask("u", "ssn", "redact", unmasked=["root"])
    assert rows(s.secured("u", "ann")) == [(1, "ann", "[REDACTED]")] and rows(s.secured("u", "eve")) == []
    s.sql(f"VACUUM INTO '{tmp_path}/copy'; ATTACH '{tmp_path}/copy' AS old")
    assert rows(s.sql("SELECT id FROM old_u")) == [(1,), (2,)]
    heard = []
    s.listen("c", heard.append)
    s.sql("NOTIFY c, 'hi'")
    assert heard == ["hi"]
    assert s.sql("CHECK").collect() == []


def test_incremental_view_drops_more_groups_than_ten_thousand(s):
    s.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, g BIGINT NOT NULL, v BIGINT NOT NULL)")
    s.store.insert("t", s.spark.range(10_060).selectExpr("id AS k", "id AS g", "id AS v"))
    s.store.commit()
    s.sql("CREATE MATERIALIZED VIEW m AS SELECT g, count(*) AS n, sum(v) AS total FROM t GROUP BY g")
    s.sql("DELETE FROM t WHERE k >= 5")
    assert s.sql("REFRESH MATERIALIZED VIEW m").first()["refresh"] == "incremental"
    assert rows(s.sql("SELECT g, n, total FROM m")) == [(i, 1, i) for i in range(5)]


def test_answers_from_the_manifest(s):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, at DATE, x DOUBLE, w TEXT); INSERT INTO t VALUES (5, DATE '2024-03-01', 1.5, 'a'), (9, NULL, -2, 'b'); INSERT INTO t VALUES (7, DATE '2023-01-01', 8, NULL)")
    q = s.sql("SELECT count(*) AS n, min(id) AS a, max(x) AS b, min(at) AS c FROM t")
    assert [str(v) for v in q.first()] == ["3", "5", "8.0", "2023-01-01"] and "parquet" not in q._jdf.queryExecution().executedPlan().toString().lower()
    s.sql("DELETE FROM t WHERE id = 5")
    assert tuple(s.sql("SELECT count(*) AS n, min(id) AS a FROM t").first()) == (2, 7) and s.store.statistics("t") is None


def test_shadows_follow_changes(s):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY); INSERT INTO t VALUES (1), (2)")
    s.shadow("t")
    assert "InMemoryTableScan" in s.sql("SELECT id FROM t WHERE id > 1")._jdf.queryExecution().executedPlan().toString()
    s.sql("INSERT INTO t VALUES (3)")
    assert rows(s.sql("SELECT id FROM t WHERE id > 1")) == [(2,), (3,)] and not s.shadows


def test_ingest_goes_on_where_it_stopped(s, spark):
    from tessera.sources import io

    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT)")
    part = lambda a, b: lambda: spark.range(a, b).selectExpr("id", "CAST(id AS STRING) AS v")

    def broken():
        raise RuntimeError("the other database went away")

    with pytest.raises(RuntimeError):
        io.copy_snapshot(s.store, "t", {"a": part(0, 3), "b": broken})
    assert io.copy_snapshot(s.store, "t", {"a": part(0, 3), "b": part(3, 5)}) == ["b"]
    log = [(1, "update", 1, "x"), (2, "delete", 0, None), (3, "insert", 9, "n"), (4, "update", 1, "y")]
    frame = lambda upto: spark.createDataFrame(log[:upto], "pos long, op string, id long, v string")
    assert s.store.apply_changes("t", frame(2), "src", "pos") == 2
    assert s.store.apply_changes("t", frame(4), "src", "pos") == 2 and s.store.apply_changes("t", frame(4), "src", "pos") == 0
    assert rows(s.sql("SELECT * FROM t")) == [(1, "y"), (2, "2"), (3, "3"), (4, "4"), (9, "n")]


def test_backups_keep_what_belongs_to_tables(s, tmp_path, spark):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, g TEXT NOT NULL); INSERT INTO t VALUES (1, 'a'); CREATE MATERIALIZED VIEW m AS SELECT g, count(*) AS n FROM t GROUP BY g")
    s.sql("CREATE TABLE log (id BIGINT); CREATE TRIGGER tr AFTER INSERT ON t BEGIN INSERT INTO log VALUES (NEW.id); END")
    s.sql("""CREATE PROCEDURE p AS '{"params": [], "steps": [{"kind": "query", "sql": "SELECT count(*) AS n FROM t"}]}'""")
    s.sql(f"VACUUM INTO '{tmp_path}/copy'")
    other = Session(spark, f"{tmp_path}/copy")
    other.sql("INSERT INTO t VALUES (2, 'b'); REFRESH MATERIALIZED VIEW m")
    assert rows(other.sql("SELECT * FROM log")) == [(2,)] and rows(other.sql("SELECT * FROM m")) == [("a", 1), ("b", 1)] and rows(other.sql("CALL p()")) == [(2,)]
    assert other.sql("DESCRIBE PROCEDURE p").count() == 1


def test_percentile_arguments(s, spark):
    plain = Session(spark)
    for bad in ("percentile(x, 101)", "percentile_cont(x, -0.1)", "percentile_disc(x, NULL)", "percentile(x, x)"):
        with pytest.raises(ValueError):
            plain.sql(f"SELECT {bad} FROM VALUES (1) AS t(x)")
    with pytest.raises(Exception, match="infinite"):
        plain.sql("SELECT median(x) FROM VALUES (double('infinity')), (1) AS t(x)").collect()
    assert plain.sql("SELECT median(x) AS m FROM VALUES (double('NaN')), (1), (3), (NULL) AS t(x)").first()[0] == 2.0


@pytest.mark.parametrize(("text", "want"), [("quote('it''s')", "'it''s'"), ("'a\\b'", "a\\b"), ("regexp('^\\d+$', '12')", 1), ("json_extract('{\"a\":\"x\\ny\"}', '$.a')", "x\ny"), ("json_type('[1.0]', '$[0]')", "real"), ("CAST('7' AS CHAR(3))", "7"), ("max(1, NULL)", None), ("char(72, 105)", "Hi"), ("glob('a[0-9]', 'a5')", 1), ("like('a\\%', 'a%', '\\')", 1), ("printf('%d%%', 5)", "5%"), ("soundex('')", "?000")])
def test_values_in_sql(spark, text, want):
    assert Session(spark).sql(f"SELECT {text} AS v").first()[0] == want


def test_joins_take_the_strategy_that_sizes_call_for(spark, tmp_path):
    big, small = spark.range(100_000).selectExpr("id AS k", "id AS v"), spark.range(50).selectExpr("id AS k")
    for n, df in (("big", big), ("small", small)):
        df.write.parquet(str(tmp_path / n))
    plan = lambda a, b: a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert "BroadcastHashJoin" in plan(read("big"), read("small"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart = plan(read("big"), read("small"))
        assert "SortMergeJoin" in apart and apart.count("Exchange") >= 2
        for n in ("big", "small"):
            read(n).write.bucketBy(4, "k").sortBy("k").mode("overwrite").option("path", str(tmp_path / f"b_{n}")).saveAsTable(f"tessera_b_{n}")
        beside = plan(spark.table("tessera_b_big"), spark.table("tessera_b_small"))
        assert "SortMergeJoin" in beside and "Exchange" not in beside
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("big", "small"):
            spark.sql(f"DROP TABLE IF EXISTS tessera_b_{n}")


def test_event_windows(spark):
    from tessera.streaming.windows import sessions, windowed

    df = spark.createDataFrame([("a", "2024-01-01 00:01:00", 1), ("a", "2024-01-01 00:09:00", 2), ("a", "2024-01-01 00:11:00", 3), ("b", "2024-01-01 00:30:00", 4)], "u string, t string, v long").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r["u"], r["start"].minute): (r["n"], r["total"]) for r in windowed(df, "t", ["u"], "v", "10 minutes").collect()}
    assert got == {("a", 0): (2, 3), ("a", 10): (1, 3), ("b", 30): (1, 4)}
    assert len(windowed(df, "t", ["u"], "v", "10 minutes", "5 minutes").collect()) == 6
    assert sorted((r["u"], r["n"]) for r in sessions(df, "t", ["u"], "5 minutes").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_event_windows_of_a_stream(spark, tmp_path):
    from tessera.streaming.windows import windowed

    make = lambda rows, n: spark.createDataFrame(rows, "t string, v long").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    # The third run's first row is later than the watermark allows; its second moves the watermark on.
    for n, part in enumerate(([("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 2)], [("2024-01-01 01:00:00", 5)], [("2024-01-01 00:03:00", 100), ("2024-01-01 03:00:00", 6)])):
        make(part, str(n))
        stream = spark.readStream.schema("t timestamp, v long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = windowed(stream, "t", [], "v", "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["n"], r["total"]) for r in spark.read.parquet(out).orderBy("start").collect()] == [(2, 3), (1, 5)]
