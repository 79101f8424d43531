"""PRAGMAs and information_schema: small frames made from the store's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sql import AGGREGATES, SCALARS

#: PRAGMAs that answer with one settled value; the store has no pages, journal or locks of its own.
SETTLED = {
    "application_id": 0, "automatic_index": 1, "cache_size": 0, "defer_foreign_keys": 0, "foreign_keys": 1, "freelist_count": 0, "page_size": 0, "query_only": 0, "recursive_triggers": 1, "synchronous": 2, "trusted_schema": 0,
    "encoding": "UTF-8", "journal_mode": "wal", "optimize": "ok",
}
MODULES = ("dbstat", "fts_docs", "json_each", "json_tree", "jsonb_each", "jsonb_tree", "kv_store", "rtree_rects", "schema_tables", "series")


def pragma(session, name: str, arg: str | None) -> DataFrame:
    """An unknown PRAGMA gives no rows."""
    store, rows = session.store, session._rows
    if name in ("table_info", "table_xinfo"):
        made = session._describe({"name": arg})
        return made if name == "table_info" else made.withColumn("hidden", F.lit(0))
    if name == "index_list":
        return rows([(i, n, int(False), x["kind"], int(bool(x.get("where")))) for i, (n, x) in enumerate(store.spec(arg).indexes.items())], "seq int, name string, unique int, origin string, partial int")
    if name in ("index_info", "index_xinfo"):
        found = [(i, store.spec(t).names().index(c), c) for t in store.work["tables"] for n, x in store.spec(t).indexes.items() if n == arg for i, c in enumerate(x["columns"])]
        return rows(found, "seqno int, cid int, name string")
    if name == "foreign_key_list":
        keys = [(i, j, f.table, a, b, "NO ACTION", f.on_delete.upper()) for i, f in enumerate(store.spec(arg).foreign_keys) for j, (a, b) in enumerate(zip(f.columns, f.ref_columns, strict=True))]
        return rows(keys, "id int, seq int, table string, `from` string, `to` string, on_update string, on_delete string")
    if name == "foreign_key_check":
        return _orphans(session, arg)
    if name in ("table_list", "schema_tables"):
        return session.schema_tables()
    if name == "dbstat":
        return session.dbstat()
    if name == "database_list":
        return rows([(0, "main", store.path), *((i, a, s.path) for i, (a, s) in enumerate(session.attached.items(), start=1))], "seq int, name string, file string")
    if name == "trigger_list":
        return rows([(n, t["table"], t["when"], t["event"]) for n, t in sorted(store.work["triggers"].items())], "name string, table string, timing string, event string")
    if name == "function_list":
        return rows([(n, "a" if n in AGGREGATES else "s") for n in sorted({*SCALARS, *AGGREGATES})], "name string, type string")
    if name == "module_list":
        return rows([(n,) for n in MODULES], "name string")
    if name == "collation_list":
        return rows([(0, "BINARY")], "seq int, name string")
    if name == "compile_options":
        from tessera.session import OPTIONS

        return rows([(o,) for o in OPTIONS], "compile_options string")
    if name in ("integrity_check", "quick_check"):
        problems = [(f"{t}: {p}",) for t, p in (tuple(r) for r in session.sql("CHECK").collect())]
        return rows(problems or [("ok",)], f"{name} string")
    if name == "page_count":
        return rows([(sum(len(t["runs"]) for t in store.work["tables"].values()),)], "page_count bigint")
    if name == "wal_checkpoint":
        return rows([(0, 0, 0)], "busy int, log int, checkpointed int")
    if name in ("data_version", "schema_version"):
        return rows([(store.epoch,)], f"{name} bigint")
    if name == "user_version":
        if arg is not None:
            store.work["user_version"] = int(arg)
            session._done()
        return rows([(store.work.get("user_version", 0),)], "user_version bigint")
    if name in SETTLED:
        return rows([(SETTLED[name],)], f"{name} {'string' if isinstance(SETTLED[name], str) else 'bigint'}")
    return rows([], "value string")


def _orphans(session, table: str | None) -> DataFrame:
    """(table, parent, n) of references without a row, counted in Spark."""
    store, found = session.store, []
    for name in [table] if table else list(store.work["tables"]):
        for f in store.spec(name).foreign_keys:
            own = store.read(name).select(*f.columns).na.drop()
            parents = store.read(f.table).select(*[F.col(r).alias(c) for c, r in zip(f.columns, f.ref_columns, strict=True)])
            if n := own.join(parents, f.columns, "left_anti").count():
                found.append((name, f.table, n))
    return session._rows(found, "table string, parent string, n bigint")


def information_schema(session) -> dict[str, DataFrame]:
    store = session.store
    tables = [("main", "public", n, "BASE TABLE") for n in sorted(store.work["tables"])] + [("main", "public", n, "VIEW") for n in sorted(store.work["views"])]
    columns = [(n, c.name, i + 1, c.default, "YES" if c.nullable else "NO", c.type) for n in sorted(store.work["tables"]) for i, c in enumerate(store.spec(n).columns)]
    return {
        "tables": session._rows(tables, "table_catalog string, table_schema string, table_name string, table_type string"),
        "columns": session._rows(columns, "table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string"),
    }
