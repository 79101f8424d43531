"""Row-level triggers run over whole change sets: BEFORE, AFTER and INSTEAD OF, with NEW, OLD, WHEN and UPDATE OF.

The rows that a statement changes become one frame with NEW_c and OLD_c for every column. A trigger's WHEN filters it,
and each statement of the body runs once over all of it: INSERT ... VALUES (NEW.a, ...) becomes an insert of a projection,
INSERT ... SELECT a join, UPDATE and DELETE joins with the table, SELECT RAISE(ABORT, '...') a test for a row. Where several
changed rows meet one target row of an UPDATE, they are applied in turns, so each sees what the one before left. A trigger
whose body names neither NEW nor OLD runs once a statement, if that changed a row.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import security
from tessera.functions.sql import call_args, split_commas
from tessera.sources.store import StoreError

DEPTH = 32
_NAMED = r"\b(new|old)\s*\.\s*(\w+)"


def create(session, m: re.Match) -> None:
    store, name = session.store, m["name"]
    when = " ".join(m["when"].lower().split())
    if name in store.work["triggers"]:
        if m["maybe"]:
            return
        if not m["replace"]:
            raise StoreError(f"trigger {name!r} exists")
    if when == "instead of":
        if m["table"] not in store.work["views"]:
            raise StoreError("INSTEAD OF is for views")
    else:
        spec = store.spec(m["table"])
        for c in (m["columns"] or "").split(","):
            if c.strip():
                spec.column(c.strip())
    columns = [c.strip() for c in m["columns"].split(",")] if m["columns"] else None
    store.work["triggers"][name] = {"when": when, "event": m["event"].lower(), "table": m["table"], "columns": columns, "test": m["test"], "body": m["body"].strip()}


def _own(session, when: str, event: str, table: str, columns: set[str] | None = None) -> list[dict]:
    return [t for t in session.store.work["triggers"].values() if (t["when"], t["event"], t["table"]) == (when, event, table) and (not t.get("columns") or columns is None or columns & set(t["columns"]))]


def _kept(session, df: DataFrame, name: str) -> DataFrame:
    """df, written beside the store's tables, so that all triggers see one answer."""
    path = f"{session.store.path}/_delta/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.spark.read.schema(df.schema).parquet(path)


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _fire(session, own: list[dict], delta: DataFrame) -> None:
    """Run triggers over a delta; an error takes back all that the outermost statement staged."""
    if not own or delta.isEmpty():
        return
    session._depth = getattr(session, "_depth", 0) + 1
    outer, session.in_transaction = session.in_transaction, True
    try:
        if session._depth > DEPTH:
            raise StoreError(f"triggers nest deeper than {DEPTH}")
        for t in own:
            rows = delta
            if t.get("test"):
                rows = rows.filter(F.expr(session._expr(_flat(t["test"]))))
                if rows.isEmpty():
                    continue
            from tessera.session import split_statements

            for statement in split_statements(t["body"]):
                _statement(session, statement, rows)
    finally:
        session._depth -= 1
        session.in_transaction = outer


def _flat(text: str) -> str:
    return re.sub(r"'(?:[^']|'')*'|" + _NAMED, lambda m: m[0] if not m[1] else f"`{m[1].lower()}_{m[2]}`", text, flags=re.I)


def _statement(session, text: str, rows: DataFrame) -> None:
    k = re.fullmatch(r"select\s+raise\s*\(\s*(abort|fail|rollback|ignore)\s*(?:,\s*'((?:[^']|'')*)')?\s*\)(?:\s+where\s+(.*))?", text, re.I | re.S)
    if k:
        hit = rows if not k[3] else rows.filter(F.expr(session._expr(_flat(k[3]))))
        if k[1].lower() != "ignore" and not hit.isEmpty():
            raise StoreError((k[2] or "raised").replace("''", "'"))
        return
    if not re.search(_NAMED, re.sub(r"'(?:[^']|'')*'", "''", text), re.I):
        session._run(text, None)
        return
    view = f"tessera_delta_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        if k := re.fullmatch(r"insert\s+into\s+(\w+)\s*(\([^)]*\)\s*)?values\s*(\(.*\))(\s+on\s+(?:conflict|duplicate)\b.*)?", text, re.I | re.S):
            parts = [split_commas(call_args(v, 0)[0]) for v in split_commas(k[3])]
            body = " UNION ALL ".join(f"SELECT {', '.join(f'{_flat(e)} AS c{i}' for i, e in enumerate(p))} FROM {view}" for p in parts)
            session._run(f"INSERT INTO {k[1]} {k[2] or ''}{body}{k[4] or ''}", None)
        elif k := re.fullmatch(r"insert\s+into\s+(\w+)\s*(\([^)]*\)\s*)?(select\b.*)", text, re.I | re.S):
            body = _flat(k[3])
            body = re.sub(r"\bfrom\b", f"FROM {view},", body, count=1, flags=re.I) if re.search(r"\bfrom\b", body, re.I) else re.sub(r"\bwhere\b|$", lambda w: f" FROM {view} {w[0]}", body, count=1, flags=re.I)
            session._run(f"INSERT INTO {k[1]} {k[2] or ''}{body}", None)
        elif k := re.fullmatch(r"update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?", text, re.I | re.S):
            _update_by(session, k[1], session._assignments(_flat(k[2])), session._expr(_flat(k[3] or "true")), rows)
        elif k := re.fullmatch(r"delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", text, re.I | re.S):
            ids = session.store.read(k[1], hidden=True).join(rows, F.expr(session._expr(_flat(k[2] or "true"))), "left_semi")
            _delete_rows(session, k[1], ids)
        else:
            raise StoreError(f"a trigger cannot run {text!r}")
    finally:
        session.spark.catalog.dropTempView(view)


def _update_by(session, table: str, sets: dict[str, str], test: str, rows: DataFrame) -> None:
    store = session.store
    order = _kept(session, rows.withColumn("_turn_key", F.monotonically_increasing_id()), "turns")
    met = store.read(table, hidden=True).join(order, F.expr(test)).select("_row_id", "_turn_key")
    turns = _kept(session, met.withColumn("_turn", F.row_number().over(Window.partitionBy("_row_id").orderBy("_turn_key"))), "met")
    for turn in range(1, (turns.agg(F.max("_turn")).first()[0] or 0) + 1):
        now = turns.filter(F.col("_turn") == turn).join(order, "_turn_key")
        target = store.read(table, hidden=True)
        both = target.join(now.drop("_turn", "_turn_key").withColumnRenamed("_row_id", "_met_id"), F.col("_row_id") == F.col("_met_id"))
        _write_update(session, table, both, sets)


def _write_update(session, table: str, both: DataFrame, sets: dict[str, str]) -> None:
    """Rows of a table beside what their new values are made of; fires the table's own triggers."""
    store = session.store
    spec = store.spec(table)
    names = spec.names()
    both = _kept(session, both.select(*names, "_row_id", "_epoch", *[(F.expr(sets[c]) if c in sets else F.col(c)).cast(spec.column(c).type).alias(f"new_{c}") for c in names]), table)
    _changed(session, table, both, set(sets))


def _changed(session, table: str, both: DataFrame, columns: set[str]) -> int:
    store, names = session.store, session.store.spec(table).names()
    point = store.savepoint()
    try:
        n = both.count()
        if n:
            delta = both.select(*[F.col(c).alias(f"old_{c}") for c in names], *[f"new_{c}" for c in names])
            _fire(session, _own(session, "before", "update", table, columns), delta)
            new = both.select(*[F.col(f"new_{c}").alias(c) for c in names], "_row_id")
            security.checked(store, table, new, "update", session.principal)
            store.replace_rows(table, both.select(*names, "_row_id", "_epoch"), new)
            _fire(session, _own(session, "after", "update", table, columns), delta)
        store.last_changes = n
        return n
    except Exception:
        store.rollback_to(point)
        raise


def update(session, name: str, sets: dict[str, str], tail: dict) -> int:
    store = session.store
    if own := _own(session, "instead of", "update", name):
        df = session.frame(name)
        df = df.filter(tail["condition"]) if tail["condition"] else df
        made = df.select(*[F.col(c).alias(f"old_{c}") for c in df.columns], *[(F.expr(sets[c]) if c in sets else F.col(c)).alias(f"new_{c}") for c in df.columns])
        return _instead(session, own, made)
    spec = store.spec(name)
    for c in sets:
        spec.column(c)
    rows = store.matched(name, tail["condition"], tail["order_by"], tail["limit"], security.writable(store, name, "update", session.principal))
    both = rows.select(*spec.names(), "_row_id", "_epoch", *[(F.expr(sets[c]) if c in sets else F.col(c)).cast(spec.column(c).type).alias(f"new_{c}") for c in spec.names()])
    return _changed(session, name, _kept(session, both, name), set(sets))


def _instead(session, own: list[dict], delta: DataFrame) -> int:
    delta, point = _kept(session, delta, "instead"), session.store.savepoint()
    try:
        _fire(session, own, delta)
    except Exception:
        session.store.rollback_to(point)
        raise
    session.store.last_changes = n = delta.count()
    return n


def delete(session, name: str, tail: dict) -> int:
    store = session.store
    if own := _own(session, "instead of", "delete", name):
        df = session.frame(name)
        return _instead(session, own, _sided(df.filter(tail["condition"]) if tail["condition"] else df, "old"))
    rows = store.matched(name, tail["condition"], tail["order_by"], tail["limit"], security.writable(store, name, "delete", session.principal))
    return _delete_rows(session, name, rows)


def _delete_rows(session, name: str, rows: DataFrame) -> int:
    store, point = session.store, session.store.savepoint()
    try:
        before, after = (_own(session, w, "delete", name) for w in ("before", "after"))
        if before or after:
            rows = _kept(session, rows, name)
        delta = _sided(rows.select(*store.spec(name).names()), "old")
        _fire(session, before, delta)
        n = store.delete_rows(name, rows)
        _fire(session, after, delta)
        store.last_changes = n
        return n
    except Exception:
        store.rollback_to(point)
        raise


def insert(session, name: str, df: DataFrame, conflict: str, assignments: dict[str, str] | None) -> int:
    store = session.store
    if own := _own(session, "instead of", "insert", name):
        return _instead(session, own, _sided(df, "new"))
    before, after = (_own(session, w, "insert", name) for w in ("before", "after"))
    point = store.savepoint()
    try:
        if before:
            df = _kept(session, store.prepared(name, df), name)
            _fire(session, before, _sided(df, "new"))
        top = store.work["tables"][name].get("clock", 0)
        n = store.insert(name, df, conflict, assignments)
        row_id, changes = store.last_row_id, store.last_changes
        if after:
            names = store.spec(name).names()
            _fire(session, after, _sided(store.written(name, top).select(*names), "new"))
        store.last_row_id, store.last_changes = row_id, changes
        return n
    except Exception:
        store.rollback_to(point)
        raise
