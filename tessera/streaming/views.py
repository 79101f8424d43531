"""Materialized views: full refresh, and incremental refresh of count and sum by group from the change log.

Incremental if the definition reads one table without a filter or join, groups by NOT NULL columns (boolean, bigint,
string) that come first, and has one count(*) and any sums of NOT NULL columns. The signed changes since the last refresh
are grouped and added to the stored groups; a group whose count is 0 goes, by a join, however many go at once. Anything
else (updates and truncations among the changes, a gap in the change log, staged changes of an open transaction) is
refreshed in full. A view remembers the clock of its table: each statement's changes carry theirs, so changes count once,
also those of the transaction that made the view.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.sources.store import ColumnSpec, StoreError, TableSpec


def plan(query: str, store=None) -> dict | None:
    m = re.fullmatch(r"\s*select\s+(?P<items>.*?)\s+from\s+(?P<table>\w+)\s+group\s+by\s+(?P<keys>[\w\s,]+)\s*", query, re.I | re.S)
    if not m:
        return None
    keys = [k.strip() for k in m["keys"].split(",")]
    items = [re.fullmatch(r"(?:(\w+)|count\s*\(\s*\*\s*\)\s+as\s+(\w+)|sum\s*\(\s*(\w+)\s*\)\s+as\s+(\w+))", i.strip(), re.I) for i in m["items"].split(",")]
    if not all(items) or [i[1] for i in items[: len(keys)]] != keys or any(i[1] for i in items[len(keys) :]):
        return None
    counts = [i[2] for i in items if i[2]]
    made = {"table": m["table"], "keys": keys, "count": counts[0], "sums": {i[4]: i[3] for i in items if i[3]}} if len(counts) == 1 else None
    if made and store is not None:
        if made["table"] not in store.work["tables"]:
            return None
        spec = store.spec(made["table"])
        own = {c.name: c for c in spec.columns}
        bare = [k for k in [*keys, *made["sums"].values()] if k not in own or (own[k].nullable and k not in spec.primary_key)]
        if bare or any(own[k].type not in ("boolean", "bigint", "string") for k in keys) or any(own[c].type != "bigint" for c in made["sums"].values()):
            return None
    return made


def create(session, name: str, query: str) -> None:
    store, df = session.store, session._select(query)
    made = plan(query, store)
    store.create_table(name, TableSpec([ColumnSpec(c, t) for c, t in df.dtypes], made["keys"] if made else []))
    store.insert(name, df)
    store.work["materialized"][name] = {"query": query, "epoch": store.epoch, "clock": _clock(store, made)}


def _clock(store, made: dict | None) -> int:
    return store.work["tables"][made["table"]].get("clock", 0) if made else -1


def refresh(session, name: str) -> str:
    store = session.store
    if name not in store.work["materialized"]:
        raise StoreError(f"no materialized view {name!r}")
    view = store.work["materialized"][name]
    made = plan(view["query"], store)
    how = "full"
    if made and store.spec(name).primary_key and not store.dirty() and 0 <= view.get("clock", -1) <= _clock(store, made):
        try:
            how = _delta(session, name, view, made)
        except StoreError as e:
            if "no longer retained" not in str(e):
                raise
    if how == "full":
        df = session._select(view["query"])
        store.truncate(name)
        store.insert(name, df)
    store.work["materialized"][name] = {**view, "epoch": store.epoch, "clock": _clock(store, made)}
    return how


def _delta(session, name: str, view: dict, made: dict) -> str:
    """Adds the signed changes of the source since the view's clock."""
    store, table = session.store, made["table"]
    events = store.changes(view["epoch"]).filter((F.col("table") == table) & (F.col("step") > view["clock"]))
    if not events.filter(~F.col("op").isin("insert", "delete")).isEmpty():
        return "full"
    fields = ", ".join(f"`{c.name}` {c.type}" for c in store.spec(table).columns)
    rows = events.select(F.when(F.col("op") == "insert", 1).otherwise(-1).alias("_sign"), F.from_json("row", fields).alias("r")).select("_sign", "r.*")
    parts = [F.sum("_sign").alias(made["count"])] + [F.sum(F.col("_sign") * F.col(c)).alias(a) for a, c in made["sums"].items()]
    delta = rows.groupBy(*made["keys"]).agg(*parts)
    held = store.read(name, hidden=True)
    sums = [made["count"], *made["sums"]]
    both = held.select(*delta.columns).unionByName(delta).groupBy(*made["keys"]).agg(*[F.sum(c).alias(c) for c in sums])
    changed = store._kept(name, both.join(delta.select(*made["keys"]), made["keys"], "left_semi").select(*store.spec(name).names()))
    gone = changed.filter(F.col(made["count"]) == 0).select(*made["keys"])
    ended = held.join(gone, made["keys"], "left_semi")
    if not gone.isEmpty():
        store.delete_rows(name, ended)
    store.insert(name, changed.filter(F.col(made["count"]) != 0), "update")
    return "incremental"
