"""A SQL session over one store and any registered views: statements that Spark has, and those it lacks.

A text is split into statements; each is tried as a command (DDL, DML, transactions, prepared statements, procedures,
views, security, introspection), else it is rewritten (AS OF EPOCH, MATCH, the function library's names, scored searches,
recursive UNION) and given to Spark. The last statement's result is returned. Tables of the store are temp views under
their names, as the session's principal may see them.
"""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import search
from tessera.functions.sql import call_args as _call_args
from tessera.functions.sql import quoted, register, rewrite, split_commas
from tessera import introspection, security, triggers
from tessera.operators.relational import recursive, series
from tessera.sources.store import ColumnSpec, ForeignKey, Store, StoreError, TableSpec, ttl_nanos

_TYPES = {
    "boolean": "boolean", "bool": "boolean", "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "integer": "bigint", "bigint": "bigint", "double": "double", "real": "double", "float": "double",
    "timestamp": "timestamp", "datetime": "timestamp", "date": "date", "time": "string", "text": "string", "varchar": "string", "char": "string", "string": "string", "blob": "binary", "uuid": "string", "json": "string", "jsonb": "string", "array": "string",
}
VOLATILE = re.compile(r"\b(now|random|randomblob|uuid|current_timestamp|current_date|rand|changes|total_changes|last_insert_rowid|current_user|session_user|date|time|datetime)\b\s*\(?", re.I)


VERSION = "0.2"
INDEXES = ("bitmap", "fm", "ann", "learned_range", "minhash", "sparse")
VIRTUAL = {
    "fts_docs": [("doc_id", "bigint"), ("text", "string")],
    "kv_store": [("key", "string"), ("value", "string")],
    "rtree_rects": [("id", "bigint"), ("min_x", "double"), ("max_x", "double"), ("min_y", "double"), ("max_y", "double")],
}
OPTIONS = ("ENABLE_FTS", "ENABLE_JSON", "ENABLE_MATH_FUNCTIONS", "ENABLE_RTREE", "THREADSAFE")


def split_statements(text: str) -> list[str]:
    """Statements between semicolons outside quotes, comments, $$ bodies and BEGIN ... END of triggers."""
    parts, start, i, depth = [], 0, 0, 0
    while i < len(text):
        rest = text[i:]
        if m := re.match(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$\$.*?\$\$", rest, re.S):
            i += m.end()
            continue
        if m := re.match(r"(begin|case|end)\b", rest, re.I) if not i or not (text[i - 1].isalnum() or text[i - 1] == "_") else None:
            if re.match(r"\s*create\s+trigger\b", text[start:i], re.I):
                depth += -1 if m[1].lower() == "end" else 1
            i += m.end()
            continue
        if text[i] == ";" and depth <= 0:
            parts.append(text[start:i])
            start, depth = i + 1, 0
        i += 1
    parts.append(text[start:])
    plain = (re.sub(r"^(\s*(--[^\n]*\n|/\*.*?\*/))*", "", p, flags=re.S).strip() for p in parts)
    return [p for p in plain if p]


class Session:
    """SQL over a store. Statements outside BEGIN ... COMMIT commit on their own."""

    def __init__(self, spark: SparkSession, path: str | None = None, cache_entries: int = 64, principal: str | None = None) -> None:
        """principal: the user in whose name statements run, under policies, masks and grants; None: the owner, under none."""
        self.spark, self.principal = spark, principal
        self.store = Store(spark, path) if path else None
        self.in_transaction, self.points, self.prepared = False, [], {}
        self.attached: dict[str, Store] = {}
        self.listeners: dict[str, list[Callable[[str], None]]] = {}
        self.cache: OrderedDict[tuple[str, int], DataFrame] = OrderedDict()
        self.cache_entries = cache_entries
        self.queries: dict[str, dict] = {}
        self.heard: dict[str, list[str]] = {}
        self.shadows: dict[str, tuple[int, DataFrame]] = {}

    # Entry

    def sql(self, text: str, args: list | None = None, query_id: str | None = None) -> DataFrame | None:
        """The last statement's result. Jobs of a query with an id can be ended by cancel(id) and are listed by status(id)."""
        if query_id is None:
            result = None
            for statement in split_statements(text):
                result = self._run(statement, args)
            return result
        known = self.queries[query_id] = {"sql": text, "state": "running", "started": time.time()}
        self.spark.addTag(query_id)
        try:
            result = self.sql(text, args)
            known["state"] = "done"
            return result
        except Exception:
            known["state"] = "cancelled" if known["state"] == "cancelled" else "failed"
            raise
        finally:
            known["seconds"] = time.time() - known["started"]
            self.spark.removeTag(query_id)

    def cancel(self, query_id: str) -> None:
        self.queries[query_id]["state"] = "cancelled"
        self.spark.interruptTag(query_id)

    def status(self, query_id: str) -> dict:
        return dict(self.queries[query_id])

    def _run(self, sql: str, args: list | None) -> DataFrame | None:
        for pattern, name in _COMMANDS:
            if m := re.fullmatch(pattern, sql, re.I | re.S):
                return getattr(self, name)(m)
        return self._select(sql, args)

    def _done(self) -> None:
        if not self.in_transaction:
            self.store.commit()
        self.clear_cache()

    def _select(self, sql: str, args: list | None = None) -> DataFrame:
        store = self.store
        if store and (m := re.search(r"(?<![\w.])(\w+)\s+AS\s+OF\s+EPOCH\s+(\d+)", sql, re.I)):
            name = f"{m[1]}_at_{m[2]}"
            store.read(m[1], epoch=int(m[2])).createOrReplaceTempView(name)
            sql = sql[: m.start()] + name + sql[m.end() :]
        sql = re.sub(r"\s+for\s+update\s*$", "", sql, flags=re.I)  # one writer commits at a time, so there is nothing to lock
        key = (" ".join(sql.split()), store.epoch if store else 0)
        own = {*store.work["tables"], *store.work["views"]} if store else set()
        named = re.findall(r"\b(?:from|join)\s+([\w.]+)", sql, re.I)  # a view of Spark's may change unseen
        stable = self.cache_entries > 0 and bool(named) and set(named) <= own and not (VOLATILE.search(sql) or args or self.in_transaction or (store and any(TableSpec.from_dict(t["spec"]).ttl for t in store.work["tables"].values())))
        if stable and key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        if (known := self._known(sql)) is not None:
            return known
        views: list[str] = []
        try:
            self._register(sql)
            sql = self._matching(sql)
            sql, views = search.resolve(sql, search.Sources(self.frame, self._key, self._hamming))
            df = self._recursive(sql)
            if df is None:
                df = self._spark(sql, args)
        finally:
            for name in views:  # the plan is resolved and needs them no more
                self.spark.catalog.dropTempView(name)
        if stable:
            # Blocks fill when the result is first read; those of the entry that goes are freed.
            self.cache[key] = df = df.persist()
            while len(self.cache) > self.cache_entries:
                self.cache.popitem(last=False)[1].unpersist()
        return df

    def _known(self, sql: str) -> DataFrame | None:
        """count(*), min(c) and max(c) of a whole table from its manifest, for tables that rows were only added to."""
        m = re.fullmatch(r"\s*select\s+(.*?)\s+from\s+(\w+)\s*", sql, re.I | re.S)
        if not m or not self.store or m[2] not in self.store.work["tables"] or not security.admin(self.store, self.principal):
            return None
        items = [re.fullmatch(r"(count\s*\(\s*\*\s*\)|(min|max)\s*\(\s*(\w+)\s*\))(?:\s+as\s+(\w+))?", i, re.I) for i in split_commas(m[1])]
        stats = self.store.statistics(m[2]) if all(items) else None
        if stats is None or any(i[3] and i[3] not in stats["ends"] for i in items):
            return None
        types = {c.name: c.type for c in self.store.spec(m[2]).columns}

        def value(i: re.Match) -> str:
            if not i[3]:
                return f"{stats['rows']}L"
            ends = stats["ends"][i[3]][i[2].lower() == "max"]
            parts = [f"CAST('{e}' AS {types[i[3]]})" for e in ends]
            return f"{'greatest' if i[2].lower() == 'max' else 'least'}({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else f"CAST(NULL AS {types[i[3]]})"

        return self.spark.sql("SELECT " + ", ".join(f"{value(i)} AS `{i[4] or i[1].lower()}`" for i in items))

    def shadow(self, name: str) -> None:
        """Keep a clean table's columns in memory until its next change; later statements read them there."""
        self.drop_shadow(name)
        self.shadows[name] = (self.store.work["tables"][name].get("clock", 0), self.store.read(name).persist())

    def drop_shadow(self, name: str) -> None:
        if old := self.shadows.pop(name, None):
            old[1].unpersist()

    def clear_cache(self) -> None:
        for df in self.cache.values():
            df.unpersist()
        self.cache.clear()

    def frame(self, name: str) -> DataFrame:
        """A table as the principal sees it, or a view of the Spark session."""
        store = self.store
        if store and name in store.work["tables"]:
            return security.seen(store, name, self.principal)
        if store and name in store.work["views"]:
            self._register(store.work["views"][name])
            return self._spark(store.work["views"][name])
        return self.spark.table(name)

    def _key(self, name: str) -> str:
        if self.store and name in self.store.work["tables"] and (keys := self.store.spec(name).primary_key):
            return keys[0]
        return self.frame(name).columns[0]

    def _hamming(self, table: str, column: str) -> bool:
        """Whether an ANN index keeps the column by its entries' signs."""
        if not self.store or table not in self.store.work["tables"]:
            return False
        own = [x for x in self.store.spec(table).indexes.values() if x["kind"] == "ann" and x["columns"] == [column]]
        return any(x.get("options", {}).get("quantization", "binary_sign") == "binary_sign" for x in own)

    def _matching(self, sql: str) -> str:
        docs = {n: v["options"] for n, v in self.store.work.get("virtual", {}).items() if v["module"] == "fts_docs"} if self.store else {}
        if not docs:
            return sql
        sql, frames = search.match(sql, docs, self.frame)
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return sql

    def _spark(self, sql: str, args: list | None = None) -> DataFrame:
        sql = re.sub(r"\binformation_schema\s*\.\s*(tables|columns)\b", r"information_schema_\1", sql, flags=re.I)
        if self.principal:
            sql = re.sub(r"'(?:[^']|'')*'|\b(?:current_user|session_user)\b(?:\s*\(\s*\))?", lambda m: m[0] if m[0][0] == "'" else quoted(self.principal), sql, flags=re.I)
        text = rewrite(self._counters(sql))
        register(self.spark, text)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _counters(self, sql: str) -> str:
        """Calls that the session itself answers."""

        def put(m: re.Match) -> str:
            if not m[1]:
                return m[0]
            name, arg, store = m[1].lower(), m[2].strip(), self.store
            if name == "load_extension":
                raise StoreError("extensions are not loaded")
            counters = {"changes": "last_changes", "total_changes": "total_changes", "last_insert_rowid": "last_row_id"}
            if name in counters:
                return f"{getattr(store, counters[name]) if store else 0}L"
            if name == "compileoption_used":
                return str(int(arg.strip("'").upper() in OPTIONS))
            if name == "compileoption_get":
                return f"'{OPTIONS[int(arg)]}'" if 0 <= int(arg) < len(OPTIONS) else "CAST(NULL AS STRING)"
            return {"tessera_version": f"'{VERSION}'", "tessera_source_id": f"'tessera {VERSION}'", "tessera_offset": "-1L"}[name]

        return re.sub(r"'(?:[^']|'')*'|(?<![\w.])(changes|total_changes|last_insert_rowid|compileoption_used|compileoption_get|tessera_version|tessera_source_id|tessera_offset|load_extension)\s*\(([^()]*)\)", put, sql, flags=re.I)

    def _register(self, sql: str) -> None:
        """Temp views of the store's tables and views that the text names."""
        for prefix, store in [("", self.store), *((f"{a}_", s) for a, s in self.attached.items())]:
            if store is None:
                continue
            for name in store.work["tables"]:
                if re.search(rf"\b{prefix}{re.escape(name)}\b", sql, re.I):
                    held = self.shadows.get(name) if not prefix and self.principal is None else None
                    if held and held[0] != store.work["tables"][name].get("clock", 0):
                        self.drop_shadow(name)
                        held = None
                    (held[1] if held else security.seen(store, name, self.principal)).createOrReplaceTempView(prefix + name)
            for name, text in store.work["views"].items():
                if re.search(rf"\b{prefix}{re.escape(name)}\b", sql, re.I):
                    self._register(text)
                    self._spark(text).createOrReplaceTempView(prefix + name)
        if self.store and re.search(r"\binformation_schema\s*\.", sql, re.I):
            for name, df in introspection.information_schema(self).items():
                df.createOrReplaceTempView(f"information_schema_{name}")
        for name in ("schema_tables", "dbstat"):
            if self.store and re.search(rf"\b{name}\b", sql, re.I):
                getattr(self, name)().createOrReplaceTempView(name)

    def _recursive(self, sql: str) -> DataFrame | None:
        """WITH RECURSIVE name AS (seed UNION step) rest; UNION ALL too, so that there is one rule for both."""
        m = re.match(r"\s*with\s+recursive\s+(\w+)\s*(?:\(([^)]*)\))?\s*as\s*(?=\()", sql, re.I)
        if not m:
            return None
        body, end = _call_args(sql, m.end())
        halves = re.split(r"\bunion\b(\s+all\b)?", body, maxsplit=1, flags=re.I)
        if len(halves) != 3 or sql[end:].lstrip().startswith(","):
            return None
        name = m[1]
        seed = self._spark(halves[0])
        if m[2]:
            seed = seed.toDF(*[c.strip() for c in m[2].split(",")])

        def step(fresh: DataFrame) -> DataFrame:
            fresh.createOrReplaceTempView(name)
            return self._spark(halves[2])

        recursive(seed, step, distinct=not halves[1]).createOrReplaceTempView(name)
        return self._spark(sql[end:])

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # DDL

    def _create_table(self, m: re.Match) -> None:
        spec = TableSpec([])
        for part in split_commas(m["body"]):
            self._table_part(spec, part)
        if ttl := re.search(r"TTL_COLUMN\s+(\w+)\s+TTL\s+'([^']*)'", m["tail"] or "", re.I):
            spec.ttl_column, spec.ttl = ttl[1], ttl_nanos(ttl[2])
        self.store.create_table(m["name"], spec, bool(m["maybe"]))
        self._done()

    def _table_part(self, spec: TableSpec, part: str) -> None:
        names = lambda text: [n.strip() for n in text.split(",")]
        if k := re.fullmatch(r"(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)", part, re.I):
            spec.primary_key = names(k[1])
        elif k := re.fullmatch(r"(?:constraint\s+\w+\s+)?unique\s*\(([^)]*)\)", part, re.I):
            spec.unique.append(names(k[1]))
        elif k := re.fullmatch(r"(?:constraint\s+\w+\s+)?check\s*\((.*)\)", part, re.I | re.S):
            spec.checks.append(rewrite(k[1]))
        elif k := re.fullmatch(r"(?:constraint\s+\w+\s+)?foreign\s+key\s*\(([^)]*)\)\s*references\s+(\w+)\s*\(([^)]*)\)(?:\s+on\s+delete\s+(restrict|cascade|set\s+null))?", part, re.I):
            spec.foreign_keys.append(ForeignKey(names(k[1]), k[2], names(k[3]), " ".join((k[4] or "restrict").lower().split())))
        else:
            spec.columns.append(self._column(spec, part))

    def _column(self, spec: TableSpec, part: str) -> ColumnSpec:
        m = re.match(r"(\w+)\s+(\w+)\s*(\([^)]*\))?(.*)", part, re.S)
        if not m:
            raise StoreError(f"cannot read the column {part!r}")
        name, kind, size, rest = m[1], m[2].lower(), m[3], m[4]
        variants = None
        if kind == "enum":
            variants, kind = [v.strip()[1:-1] for v in split_commas(size[1:-1])], "string"
        elif kind in ("decimal", "numeric"):
            kind = f"decimal{size or '(38,2)'}"
        elif kind == "embedding":
            kind = "array<float>"
        elif kind in _TYPES:
            kind = _TYPES[kind]
        else:
            raise StoreError(f"unknown type {kind!r}")
        default = re.search(r"default\s+('(?:[^']|'')*'|[-\w.]+(?:\(\))?)", rest, re.I)
        value = default[1] if default else None
        value = {"now()": "now", "current_timestamp": "now", "uuid()": "uuid"}.get((value or "").lower(), value)
        c = ColumnSpec(name, kind, not re.search(r"not\s+null|primary\s+key", rest, re.I), value, bool(re.search(r"auto_?increment", rest, re.I)), variants)
        if re.search(r"primary\s+key", rest, re.I):
            spec.primary_key = [name]
        if re.search(r"\bunique\b", rest, re.I):
            spec.unique.append([name])
        if k := re.search(r"\bcheck\s*(?=\()", rest, re.I):
            spec.checks.append(rewrite(_call_args(rest, k.end())[0]))
        if k := re.search(r"references\s+(\w+)\s*\((\w+)\)(?:\s+on\s+delete\s+(restrict|cascade|set\s+null))?", rest, re.I):
            spec.foreign_keys.append(ForeignKey([name], k[1], [k[2]], " ".join((k[3] or "restrict").lower().split())))
        return c

    def _create_as(self, m: re.Match) -> None:
        df = self._select(m["query"])
        names = df.columns
        self.store.create_table(m["name"], TableSpec([ColumnSpec(n, t, i > 0) for i, (n, t) in enumerate(df.dtypes)], [names[0]]))
        try:
            self.store.insert(m["name"], df)
        except Exception:
            self.store.drop_table(m["name"], True)
            raise
        self._done()

    def _drop(self, m: re.Match) -> None:
        kind, name = m["kind"].lower().split()[0], m["name"]
        if kind == "table":
            self.store.drop_table(name, bool(m["maybe"]))
        else:
            home = {"view": "views", "materialized": "materialized", "procedure": "procedures", "trigger": "triggers"}[kind]
            if self.store.work[home].pop(name, None) is None and not m["maybe"]:
                raise StoreError(f"no {kind} {name!r}")
            if kind == "materialized":
                self.store.drop_table(name, True)
        if kind in ("table", "view"):  # what belongs to it goes with it
            self.store.work.get("virtual", {}).pop(name, None)
            for own in [n for n, t in self.store.work["triggers"].items() if t["table"] == name]:
                del self.store.work["triggers"][own]
        self._done()

    def _alter(self, m: re.Match) -> None:
        name, what = m["name"], m["what"].strip()
        if k := re.fullmatch(r"rename\s+to\s+(\w+)", what, re.I):
            self.store.rename_table(name, k[1])
        elif k := re.fullmatch(r"rename\s+(?:column\s+)?(\w+)\s+to\s+(\w+)", what, re.I):
            self.store.rename_column(name, k[1], k[2])
        elif k := re.fullmatch(r"drop\s+(?:column\s+)?(\w+)", what, re.I):
            self.store.drop_column(name, k[1])
        elif k := re.fullmatch(r"(enable|disable)\s+row\s+level\s+security", what, re.I):
            security.switch(self.store, name, k[1].lower() == "enable", self.principal)
        elif k := re.fullmatch(r"add\s+(?:constraint\s+\w+\s+)?((?:check|unique|foreign\s+key)\b.*)", what, re.I | re.S):
            spec, point = self.store.spec(name), self.store.savepoint()
            self._table_part(spec, k[1])
            self.store.set_spec(name, spec)
            try:
                self.store._check(name, self.store.read(name, hidden=True))
            except StoreError:
                self.store.rollback_to(point)
                raise
        elif k := re.fullmatch(r"alter\s+(?:column\s+)?(\w+)\s+(set\s+default\s+(?P<value>.*)|drop\s+default|set\s+not\s+null|drop\s+not\s+null|(?:set\s+data\s+)?type\s+(?P<type>\w+))", what, re.I | re.S):
            self._alter_column(name, k)
        elif k := re.fullmatch(r"add\s+(?:column\s+)?(.*)", what, re.I | re.S):
            spec = self.store.spec(name)
            self.store.add_column(name, self._column(spec, k[1]))
        else:
            raise StoreError(f"cannot alter a table by {what!r}")
        self._done()

    def _alter_column(self, table: str, k: re.Match) -> None:
        spec = self.store.spec(table)
        c, how = spec.column(k[1]), " ".join(k[2].lower().split())
        if how == "set not null":
            if not self.store.read(table).filter(F.col(c.name).isNull()).isEmpty():
                raise StoreError(f"{table}.{c.name} holds nulls")
            c.nullable = False
        elif how == "drop not null":
            c.nullable = True
        elif how == "drop default":
            c.default = None
        elif k["type"]:
            c.type = _TYPES[k["type"].lower()]
        else:
            c.default = k["value"].strip()
        self.store.set_spec(table, spec)

    def _index(self, m: re.Match) -> None:
        spec = self.store.spec(m["table"])
        kind, columns = (m["using"] or "bitmap").lower(), [c.strip() for c in m["columns"].split(",")]
        if kind not in INDEXES:
            raise StoreError(f"unknown index kind {kind!r}")
        for c in columns:
            spec.column(c)
        options = {k[1].lower(): k[2].strip("'\"").lower() for p in split_commas(m["options"] or "") if (k := re.fullmatch(r"(\w+)\s*=\s*(.*)", p))}
        spec.indexes[m["name"]] = {"kind": kind, "columns": columns, "options": options, "where": m["where"]}
        self.store.set_spec(m["table"], spec)
        self._done()

    def _drop_index(self, m: re.Match) -> None:
        for table in self.store.work["tables"]:
            spec = self.store.spec(table)
            if spec.indexes.pop(m["name"], None) is not None:
                self.store.set_spec(table, spec)
                break
        else:
            if not m["maybe"]:
                raise StoreError(f"no index {m['name']!r}")
        self._done()

    def _view(self, m: re.Match) -> None:
        self._select(m["query"])  # an error now rather than later
        self.store.work["views"][m["name"]] = m["query"]
        self._done()

    def _virtual(self, m: re.Match) -> None:
        """CREATE VIRTUAL TABLE name USING module(args): a table of fixed columns, or a view of a function or a registered source."""
        name, module, store = m["name"], m["module"].lower(), self.store
        args = split_commas(m["args"]) if m["args"] and m["args"].strip() else []
        pairs = {k[1].lower(): k[2].strip("'\"") for a in args if (k := re.fullmatch(r"(\w+)\s*=\s*(.*)", a, re.S))}
        if module in VIRTUAL:
            spec = TableSpec([ColumnSpec(c, t, i > 0) for i, (c, t) in enumerate(VIRTUAL[module])], [VIRTUAL[module][0][0]])
            store.create_table(name, spec, bool(m["maybe"]))
            options = {k: (v.lower() in ("1", "true", "on") if k in ("prefix_queries", "case_sensitive") else int(v) if k == "min_token_len" else v.split()) for k, v in pairs.items()}
            if unknown := set(options) - {"prefix_queries", "case_sensitive", "min_token_len", "stopwords"}:
                raise StoreError(f"unknown option {sorted(unknown)}")
            store.work.setdefault("virtual", {})[name] = {"module": module, "options": options}
        elif module in ("series", "json_each", "json_tree", "jsonb_each", "jsonb_tree"):
            store.work["views"][name] = f"SELECT * FROM {module}({', '.join(args)})"
        elif module in ("schema_tables", "dbstat"):
            store.work["views"][name] = f"SELECT * FROM {module}"
        else:
            self.spark.read.format(module).options(**pairs).load().createOrReplaceTempView(name)
        self._done()

    def _materialized(self, m: re.Match) -> None:
        from tessera.streaming.views import create

        create(self, m["name"], m["query"])
        self._done()

    def _refresh(self, m: re.Match) -> DataFrame:
        from tessera.streaming.views import refresh

        how = refresh(self, m["name"])
        self._done()
        return self._rows([(m["name"], how)], "view string, refresh string")

    # DML

    def _columns(self, name: str) -> list[str]:
        return self.frame(name).columns if name in self.store.work["views"] else self.store.spec(name).names()

    def _values(self, table: str, columns: str | None, body: str) -> DataFrame:
        own = self._columns(table)
        names = [c.strip() for c in columns.split(",")] if columns else own
        rows = split_commas(body)
        if unknown := set(names) - set(own):
            raise StoreError(f"no column {sorted(unknown)}")
        return self._spark(f"SELECT * FROM VALUES {', '.join(rows)} AS t({', '.join(f'`{n}`' for n in names)})")

    def _insert(self, m: re.Match) -> None:
        body = m["body"]
        if body.lower().lstrip().startswith("values"):
            df = self._values(m["name"], m["columns"], body.lstrip()[6:])
        else:
            df = self._select(body)
            names = [c.strip() for c in m["columns"].split(",")] if m["columns"] else self._columns(m["name"])
            df = df.toDF(*names)
        conflict, assignments = "error", None
        if m["rule"]:
            if re.search(r"do\s+nothing", m["rule"], re.I):
                conflict = "nothing"
            else:
                sets = re.search(r"(?:update\s+set|duplicate\s+key\s+update)\s+(.*)", m["rule"], re.I | re.S)[1]
                conflict, assignments = "update", self._assignments(sets)
        security.allow(self.store, "insert", m["name"], self.principal)
        df = security.checked(self.store, m["name"], df, "insert", self.principal)
        triggers.insert(self, m["name"], df, conflict, assignments)
        self._done()

    def _expr(self, text: str | None) -> str | None:
        """An expression as Spark reads it, with the functions it needs."""
        if text is None:
            return None
        text = rewrite(self._counters(text))
        register(self.spark, text)
        return text

    def _assignments(self, text: str) -> dict[str, str]:
        pairs = (re.fullmatch(r"`?(\w+)`?\s*=\s*(.*)", p, re.S) for p in split_commas(text))
        return {p[1]: self._expr(p[2]) for p in pairs}

    def _tail(self, m: re.Match) -> dict:
        return {"condition": self._expr(m["where"]), "order_by": split_commas(m["order"]) if m["order"] else None, "limit": int(m["limit"]) if m["limit"] else None}

    def _update(self, m: re.Match) -> None:
        security.allow(self.store, "update", m["name"], self.principal)
        triggers.update(self, m["name"], self._assignments(m["sets"]), self._tail(m))
        self._done()

    def _delete(self, m: re.Match) -> None:
        security.allow(self.store, "delete", m["name"], self.principal)
        triggers.delete(self, m["name"], self._tail(m))
        self._done()

    def _truncate(self, m: re.Match) -> None:
        security.allow(self.store, "delete", m["name"], self.principal)
        self.store.truncate(m["name"])
        self._done()

    def _trigger(self, m: re.Match) -> None:
        triggers.create(self, m)
        self._done()

    # Security

    def _grant(self, m: re.Match) -> None:
        security.grant(self.store, m, self.principal)
        self._done()

    def _principal(self, m: re.Match) -> None:
        security.principal(self.store, m, self.principal)
        self._done()

    def _policy(self, m: re.Match) -> None:
        security.create_policy(self.store, m, self.principal)
        self._done()

    def _mask(self, m: re.Match) -> None:
        security.create_mask(self.store, m, self.principal)
        self._done()

    def _drop_rule(self, m: re.Match) -> None:
        security.drop_rule(self.store, m, self.principal)
        self._done()

    def secured(self, table: str, principal: str) -> DataFrame:
        """The table as a principal sees it: rows of a permissive policy and all restrictive ones, columns masked."""
        return security.seen(self.store, table, principal, grants=False)

    def policy(self, table: str, using: str, kind: str = "permissive", roles: list[str] | None = None) -> None:
        rules = security.catalog(self.store)
        rules["enabled"] = sorted({*rules["enabled"], table})
        rules["policies"].append({"name": f"policy_{len(rules['policies'])}", "table": table, "command": "all", "kind": kind, "roles": roles, "using": using, "check": None})
        self._done()

    def mask(self, table: str, column: str, kind: str, unmasked: list[str] | None = None) -> None:
        rules = security.catalog(self.store)
        rules["masks"].append({"name": f"mask_{len(rules['masks'])}", "table": table, "column": column, "kind": kind.lower(), "text": "[REDACTED]", "except": unmasked or []})
        self._done()

    # Transactions

    def _begin(self, m: re.Match) -> None:
        if self.in_transaction:
            raise StoreError("a transaction is open")
        self.in_transaction, self.points = True, []

    def _commit(self, m: re.Match) -> None:
        self.in_transaction = False
        self.store.commit()
        self.clear_cache()

    def _rollback(self, m: re.Match) -> None:
        self.in_transaction = False
        self.store.rollback()

    def _savepoint(self, m: re.Match) -> None:
        self.points.append((m["name"], self.store.savepoint()))

    def _rollback_to(self, m: re.Match) -> None:
        self.store.rollback_to(self._point(m["name"])[1])

    def _release(self, m: re.Match) -> None:
        del self.points[self.points.index(self._point(m["name"])) :]

    def _point(self, name: str) -> tuple[str, dict]:
        for point in reversed(self.points):
            if point[0] == name:
                return point
        raise StoreError(f"no savepoint {name!r}")

    def _set_transaction(self, m: re.Match) -> None:
        """All levels are served by one rule: a commit fails if another came first."""

    # Prepared statements and procedures

    def _prepare(self, m: re.Match) -> None:
        self.prepared[m["name"]] = re.sub(r"\$\d+", "?", m["body"])

    def _execute(self, m: re.Match) -> DataFrame | None:
        if m["name"] not in self.prepared:
            raise StoreError(f"no prepared statement {m['name']!r}")
        values = self.spark.sql(f"SELECT {m['args']}").first() if m["args"] else []
        return self._run(self.prepared[m["name"]], list(values) or None)

    def _deallocate(self, m: re.Match) -> None:
        self.prepared.pop(m["name"], None)

    def _procedure(self, m: re.Match) -> None:
        if m["name"] in self.store.work["procedures"] and not m["replace"]:
            raise StoreError(f"procedure {m['name']!r} exists")
        self.store.work["procedures"][m["name"]] = json.loads(m["body"].replace("''", "'"))
        self._done()

    def _call(self, m: re.Match) -> DataFrame | None:
        """Steps {kind: sql|put|upsert|delete_by_pk|delete_rows|query, ...} in one transaction; :name in SQL texts is an argument."""
        steps = self.store.work["procedures"].get(m["name"])
        if steps is None:
            raise StoreError(f"no procedure {m['name']!r}")
        params, given = steps.get("params", []), split_commas(m["args"]) if m["args"].strip() else []
        if len(params) != len(given):
            raise StoreError(f"{m['name']} takes {len(params)} arguments")
        values = dict(zip(params, given, strict=True))
        put = lambda text: re.sub(r":(\w+)", lambda k: values.get(k[1], k[0]), text)
        outer, self.in_transaction, result = self.in_transaction, True, None
        try:
            for s in steps["steps"]:
                kind = s["kind"]
                if kind in ("sql", "query"):
                    result = self.sql(put(s["sql"]))
                elif kind in ("put", "upsert"):
                    row = self.spark.sql("SELECT " + ", ".join(f"{put(str(v))} AS `{c}`" for c, v in s["row"].items()))
                    self.store.insert(s["table"], row, "update" if kind == "upsert" else "error")
                elif kind == "delete_by_pk":
                    self.store.delete(s["table"], f"{self.store.spec(s['table']).primary_key[0]} = {put(str(s['key']))}")
                elif kind == "delete_rows":
                    self.store.delete(s["table"], put(s["where"]))
                else:
                    raise StoreError(f"unknown step {kind!r}")
        except Exception:
            self.store.rollback()
            raise
        finally:
            self.in_transaction = outer
        self._done()
        return result

    # Introspection, attachments, messages

    def _show(self, m: re.Match) -> DataFrame:
        what = m["what"].lower()
        home = {"tables": "tables", "views": "views", "procedures": "procedures", "triggers": "triggers", "materialized views": "materialized"}[what]
        return self._rows([(n,) for n in sorted(self.store.work[home])], "name string")

    def _describe_procedure(self, m: re.Match) -> DataFrame:
        steps = self.store.work["procedures"].get(m["name"])
        if steps is None:
            raise StoreError(f"no procedure {m['name']!r}")
        return self._rows([(i, s["kind"], json.dumps({k: v for k, v in s.items() if k != "kind"}), ", ".join(steps.get("params", []))) for i, s in enumerate(steps["steps"])], "step int, kind string, body string, params string")

    def _describe(self, m: re.Match) -> DataFrame:
        spec = self.store.spec(m["name"])
        return self._rows([(i, c.name, c.type, int(not c.nullable), c.default, spec.primary_key.index(c.name) + 1 if c.name in spec.primary_key else 0) for i, c in enumerate(spec.columns)], "cid int, name string, type string, notnull int, dflt_value string, pk int")

    def _pragma(self, m: re.Match) -> DataFrame:
        return introspection.pragma(self, m["name"].lower(), m["arg"] or m["value"])

    def schema_tables(self) -> DataFrame:
        kinds = [(n, "table", len(t["spec"]["columns"])) for n, t in self.store.work["tables"].items() if n not in self.store.work["materialized"]]
        kinds += [(n, "materialized view", len(self.store.spec(n).columns)) for n in self.store.work["materialized"]] + [(n, "view", 0) for n in self.store.work["views"]]
        return self._rows([("main", *k) for k in sorted(kinds)], "schema_name string, name string, type string, ncol int")

    def dbstat(self) -> DataFrame:
        rows = [(n, "table", self.store.read(n).count(), len(t["runs"]), len(t["spec"]["columns"]), sum(self.store.files.size(r["path"]) for r in t["runs"])) for n, t in self.store.work["tables"].items()]
        return self._rows(rows, "name string, type string, rows bigint, runs int, columns int, storage_bytes bigint")

    def _explain_plan(self, m: re.Match) -> DataFrame:
        """Rows id, parent, notused, detail, from the physical plan's tree."""
        text = self._select(m["query"])._jdf.queryExecution().executedPlan().treeString()
        rows, stack = [], []
        for i, line in enumerate(x for x in text.splitlines() if x.strip()):
            depth = len(re.match(r"[ :+\-|]*", line)[0])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            rows.append((i + 1, stack[-1][1] if stack else 0, 0, line[depth:].strip()))
            stack.append((depth, i + 1))
        return self._rows(rows, "id int, parent int, notused int, detail string")

    def _explain(self, m: re.Match) -> DataFrame:
        df = self._select(m["query"])
        if m["analyze"]:
            df.count()
        return self._rows([(df._jdf.queryExecution().toString(),)], "plan string")

    def _attach(self, m: re.Match) -> None:
        self.attached[m["name"]] = Store(self.spark, m["path"])

    def _detach(self, m: re.Match) -> None:
        if self.attached.pop(m["name"], None) is None:
            raise StoreError(f"nothing is attached as {m['name']!r}")

    def _maintain(self, m: re.Match) -> DataFrame | None:
        what = m["what"].lower()
        if what.startswith("vacuum") and m["into"]:
            self.store.backup(m["into"])
        elif what == "vacuum":
            self.store.vacuum()
        elif what == "compact":
            for name in [m["arg"]] if m["arg"] else list(self.store.work["tables"]):
                self.store.compact(name)
            self._done()
        elif what in ("check", "doctor"):
            problems = []
            for name in self.store.work["tables"]:
                try:
                    self.store._check(name, self.store.read(name, hidden=True, expired=True))
                except StoreError as e:
                    problems.append((name, str(e)))
            return self._rows(problems, "table string, problem string")
        return None

    def _notify(self, m: re.Match) -> None:
        for f in self.listeners.get(m["name"], []):
            f(m["body"] or "")

    def _listen(self, m: re.Match) -> None:
        self.heard.setdefault(m["name"], [])
        self.listen(m["name"], self.heard[m["name"]].append)

    def _unlisten(self, m: re.Match) -> None:
        for name in [m["name"]] if m["name"] != "*" else list(self.listeners):
            self.unlisten(name)

    def notifications(self, channel: str) -> list[str]:
        """Messages that came since LISTEN, taken out."""
        got = list(self.heard.get(channel, []))
        self.heard.get(channel, []).clear()
        return got

    def listen(self, channel: str, f: Callable[[str], None]) -> None:
        self.listeners.setdefault(channel, []).append(f)

    def unlisten(self, channel: str) -> None:
        self.listeners.pop(channel, None)

    def changes(self) -> int:
        return self.store.last_changes

    def series(self, *bounds: int) -> DataFrame:
        return series(self.spark, *bounds)


_WHERE = r"(?:\s+where\s+(?P<where>.*?))?(?:\s+order\s+by\s+(?P<order>.*?))?(?:\s+limit\s+(?P<limit>\d+))?"
_COMMANDS = [
    (r"create\s+table\s+(?P<name>\w+)\s+as\s+(?P<query>.*)", "_create_as"),
    (r"create\s+table\s+(?P<maybe>if\s+not\s+exists\s+)?(?P<name>\w+)\s*\((?P<body>.*)\)(?P<tail>[^()]*)", "_create_table"),
    (r"drop\s+(?P<kind>table|view|materialized\s+view|procedure|trigger)\s+(?P<maybe>if\s+exists\s+)?(?P<name>\w+)", "_drop"),
    (r"alter\s+table\s+(?P<name>\w+)\s+(?P<what>.*)", "_alter"),
    (r"create\s+(?:unique\s+)?index\s+(?P<name>\w+)\s+on\s+(?P<table>\w+)\s*(?:using\s+(?P<using>\w+)\s*)?\((?P<columns>[^)]*)\)(?:\s+with\s*\((?P<options>[^)]*)\))?(?:\s+where\s+(?P<where>.*))?", "_index"),
    (r"create\s+(?:or\s+replace\s+)?view\s+(?P<name>\w+)\s+as\s+(?P<query>.*)", "_view"),
    (r"create\s+materialized\s+view\s+(?P<name>\w+)\s+as\s+(?P<query>.*)", "_materialized"),
    (r"refresh\s+materialized\s+view\s+(?P<name>\w+)", "_refresh"),
    (r"create\s+virtual\s+table\s+(?P<maybe>if\s+not\s+exists\s+)?(?P<name>\w+)\s+using\s+(?P<module>\w+)\s*(?:\((?P<args>.*)\))?", "_virtual"),
    (r"create\s+(?P<replace>or\s+replace\s+)?trigger\s+(?P<maybe>if\s+not\s+exists\s+)?(?P<name>\w+)\s+(?P<when>before|after|instead\s+of)\s+(?P<event>insert|update|delete)(?:\s+of\s+(?P<columns>[\w\s,]+?))?\s+on\s+(?P<table>\w+)(?:\s+for\s+each\s+row)?(?:\s+when\s+(?P<test>.*?))?\s+begin\s+(?P<body>.*?);?\s*end", "_trigger"),
    (r"(?P<way>create|drop)\s+(?P<kind>user|role)\s+(?P<maybe>if\s+(?:not\s+)?exists\s+)?'?\"?(?P<name>\w+)'?\"?(?:\s+with\s+password\s+'[^']*')?", "_principal"),
    (r"(?P<way>grant|revoke)\s+(?P<what>.*?)\s+(?:on\s+(?:table\s+)?(?P<table>\w+)\s+)?(?:to|from)\s+(?P<who>\w+)", "_grant"),
    (r"create\s+policy\s+(?P<name>\w+)\s+on\s+(?P<table>\w+)(?:\s+as\s+(?P<kind>permissive|restrictive))?(?:\s+for\s+(?P<command>all|select|insert|update|delete))?(?:\s+to\s+(?P<roles>[\w\s,]+?))?(?:\s+using\s*\((?P<using>.*?)\))?(?:\s+with\s+check\s*\((?P<check>.*)\))?", "_policy"),
    (r"create\s+mask\s+(?P<name>\w+)\s+on\s+(?P<table>\w+)\s*\(\s*(?P<column>\w+)\s*\)\s+using\s+(?P<kind>null|sha256|redact)(?:\s+'(?P<text>(?:[^']|'')*)')?(?:\s+except\s+(?P<except>[\w\s,]+))?", "_mask"),
    (r"drop\s+(?P<kind>policy|mask)\s+(?P<maybe>if\s+exists\s+)?(?P<name>\w+)(?:\s+on\s+(?P<table>\w+))?", "_drop_rule"),
    (r"drop\s+index\s+(?P<maybe>if\s+exists\s+)?(?P<name>\w+)", "_drop_index"),
    (r"listen\s+(?P<name>\w+)", "_listen"),
    (r"unlisten\s+(?P<name>\w+|\*)", "_unlisten"),
    (r"create\s+(?P<replace>or\s+replace\s+)?procedure\s+(?P<name>\w+)\s+as\s+'(?P<body>.*)'", "_procedure"),
    (r"call\s+(?P<name>\w+)\s*\((?P<args>.*)\)", "_call"),
    (r"insert\s+into\s+(?P<name>\w+)\s*(?:\((?P<columns>[^)]*)\)\s*)?(?P<body>(?:values|select|with)\b.*?)(?P<rule>\s+on\s+(?:conflict|duplicate\s+key)\b.*)?", "_insert"),
    (r"update\s+(?P<name>\w+)\s+set\s+(?P<sets>.*?)" + _WHERE, "_update"),
    (r"delete\s+from\s+(?P<name>\w+)" + _WHERE, "_delete"),
    (r"truncate\s+(?:table\s+)?(?P<name>\w+)", "_truncate"),
    (r"begin(?:\s+transaction)?|start\s+transaction", "_begin"),
    (r"commit|end", "_commit"),
    (r"rollback", "_rollback"),
    (r"savepoint\s+(?P<name>\w+)", "_savepoint"),
    (r"rollback\s+to\s+(?:savepoint\s+)?(?P<name>\w+)", "_rollback_to"),
    (r"release\s+(?:savepoint\s+)?(?P<name>\w+)", "_release"),
    (r"set\s+transaction\s+isolation\s+level\s+(?P<level>read\s+committed|repeatable\s+read|serializable)", "_set_transaction"),
    (r"prepare\s+(?P<name>\w+)\s*(?:\([^)]*\)\s*)?as\s+(?P<body>.*)", "_prepare"),
    (r"execute\s+(?P<name>\w+)\s*(?:\((?P<args>.*)\))?", "_execute"),
    (r"deallocate\s+(?:prepare\s+)?(?P<name>\w+)", "_deallocate"),
    (r"show\s+(?P<what>tables|views|materialized\s+views|procedures|triggers)", "_show"),
    (r"desc(?:ribe)?\s+procedure\s+(?P<name>\w+)", "_describe_procedure"),
    (r"desc(?:ribe)?\s+(?:table\s+)?(?P<name>\w+)", "_describe"),
    (r"pragma\s+(?P<name>\w+)\s*(?:\(\s*'?(?P<arg>\w+)'?\s*\)|=\s*'?(?P<value>\w+)'?)?", "_pragma"),
    (r"explain\s+query\s+plan\s+(?P<query>.*)", "_explain_plan"),
    (r"explain\s+(?P<analyze>analyze\s+)?(?P<query>.*)", "_explain"),
    (r"attach\s+(?:database\s+)?'(?P<path>[^']*)'\s+as\s+(?P<name>\w+)", "_attach"),
    (r"detach\s+(?:database\s+)?(?P<name>\w+)", "_detach"),
    (r"(?P<what>vacuum|compact|analyze|reindex|check|doctor)(?:\s+into\s+'(?P<into>[^']*)')?(?:\s+(?P<arg>\w+))?", "_maintain"),
    (r"notify\s+(?P<name>\w+)(?:\s*,\s*'(?P<body>[^']*)')?", "_notify"),
]
