"""A versioned table store on Parquet: epochs, upserts, deletes, constraints, TTL, time travel and a change log.

One manifest file for each epoch names, for every table, its schema and its runs. A run is a Parquet folder: `rows` hold
values with _row_id and _epoch, `tombs` the ids that ended at an epoch. Reading takes the rows of the runs up to an epoch
without those that a later tombstone names, so a change writes what changed and reads never rewrite. Pure appends read
without any join. A commit is the creation of the next manifest file; who comes second finds it there and fails, so
writers are serialised by the file system, and a manifest names only folders that are complete.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sql import register

HIDDEN = ("_row_id", "_epoch")
UNITS = {"nanosecond": 1, "microsecond": 10**3, "millisecond": 10**6, "second": 10**9, "minute": 60 * 10**9, "hour": 3600 * 10**9, "day": 86400 * 10**9, "week": 7 * 86400 * 10**9}


ORDERED = ("bigint", "double", "date", "timestamp")  # columns whose ends a run's manifest entry holds
MOST_KEYS = 10_000  # idempotency keys that a store remembers
MOST_RUNS = 128  # a table of more is compacted when it is committed


class StoreError(Exception):
    pass


class ConstraintError(StoreError):
    pass


class ConflictError(StoreError):
    pass


def ttl_nanos(text: str) -> int:
    """'7 days' in nanoseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m[2] not in UNITS:
        raise StoreError(f"unknown duration {text!r}")
    return int(m[1]) * UNITS[m[2]]


@dataclass
class ColumnSpec:
    """One column. default: SQL text, 'now' or 'uuid'; variants: the values of an enum."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    auto_increment: bool = False
    variants: list[str] | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    ref_columns: list[str]
    on_delete: str = "restrict"  # or cascade, set null


@dataclass
class TableSpec:
    columns: list[ColumnSpec]
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    ttl_column: str | None = None
    ttl: int | None = None
    indexes: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def from_dict(d: dict) -> TableSpec:
        return TableSpec([ColumnSpec(**c) for c in d["columns"]], d["primary_key"], d["unique"], d["checks"], [ForeignKey(**f) for f in d["foreign_keys"]], d["ttl_column"], d["ttl"], d["indexes"])

    def to_dict(self) -> dict:
        return {**self.__dict__, "columns": [c.__dict__ for c in self.columns], "foreign_keys": [f.__dict__ for f in self.foreign_keys]}

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise StoreError(f"no column {name!r}")


class Files:
    """Text files and folders of the store through Hadoop's file systems, so any path that Spark writes will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return p.getFileSystem(self.conf), p

    def create(self, path: str, text: str) -> bool:
        """Write a whole file that must not exist: it appears by a rename; False if it is there."""
        fs, target = self._at(path)
        if fs.exists(target):
            return False
        _, draft = self._at(f"_tmp/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(target.getParent())
        done = not fs.exists(target) and fs.rename(draft, target)
        if not done:
            fs.delete(draft, False)
        return bool(done)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Store:
    """A database of versioned tables under one path. Writes are staged; commit() makes the next epoch."""

    def __init__(self, spark: SparkSession, path: str, retain: int = 100) -> None:
        self.spark, self.path, self.retain = spark, path.rstrip("/"), retain
        self.files = Files(spark, path)
        self.base = self._load(max(self.epochs(), default=0))
        self.work = copy.deepcopy(self.base)
        self.last_changes = self.total_changes = self.last_row_id = 0

    # Epochs and manifests

    def epochs(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names("_manifest") if n.endswith(".json"))

    def _load(self, epoch: int) -> dict:
        if not epoch:
            return {"epoch": 0, "tables": {}, "views": {}, "materialized": {}, "procedures": {}, "triggers": {}}
        return json.loads(self.files.read(f"_manifest/{epoch:012d}.json"))

    @property
    def epoch(self) -> int:
        return self.base["epoch"]

    def at(self, epoch: int) -> dict:
        if epoch > self.epoch:
            raise StoreError(f"epoch {epoch} is in the future")
        if epoch and epoch not in self.epochs():
            raise StoreError(f"epoch {epoch} is no longer retained")
        return self._load(epoch)

    def refresh(self) -> None:
        self.base = self._load(max(self.epochs(), default=0))
        self.work = copy.deepcopy(self.base)

    def dirty(self) -> bool:
        return self.work != self.base

    def commit(self) -> int:
        if not self.dirty():
            return self.epoch
        for name, table in self.work["tables"].items():
            if len(table["runs"]) > MOST_RUNS:
                self.compact(name)
        new = {**self.work, "epoch": self.epoch + 1}
        if not self.files.create(f"_manifest/{new['epoch']:012d}.json", json.dumps(new)):
            self.rollback()
            raise ConflictError("another writer committed first")
        self.base, self.work = new, copy.deepcopy(new)
        for old in self.epochs()[: -self.retain]:
            self.files.delete(f"_manifest/{old:012d}.json")
        return new["epoch"]

    def rollback(self) -> None:
        self.work = copy.deepcopy(self.base)

    def savepoint(self) -> dict:
        return copy.deepcopy(self.work)

    def rollback_to(self, point: dict) -> None:
        self.work = copy.deepcopy(point)

    # Catalogue

    def create_table(self, name: str, spec: TableSpec, if_not_exists: bool = False) -> None:
        if name in self.work["tables"]:
            if if_not_exists:
                return
            raise StoreError(f"table {name!r} exists")
        self.work["tables"][name] = {"spec": spec.to_dict(), "runs": [], "next": 1, "generation": 0}

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.work["tables"]:
            if if_exists:
                return
            raise StoreError(f"no table {name!r}")
        del self.work["tables"][name]
        rules = self.work.get("security", {})
        for home in ("policies", "masks"):
            if home in rules:
                rules[home] = [r for r in rules[home] if r["table"] != name]

    def spec(self, name: str, state: dict | None = None) -> TableSpec:
        tables = (state or self.work)["tables"]
        if name not in tables:
            raise StoreError(f"no table {name!r}")
        return TableSpec.from_dict(tables[name]["spec"])

    def set_spec(self, name: str, spec: TableSpec) -> None:
        self.work["tables"][name]["spec"] = spec.to_dict()

    def rename_table(self, old: str, new: str) -> None:
        self.spec(old)
        if new in self.work["tables"]:
            raise StoreError(f"table {new!r} exists")
        self.work["tables"][new] = self.work["tables"].pop(old)
        for table in self.work["tables"].values():
            for fk in table["spec"]["foreign_keys"]:
                fk["table"] = new if fk["table"] == old else fk["table"]
        rules = self.work.get("security", {})
        for entry in [*self.work["triggers"].values(), *rules.get("policies", []), *rules.get("masks", [])]:
            entry["table"] = new if entry["table"] == old else entry["table"]
        if old in rules.get("enabled", []):
            rules["enabled"] = sorted({*rules["enabled"], new} - {old})
        if old in self.work.get("virtual", {}):
            self.work["virtual"][new] = self.work["virtual"].pop(old)

    def add_column(self, table: str, column: ColumnSpec) -> None:
        spec = self.spec(table)
        if column.name in spec.names():
            raise StoreError(f"column {column.name!r} exists")
        spec.columns.append(column)
        self.set_spec(table, spec)

    def drop_column(self, table: str, column: str) -> None:
        spec = self.spec(table)
        if column in spec.primary_key:
            raise StoreError("a primary key's column stays")
        spec.columns.remove(spec.column(column))
        self.set_spec(table, spec)

    def rename_column(self, table: str, old: str, new: str) -> None:
        spec = self.spec(table)
        spec.column(old).name = new
        swap = lambda names: [new if n == old else n for n in names]
        spec.primary_key, spec.unique = swap(spec.primary_key), [swap(u) for u in spec.unique]
        self.set_spec(table, spec)
        for run in self.work["tables"][table]["runs"]:
            run.setdefault("renames", {})[new] = run.get("renames", {}).pop(old, old)

    # Reading

    def read(self, name: str, epoch: int | None = None, hidden: bool = False, after: int = -1, expired: bool = False) -> DataFrame:
        """The table's rows at an epoch (default: with what is staged). after: rows of later epochs alone."""
        state = self.work if epoch is None else self.at(epoch)
        spec, table = self.spec(name, state), state["tables"][name]
        rows, alike = None, {}
        for run in table["runs"]:  # runs of one shape are one scan
            if run["kind"] == "rows" and run["epoch"] > after:
                shape = (json.dumps(run["columns"]) if "columns" in run else run["path"], json.dumps(run.get("renames", {}), sort_keys=True))
                alike.setdefault(shape, []).append(run)
        for runs in alike.values():
            names, ddl = runs[0].get("renames", {}), runs[0].get("columns")
            reader = self.spark.read.schema(", ".join(f"`{c}` {t}" for c, t in ddl)) if ddl else self.spark.read
            part = reader.parquet(*[f"{self.path}/{r['path']}" for r in runs])
            there = set(part.columns)
            cols = [(F.col(names.get(c.name, c.name)) if names.get(c.name, c.name) in there else F.lit(None)).cast(c.type).alias(c.name) for c in spec.columns]
            part = part.select(*cols, *HIDDEN)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type}" for c in spec.columns) + ", _row_id long, _epoch long")
        tombs = [f"{self.path}/{r['path']}" for r in table["runs"] if r["kind"] == "tombs"]
        if tombs:
            dead = self.spark.read.parquet(*tombs).groupBy("_row_id").agg(F.max("_epoch").alias("_until"))
            rows = rows.join(dead, (rows["_row_id"] == dead["_row_id"]) & (rows["_epoch"] < dead["_until"]), "left_anti")
        if spec.ttl_column and not expired:
            rows = rows.filter(self._age(spec) > F.unix_micros(F.current_timestamp()) * 1000)
        return rows if hidden else rows.drop(*HIDDEN)

    @staticmethod
    def _age(spec: TableSpec) -> Column:
        """When a row expires, in nanoseconds; rows without a time never do."""
        c = spec.column(spec.ttl_column)
        at = F.unix_micros(F.col(c.name)) * 1000 if c.type.startswith("timestamp") else F.col(c.name).cast("bigint")
        return F.coalesce(at + F.lit(spec.ttl), F.lit((1 << 63) - 1))

    def statistics(self, name: str) -> dict | None:
        """rows, and ends (least and greatest value as text) by column, from the manifest alone; None where rows have ended, may
        expire, or a run holds none."""
        table, spec = self.work["tables"][name], self.spec(name)
        runs = table["runs"]
        if spec.ttl_column or any(r["kind"] != "rows" or "rows" not in r or r.get("renames") for r in runs):
            return None
        ends: dict[str, list] = {}
        for c in spec.columns:
            held = [r["ends"].get(c.name) for r in runs if r["rows"]]
            if all(h is not None for h in held) and (c.type in ORDERED or c.type.startswith("decimal")):
                ends[c.name] = [[h[0] for h in held if h[0] is not None], [h[1] for h in held if h[1] is not None]]
        return {"rows": sum(r["rows"] for r in runs), "ends": ends}

    def view(self, name: str) -> DataFrame:
        return self.spark.sql(self.work["views"][name])

    # Writing

    def _run(self, name: str, df: DataFrame, kind: str, epoch: int) -> DataFrame:
        """Write a run and add it to the staged manifest; what was written, read back."""
        path = f"{name}/{kind}-{epoch:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{path}")
        self.work["tables"][name]["runs"].append({"kind": kind, "epoch": epoch, "path": path, "columns": df.dtypes})
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{path}")

    def _stamp(self, name: str) -> int:
        """Epochs inside a commit step by one for each statement, between those of whole commits."""
        table = self.work["tables"][name]
        table["clock"] = table.get("clock", 0) + 1
        return table["clock"]

    def prepared(self, name: str, df: DataFrame) -> DataFrame:
        """df with all columns of the table: defaults where it lacks one, casts, NOT NULL and enums checked on write."""
        spec, cols = self.spec(name), []
        if extra := set(df.columns) - {*spec.names(), *HIDDEN}:
            raise StoreError(f"no column {sorted(extra)}")
        for c in spec.columns:
            if c.name in df.columns:
                value = df[c.name]
            elif c.default == "now":
                value = F.current_timestamp()
            elif c.default == "uuid":
                value = F.expr("uuid()")
            else:
                value = F.expr(c.default) if c.default is not None else F.lit(None)
            value = value.cast(c.type)
            if not c.nullable and not c.auto_increment:
                value = F.coalesce(value, F.raise_error(F.lit(f"{name}.{c.name} is not null")).cast(c.type))
            if c.variants:
                good = F.coalesce(value.isin(c.variants), F.lit(True))
                value = F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{name}.{c.name} has no value "), value)).cast(c.type))
            cols.append(value.alias(c.name))
        return df.select(*cols, *[h for h in HIDDEN if h in df.columns])

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        """Write rows as a run with ids; df may carry _row_id of rows it replaces. Ids are never used again: a write
        takes the numbers from `next` on, spread over its partitions."""
        table, spec, stamp = self.work["tables"][name], self.spec(name), self._stamp(name)
        df = self.prepared(name, df)
        fresh = F.lit(table["next"]) + F.monotonically_increasing_id()
        row_id = F.coalesce(F.col("_row_id"), fresh) if "_row_id" in df.columns else fresh
        df = df.withColumn("_row_id", row_id).withColumn("_epoch", F.lit(stamp).cast("long"))
        try:
            done = self._run(name, df, "rows", stamp)
        except Exception as e:
            found = re.search(r"USER_RAISED_EXCEPTION\] ([^\n]*?)(?: SQLSTATE|\n|$)", str(e))
            if found:
                raise ConstraintError(found[1]) from None
            raise
        if auto := [c.name for c in spec.columns if c.auto_increment]:
            # Missing numbers of an auto-increment column follow the largest there is, in the order of the row ids.
            top = self.read(name).agg(*[F.max(c) for c in auto]).first()
            table["runs"].pop()
            numbered = done
            for c, most in zip(auto, top, strict=True):
                numbered = numbered.withColumn(c, F.coalesce(F.col(c), F.lit(most or 0) + F.col("_row_id") - F.lit(table["next"] - 1)).cast(spec.column(c).type))
            done = self._run(name, numbered, "rows", stamp)
        ordered = [c.name for c in spec.columns if c.type in ORDERED or c.type.startswith("decimal")]
        ends = [f(F.col(c)).cast("string").alias(f"{w}_{c}") for c in ordered for w, f in (("min", F.min), ("max", F.max))]
        stats = done.agg(F.max("_row_id").alias("top"), F.count("*").alias("n"), *ends).first()
        table["runs"][-1] |= {"rows": stats["n"], "ends": {c: [stats[f"min_{c}"], stats[f"max_{c}"]] for c in ordered}}
        if stats["top"] is not None:
            table["next"] = max(table["next"], stats["top"] + 1)
            self.last_row_id = stats["top"]
        self._count(stats["n"])
        return done

    def _count(self, n: int) -> None:
        self.last_changes = n
        self.total_changes += n

    def _bury(self, name: str, ids: DataFrame) -> None:
        stamp = self._stamp(name)
        self.work["tables"][name]["generation"] += 1
        self._run(name, ids.select("_row_id", F.lit(stamp).cast("long").alias("_epoch")), "tombs", stamp)

    def insert(self, name: str, df: DataFrame, on_conflict: str = "error", assignments: dict[str, str] | None = None) -> int:
        """Append rows. on_conflict over the primary key: error, nothing, or update (assignments: column to SQL over the
        table's columns and excluded.column; all columns are taken from the new row without it)."""
        spec, point = self.spec(name), self.savepoint()
        try:
            if on_conflict != "error" and spec.primary_key:
                df = self._settled(name, spec, self.prepared(name, df), on_conflict, assignments)
            done = self._write(name, df)
            changed = self.last_changes
            self._check(name, done)
            self._log(name, done, "insert" if on_conflict == "error" else "upsert")
            self.last_changes = changed
            return changed
        except Exception:
            self.rollback_to(point)
            raise

    def _settled(self, name: str, spec: TableSpec, new: DataFrame, on_conflict: str, assignments: dict[str, str] | None) -> DataFrame:
        """The rows that a conflict rule leaves to write. Rows that change bring their _row_id, whose old version ends."""
        keys = spec.primary_key
        held = self.read(name, hidden=True)
        if on_conflict == "nothing":
            return new.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")
        new, old = new.alias("excluded"), held.alias("held")
        both = new.join(old, [F.col(f"excluded.{k}") == F.col(f"held.{k}") for k in keys], "left")
        hit = F.col("held._row_id").isNotNull()

        def value(c: str) -> Column:
            if assignments is None:
                return F.col(f"excluded.{c}")
            kept = F.expr(_qualified(assignments[c], spec.names())) if c in assignments else F.col(f"held.{c}")
            return F.when(hit, kept).otherwise(F.col(f"excluded.{c}"))

        merged = both.select(*[value(c).alias(c) for c in spec.names()], F.col("held._row_id").alias("_row_id"))
        path = f"{name}/merge-{uuid.uuid4().hex}"
        merged.write.parquet(f"{self.path}/{path}")
        merged = self.spark.read.schema(merged.schema).parquet(f"{self.path}/{path}")
        self._bury(name, merged.filter("_row_id IS NOT NULL"))
        return merged

    def delete(self, name: str, condition: str | Column | None = None, order_by: list[str] | None = None, limit: int | None = None) -> int:
        return self.delete_rows(name, self.matched(name, condition, order_by, limit))

    def delete_rows(self, name: str, rows: DataFrame) -> int:
        """Delete rows of the table (with _row_id), and what refers to them as its foreign keys say."""
        point = self.savepoint()
        try:
            gone = self._kept(name, rows)
            n = gone.count()
            if n:
                for child, child_spec in ((t, self.spec(t)) for t in list(self.work["tables"])):
                    for fk in child_spec.foreign_keys:
                        if fk.table == name:
                            self._orphan(child, fk, gone)
                self._bury(name, gone)
                self._log(name, gone, "delete")
            self._count(n)
            return n
        except Exception:
            self.rollback_to(point)
            raise

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written down, so that what follows sees one answer."""
        path = f"{name}/match-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{path}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{path}")

    def matched(self, name: str, condition: str | Column | None, order_by: list[str] | None = None, limit: int | None = None, only: Column | None = None) -> DataFrame:
        """Matching rows with their hidden columns; `only` holds for all of them before order and limit count."""
        rows = self.read(name, hidden=True)
        if only is not None:
            rows = rows.filter(only)
        if condition is not None:
            rows = rows.filter(condition)
        if order_by:
            rows = rows.orderBy(*[F.expr(o) if not re.search(r"\b(asc|desc)\b", o, re.I) else _ordered(o) for o in order_by])
        return rows if limit is None else rows.limit(limit)

    def _orphan(self, child: str, fk: ForeignKey, gone: DataFrame) -> None:
        keys = gone.select(*[F.col(r).alias(c) for c, r in zip(fk.columns, fk.ref_columns, strict=True)]).distinct()
        rows = self.read(child, hidden=True).join(keys, fk.columns, "left_semi")
        if rows.isEmpty():
            return
        if fk.on_delete == "restrict":
            raise ConstraintError(f"{child} refers to rows of {fk.table}")
        if fk.on_delete == "cascade":
            self._cascade(child, rows)
        else:
            changed = rows
            for c in fk.columns:
                changed = changed.withColumn(c, F.lit(None).cast(self.spec(child).column(c).type))
            changed = self._kept(child, changed)
            self._bury(child, changed)
            self._log(child, self._write(child, changed.drop("_epoch")), "update")

    def _cascade(self, child: str, rows: DataFrame) -> None:
        gone = self._kept(child, rows)
        for other in list(self.work["tables"]):
            for fk in self.spec(other).foreign_keys:
                if fk.table == child:
                    self._orphan(other, fk, gone)
        self._bury(child, gone)
        self._log(child, gone, "delete")

    def update(self, name: str, assignments: dict[str, str | Column], condition: str | Column | None = None, order_by: list[str] | None = None, limit: int | None = None) -> int:
        spec = self.spec(name)
        rows = self._kept(name, self.matched(name, condition, order_by, limit))
        values = {c: F.expr(a) if isinstance(a, str) else a for c, a in assignments.items()}
        for c in values:
            spec.column(c)
        changed = rows.select(*[(values[c].cast(spec.column(c).type) if c in values else F.col(c)).alias(c) for c in spec.names()], "_row_id")
        n = rows.count()
        if n:
            self.replace_rows(name, rows, changed)
        self.last_changes = n
        return n

    def replace_rows(self, name: str, old: DataFrame, new: DataFrame) -> None:
        """End the versions `old` and write `new` (with the same _row_id)."""
        point = self.savepoint()
        try:
            self._bury(name, old)
            done = self._write(name, new)
            self._check(name, done)
            self._log(name, done, "update")
        except Exception:
            self.rollback_to(point)
            raise

    def written(self, name: str, after: int) -> DataFrame:
        """The table's rows that statements after a stamp of its clock wrote."""
        return self.read(name, hidden=True, expired=True).filter(F.col("_epoch") > after)

    def truncate(self, name: str) -> None:
        self.spec(name)
        table = self.work["tables"][name]
        table["runs"], table["generation"] = [], table["generation"] + 1
        self._stamp(name)
        event = self.spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS _row_id", *[f"CAST(NULL AS {c.type}) AS `{c.name}`" for c in self.spec(name).columns])
        self._log(name, event, "truncate")

    def batch(self, steps: list[dict], key: str | None = None) -> dict:
        """Steps {op: put | upsert | delete | delete_by_pk, table, rows | where | key} as one commit. A key that was used
        before gives the answer of then and changes nothing."""
        done = self.work.get("batches", {})
        if key is not None and key in done:
            return {**done[key], "replayed": True}
        point, counts = self.savepoint(), []
        try:
            for s in steps:
                table, op = s["table"], s["op"]
                if op in ("put", "upsert"):
                    spec = self.spec(table)
                    df = s["rows"]
                    if not isinstance(df, DataFrame):
                        names = [c for c in spec.names() if c in {k for r in s["rows"] for k in r}]
                        df = self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in s["rows"]], ", ".join(f"`{c}` {spec.column(c).type}" for c in names))
                    counts.append(self.insert(table, df, "update" if op == "upsert" else "error"))
                elif op == "delete":
                    counts.append(self.delete(table, s["where"]))
                elif op == "delete_by_pk":
                    keys = self.spec(table).primary_key
                    values = s["key"] if isinstance(s["key"], (list, tuple)) else [s["key"]]
                    test = F.lit(True)
                    for k, v in zip(keys, values, strict=True):
                        test = test & (F.col(k) == F.lit(v))
                    counts.append(self.delete(table, test))
                else:
                    raise StoreError(f"unknown step {op!r}")
            answer = {"epoch": self.epoch + 1, "changes": counts}
            if key is not None:
                kept = {**self.work.get("batches", {}), key: answer}
                self.work["batches"] = dict(list(kept.items())[-MOST_KEYS:])
            self.commit()
            return {**answer, "replayed": False}
        except Exception:
            self.rollback_to(point)
            raise

    def apply_changes(self, name: str, changes: DataFrame, source: str, position: str, op: str = "op") -> int:
        """Apply another database's change rows (op insert, update or delete; all columns of the table; an increasing position)
        as one commit: of each key the last change counts. The position is kept with the store, so rows that were applied
        before, also by a run that was cut off, are passed over."""
        spec = self.spec(name)
        done = self.work.get("positions", {}).get(source)
        fresh = changes if done is None else changes.filter(F.col(position) > F.lit(done))
        fresh = self._kept(name, fresh)
        top = fresh.agg(F.max(position)).first()[0]
        if top is None:
            return 0
        point = self.savepoint()
        try:
            whole = F.max_by(F.struct(*[c for c in fresh.columns if c not in spec.primary_key]), F.col(position)).alias("_last")
            last = self._kept(name, fresh.groupBy(*spec.primary_key).agg(whole).select(*spec.primary_key, "_last.*"))
            ended = self.read(name, hidden=True).join(last.filter(F.col(op) == "delete").select(*spec.primary_key), spec.primary_key, "left_semi")
            n = self.delete_rows(name, ended)
            n += self.insert(name, last.filter(F.col(op) != "delete").select(*spec.names()), "update")
            self.work["positions"] = {**self.work.get("positions", {}), source: top}
            self.commit()
            return n
        except Exception:
            self.rollback_to(point)
            raise

    # Constraints

    def _check(self, name: str, new: DataFrame) -> None:
        """Constraints over what was just written: keys unique in the table, checks not false, parents there."""
        spec = self.spec(name)
        for keys in ([spec.primary_key] if spec.primary_key else []) + spec.unique:
            given = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
            if keys == spec.primary_key and not new.filter(f"NOT ({given})").isEmpty():
                raise ConstraintError(f"{name}: a primary key is not null")
            # Only keys among the new rows can be new duplicates.
            held = self.read(name, expired=True).filter(given).join(new.select(*keys).distinct(), keys, "left_semi")
            if not held.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ConstraintError(f"{name}: {', '.join(keys)} is unique")
        for check in spec.checks:
            register(self.spark, check)
            if not new.filter(f"({check}) IS FALSE").isEmpty():
                raise ConstraintError(f"{name}: check {check} failed")
        for fk in spec.foreign_keys:
            given = new.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in fk.columns)).select(*fk.columns)
            parents = self.read(fk.table).select(*[F.col(r).alias(c) for c, r in zip(fk.columns, fk.ref_columns, strict=True)])
            if not given.join(parents, fk.columns, "left_anti").isEmpty():
                raise ConstraintError(f"{name}: no row of {fk.table} for {', '.join(fk.columns)}")

    # Changes

    def _log(self, name: str, rows: DataFrame, op: str) -> None:
        """A change event for each row, in the folder that changes() and a file stream read. Events of a commit that
        never happens stay invisible: readers join the manifest's list."""
        epoch, stamp = self.epoch + 1, self.work["tables"][name].get("clock", 0)
        path = f"_changes/{epoch:012d}-{stamp:06d}-{uuid.uuid4().hex}"
        spec = self.spec(name)
        event = rows.select(F.lit(epoch).cast("long").alias("epoch"), F.lit(stamp).cast("long").alias("step"), F.lit(name).alias("table"), F.lit(op).alias("op"), F.col("_row_id").alias("row_id"), F.to_json(F.struct(*spec.names()), {"ignoreNullFields": "false"}).alias("row"))
        event.write.parquet(f"{self.path}/{path}")
        self.work.setdefault("log", []).append(path)

    EVENTS = "epoch long, step long, table string, op string, row_id long, row string"

    def changes(self, after: int = 0) -> DataFrame:
        """Committed events of epochs after `after`; an error if some of them are no longer there."""
        kept = [int(p.split("/")[1].split("-")[0]) for p in self.base.get("log", [])]
        if after < self.base.get("log_floor", 0):
            raise StoreError(f"events after epoch {after} are no longer retained")
        paths = [f"{self.path}/{p}" for p, e in zip(self.base.get("log", []), kept, strict=True) if e > after]
        return self.spark.read.schema(self.EVENTS).parquet(*paths) if paths else self.spark.createDataFrame([], self.EVENTS)

    def change_stream(self) -> DataFrame:
        """A streaming DataFrame of events; of every write, also those rolled back: filter by committed epochs."""
        return self.spark.readStream.schema(self.EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.path}/_changes")

    def trim_changes(self, upto: int) -> None:
        self.work["log_floor"] = upto
        self.work["log"] = [p for p in self.work.get("log", []) if int(p.split("/")[1].split("-")[0]) > upto]

    # Maintenance

    def compact(self, name: str) -> None:
        """Rewrite a table's runs as one, without what is dead; older epochs keep their runs."""
        rows = self.read(name, hidden=True, expired=False)
        path = f"{name}/rows-compact-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{path}")
        table = self.work["tables"][name]
        table["runs"] = [{"kind": "rows", "epoch": table.get("clock", 0), "path": path, "columns": rows.dtypes}]
        table["generation"] += 1  # what counted rows by their run's epoch counts anew

    def vacuum(self) -> list[str]:
        """Delete folders that no retained manifest names."""
        used = {r["path"] for e in [*self.epochs(), None] for t in (self._load(e) if e else self.work)["tables"].values() for r in t["runs"]}
        gone = []
        for table in self.files.names(""):
            if not table.startswith("_"):
                gone += [f"{table}/{n}" for n in self.files.names(table) if f"{table}/{n}" not in used]
        for path in gone:
            self.files.delete(path)
        return gone

    def backup(self, path: str) -> Store:
        """The committed state in another place, compacted."""
        other = Store(self.spark, path)
        for name in self.base["tables"]:
            other.create_table(name, self.spec(name, self.base))
            other._run(name, self.read(name, epoch=self.epoch, hidden=True), "rows", 1)
            other.work["tables"][name] |= {"next": self.base["tables"][name]["next"], "clock": 1}
        for part in ("views", "materialized", "procedures", "triggers", "security", "virtual"):
            if part in self.base:
                other.work[part] = copy.deepcopy(self.base[part])
        for view in other.work["materialized"].values():
            view["clock"] = -1  # the copy has no change log of before, so the first refresh is a full one
        other.commit()
        return other


def _ordered(text: str) -> Column:
    body, way = re.fullmatch(r"(.+?)\s+(asc|desc)", text.strip(), re.I).groups()
    return F.expr(body).asc_nulls_last() if way.lower() == "asc" else F.expr(body).desc_nulls_last()


def _qualified(text: str, names: list[str]) -> str:
    """Bare column names mean the held row."""
    return re.sub(rf"(?<![\w.'])({'|'.join(map(re.escape, names))})\b(?!\s*\(|')", r"held.\1", text)
