"""Operators that Spark's own need a hand with: recursive UNION, sampled aggregates, incremental aggregates, series."""

from __future__ import annotations

import functools
import json
import math
import statistics
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESERVOIR = 8192
MERGE = 32


def cut(df: DataFrame, keep: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; a temporary folder where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        if not sc.master.startswith("local"):
            raise ValueError("a cluster names its shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=keep)


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, rounds: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: rows of the seed and of step(new rows), round by round, until no new row comes. distinct (UNION)
    drops rows met before; otherwise (UNION ALL) only an empty round ends it. After `rounds` it stops."""
    names = seed.columns
    fresh = cut(seed.distinct() if distinct else seed)
    parts, total = [fresh], fresh
    for _ in range(rounds):
        more = step(fresh).toDF(*names)
        if distinct:
            more = more.distinct().join(total, [more[n].eqNullSafe(total[n]) for n in names], "left_anti")
        fresh = cut(more)
        if fresh.isEmpty():
            return total
        # Each round's rows are written once; every MERGE rounds their pieces become one, so plans stay short.
        parts.append(fresh)
        total = functools.reduce(DataFrame.unionByName, parts)
        if len(parts) > MERGE:
            total = cut(total)
            parts = [total]
    return total


def series(spark: SparkSession, *bounds: int) -> DataFrame:
    """series(stop), series(start, stop[, step]): inclusive, column `value`; empty where the step points away."""
    start, stop, step = (0, bounds[0], 1) if len(bounds) == 1 else (*bounds, 1)[:3]
    if step == 0:
        raise ValueError("a series' step is not 0")
    if max(0, (stop - start) // step + 1) > 1_000_000:
        raise ValueError("a series has at most 1,000,000 rows")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, left_id: str, value: str) -> DataFrame:
    """(left_id, value) of the last right row of the same key at or before each left row; left rows without one are left
    out. Both sides are sorted once by key and time and the last value is carried along: no pair is formed. Of right rows
    at one time the one with the greatest value counts. Nulls in keys and times match nothing."""
    asked = left.select(F.col(by).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.col(left_id).alias("_id"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    held = right.select(F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), F.col(value).alias("_v"))
    both = asked.unionByName(held).filter("_k IS NOT NULL AND _t IS NOT NULL")
    w = Window.partitionBy("_k").orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1 AND _last IS NOT NULL")
    return carried.select(F.col("_id").alias(left_id), F.col("_last").alias(value))


@dataclass(frozen=True)
class Estimate:
    point: float | None
    low: float | None
    high: float | None
    n_population: int
    n_sample: int
    n_passing: int


def approx_aggregate(df: DataFrame, kind: str, column: str | None, key: str, condition: Column | None = None, z: float = 1.96, size: int = RESERVOIR, seed: int = 11) -> Estimate:
    """COUNT, SUM or AVG from a uniform sample of `size` rows with a normal interval and finite-population correction.

    The sample is the rows with the least hashes of their key, so it is the same on any partitioning. Where it covers
    the table, and for an unfiltered count, the answer is exact with width zero. Rows whose value is null do not pass."""
    n = df.count()
    if kind == "count" and condition is None and column is None:
        return Estimate(float(n), float(n), float(n), n, min(n, size), min(n, size))
    passing = condition if condition is not None else F.lit(True)
    value = F.col(column).cast("double") if column else F.lit(1.0)
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    # Twice the share that is wanted has the sample's rows with near certainty, so almost nothing is sorted; else all is.
    low = int(-(1 << 63) + min(1.0, 2.0 * size / max(n, 1)) * ((1 << 64) - 1))
    few = hashed.filter(F.col("_h") <= min(low, (1 << 63) - 1))
    if n > 4 * size and few.count() < size:
        few = hashed
    sample = few.orderBy("_h", key).limit(size)
    kept = sample.select(F.when(F.coalesce(passing, F.lit(False)) & value.isNotNull(), value).alias("v"))
    row = kept.agg(F.count("*").alias("m"), F.count("v").alias("k"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).first()
    m, k, s, q = row["m"], row["k"], row["s"] or 0.0, row["q"] or 0.0
    correction = math.sqrt(max(0.0, (n - m) / max(1, n - 1)))
    if kind == "avg":
        if not k:
            return Estimate(None, None, None, n, m, k)
        point = s / k
        spread = math.sqrt(max(0.0, q / k - point * point) / k)
    elif kind in ("count", "sum"):
        total, square = (float(k), float(k)) if kind == "count" else (s, q)
        point = total * n / m if m else 0.0
        mean = total / m if m else 0.0
        spread = n * math.sqrt(max(0.0, square / m - mean * mean) / m) if m else 0.0
    else:
        raise ValueError(f"unknown aggregate {kind!r}")
    half = z * spread * correction
    return Estimate(point, point - half, point + half, n, m, k)


class IncrementalAggregate:
    """count, sum, min, max and avg of an append-only table: the state of the rows up to an epoch is kept, later calls
    read the rows after it. A table that lost or changed rows since (its `generation` differs) is read anew.

    files: text files that outlive the driver (a store's), where the states are kept under `name`."""

    def __init__(self, files=None, name: str = "_state/aggregates") -> None:
        self.files, self.name, self.states = files, name, {}
        if files is not None and (kept := sorted(files.names(name))):
            self.states = json.loads(files.read(f"{name}/{kept[-1]}"))

    def call(self, rows_after: Callable[[int], DataFrame], epoch: int, generation: int, column: str | None = None, key: str = "") -> dict:
        """{count, sum, min, max, avg, incremental, delta_rows}. rows_after(e): the rows of epochs after e."""
        name = f"{key}|{column}"
        old = self.states.get(name)
        warm = old is not None and old["generation"] == generation and old["epoch"] <= epoch
        value = F.col(column) if column else F.lit(1)
        delta = rows_after(old["epoch"] if warm else -1).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("rows")).first().asDict()
        state = dict(delta)
        if warm:
            state["count"] += old["count"]
            for name_, f in (("sum", lambda a, b: a + b), ("min", min), ("max", max)):
                a, b = old[name_], delta[name_]
                state[name_] = f(a, b) if a is not None and b is not None else a if b is None else b
        state |= {"epoch": epoch, "generation": generation}
        self.states[name] = state
        if self.files is not None:
            old = sorted(self.files.names(self.name))
            self.files.create(f"{self.name}/{int(old[-1].split('.')[0]) + 1 if old else 1:012d}.json", json.dumps(self.states))
            for gone in old:
                self.files.delete(f"{self.name}/{gone}")
        avg = state["sum"] / state["count"] if state["count"] else None
        return {k: state[k] for k in ("count", "sum", "min", "max")} | {"avg": avg, "incremental": warm, "delta_rows": delta["rows"]}


def interval_of(kind: float) -> float:
    """The z of a two-sided confidence level."""
    return statistics.NormalDist().inv_cdf(0.5 + kind / 2)


def less_join(left: DataFrame, right: DataFrame, key: str, low: str, high: str, room: int = 1024) -> DataFrame:
    """Pairs of rows of one key with left's `low` under right's `high`; the columns of both, whose names differ but for the key.

    A key's left rows are cut in runs of `room` by `low`. A right row goes to the runs whose least is under its `high` alone, so
    each of these gives it a pair, and only the last can hold rows that give none: work is linear but for the pairs themselves
    and a look at the runs' least values."""
    runs = Window.partitionBy(key).orderBy(low)
    cut_up = left.filter(F.col(key).isNotNull() & F.col(low).isNotNull()).withColumn("_run", F.floor((F.row_number().over(runs) - 1) / room))
    least = cut_up.groupBy(key, "_run").agg(F.min(low).alias("_least"))
    least = least.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_least"))), lambda r: r["_least"]).alias("_least"))
    under = F.size(F.filter("_least", lambda m: m < F.col(high)))
    sent = right.join(least, key).withColumn("_n", under).filter("_n > 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return cut_up.join(sent.drop("_least", "_n"), [key, "_run"]).filter(F.col(low) < F.col(high)).drop("_run")
