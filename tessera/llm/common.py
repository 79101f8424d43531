"""Helpers that the training-data operators share: shared-folder tables, Arrow batches, block-wise merging.

Lineage is cut by writing a table to the folder that every executor sees (``spark.checkpoint.dir``), never by
keeping blocks on one executor, so a lost executor costs a re-read and not a result.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the query contracts define them: maximal runs outside space and \t\n\v\f\r.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one, removed at exit, only where none is set and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_tessera_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster names its shared folder in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext._tessera_shared = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, evaluates once, survives lost executors, and leaves no
    shuffle files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    for paths in _scopes[-1:]:
        paths.append(path)
    with settings(spark, CLEANUP):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that are written inside are deleted at the end, but for those taken off the list."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def last_of(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """made(), which is the table it wrote last; all others that it wrote are deleted, and this one is the scope's around."""
    with scratch(spark) as written:
        done, own = made(), written.pop()
    for paths in _scopes[-1:]:
        paths.append(own)
    return done


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_ascii(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def split_words(text: Column, gaps: str = BLANKS) -> Column:
    """Array of the words between the gaps; null and empty texts have none."""

    def inner(parts: Column) -> Column:
        size = F.size(parts)
        start = F.when(parts[0] == "", 2).otherwise(1)
        end = F.when(F.element_at(parts, -1) == "", size - 1).otherwise(size)
        return F.slice(parts, start, F.greatest(end - start + 1, F.lit(0)))

    return let(F.split(F.coalesce(text, F.lit("")), gaps, -1), inner)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", most: int = 1 << 20) -> DataFrame:
    """docs but for the ids of `gone` (one column of that name), broadcast while there are at most `most` of them. Rows that
    share an id are one document and go together; a row without an id matches none and stays."""
    name = spare(docs, "gone")
    gone = materialize(gone.select(F.col(id_col).alias(name)).filter(F.col(name).isNotNull()).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(side, docs[id_col].cast("long") == side[name], "left_anti")


def tidy() -> None:
    """Give memory that a worker holds and does not use back to the system: Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a one-element transform binds it to a lambda variable."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, most_bytes: int = 16 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts stay near most_bytes, whatever the size of Spark's Arrow batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(text).nbytes if text else batch.nbytes
        rows = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(size, 1))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, most_bytes: int = 16 << 20) -> Iterator[None]:
    """Jobs inside hand Python at most so many rows and about so many bytes a batch."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(most_bytes)}):
        yield


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Spark's settings inside; what they were before holds again after."""
    before = {n: spark.conf.get(n) for n in values}
    for n, v in values.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def tree_merge(df: DataFrame, zero: Callable[[], object], add: Callable[[object, bytes], object], dump: Callable[[object], bytes], fan: int = 64) -> DataFrame:
    """Merge rows (key string, chunk long, blob binary) to one row per key, in two rounds of streamed merging.

    Each task holds one accumulator at a time (its rows are sorted) and never a group of blobs, so memory does not grow with the
    number of chunks; the first round spreads a key over `fan` tasks, so no key meets in one task before it is small.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, acc = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([dump(acc)], pa.binary())], names=["key", "chunk", "blob"])

        for batch in batches:
            for key, chunk, blob in zip(*(batch.column(c) for c in ("key", "chunk", "blob")), strict=True):
                now = (key.as_py(), chunk.as_py())
                if at != now:
                    if at is not None:
                        yield row()
                    at, acc = now, zero()
                acc = add(acc, blob.as_py())
        if at is not None:
            yield row()
        tidy()

    def round_of(part: DataFrame) -> DataFrame:
        return part.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(merge, schema)

    schema = "key string, chunk long, blob binary"
    first = round_of(df.withColumn("chunk", F.pmod("chunk", F.lit(fan))))
    return round_of(first.withColumn("chunk", F.lit(0).cast("long"))).select("key", "blob")
