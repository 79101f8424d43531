"""Sources and sinks: TSV, Arrow, JDBC, bulk load, result streaming, and modules as Python data sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_OUT = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def _escape(c: Column) -> Column:
    c = c.cast("string")
    for raw, written in _OUT:
        c = F.replace(c, F.lit(raw), F.lit(written))
    return F.coalesce(c, F.lit(""))


def _unescape(c: Column) -> Column:
    """Escapes read from the left: the doubled backslash first becomes a mark that no file holds."""
    c = F.replace(c, F.lit("\\\\"), F.lit(""))
    for raw, written in _OUT[1:]:
        c = F.replace(c, F.lit(written), F.lit(raw))
    return F.nullif(F.replace(c, F.lit(""), F.lit("\\")), F.lit(""))


def write_tsv(df: DataFrame, path: str) -> None:
    """A header, tabs between fields, null as nothing, backslash escapes; a folder of parts, each with the header."""
    text = df.select(*[_escape(F.col(c)).alias(c) for c in df.columns])
    text.write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's columns by name, cast to the schema; an empty field is null."""
    want = spark.createDataFrame([], schema).schema
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("inferSchema", False).csv(path)
    return raw.select(*[_unescape(F.col(f.name)).cast(f.dataType).alias(f.name) for f in want.fields])


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def stream_rows(df: DataFrame) -> Iterator:
    """Rows partition by partition, one partition on the driver at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def bulk_load(df: DataFrame, path: str, sort_by: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet with rows sorted inside partitions, so that row-group and page statistics prune later filters."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A snapshot of a database's table; with a numeric key it is read in parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


@dataclass
class Message(WriterCommitMessage):
    value: object


class _Part(InputPartition):
    def __init__(self, number: int, of: int) -> None:
        self.number, self.of = number, of


def copy_snapshot(store, name: str, chunks: dict[str, Callable[[], DataFrame]]) -> list[str]:
    """Copy another database's table chunk by chunk (a name, and what reads it); the chunks copied now. A chunk is one commit
    under its name, so a copy that was cut off goes on with the chunks it lacks."""
    done = []
    for chunk, read in chunks.items():
        key = f"snapshot:{name}:{chunk}"
        if key not in store.work.get("batches", {}):
            store.batch([{"op": "put", "table": name, "rows": read()}], key)
            done.append(chunk)
    return done


def register_module(spark: SparkSession, name: str, schema: str, scan: Callable[[dict, int, int], Iterator[tuple]], parts: int = 1, filters: Callable[[list], tuple[list, dict]] | None = None, write: Callable[[dict, Iterator], object] | None = None, commit: Callable[[dict, list], None] | None = None) -> None:
    """A virtual table: spark.read.format(name).options(...).load() yields what scan(options, part, parts) yields.
    filters takes the offered predicates and returns those it leaves to Spark, and options for its scan. write takes a task's
    rows and returns a message; commit takes the messages of all tasks, once all have come."""
    module = name

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return [_Part(i, parts) for i in range(parts)]

        def read(self, partition: _Part) -> Iterator[tuple]:
            yield from scan(self.options, partition.number, partition.of)

    if filters:

        def push(self, offered: list) -> Iterator:
            rest, more = filters(list(offered))
            self.options |= more
            return iter(rest)

        Reader.pushFilters = push

    class Writer(DataSourceWriter):
        def __init__(self, options: dict) -> None:
            self.options = dict(options)

        def write(self, rows: Iterator) -> Message:
            return Message(write(self.options, rows))

        def commit(self, messages: list) -> None:
            if commit:
                commit(self.options, [m.value for m in messages if m is not None])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return module

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    if write:
        Source.writer = lambda self, schema, overwrite: Writer(self.options)

    spark.dataSource.register(Source)


def register_scalar(spark: SparkSession, name: str, f: Callable, kind: str) -> None:
    """A function over pandas series, callable from SQL."""
    spark.udf.register(name, F.pandas_udf(f, kind))


def register_aggregate(spark: SparkSession, name: str, f: Callable, kind: str) -> None:
    """A function from a group's pandas series to a value, callable from SQL as an aggregate and over windows of rows.
    It sees a whole group, so it is for groups that fit a task."""
    from pandas import Series

    def over(v):
        return f(v)

    over.__annotations__ = {"v": Series, "return": {"double": float, "bigint": int, "string": str}[kind]}
    spark.udf.register(name, F.pandas_udf(over, kind))


def register_table_function(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], schema: str) -> None:
    """A function from values to rows, callable in FROM, with LATERAL also on columns."""

    class Rows:
        def eval(self, *values):
            yield from f(*values)

    spark.udtf.register(name, F.udtf(Rows, returnType=schema))
