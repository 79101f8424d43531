"""Aggregates where SQLite's or the percentile family's meaning differs from Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum as a double; 0.0 of nothing."""
    return F.coalesce(F.sum(x).cast("double"), F.lit(0.0))


def group_concat(x: Column, sep: str = ",", order_by: Column | None = None) -> Column:
    """Values that are not null, joined; in the order of order_by if given."""
    if order_by is None:
        return F.string_agg(x.cast("string"), F.lit(sep))
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order_by.alias("k"), x.cast("string").alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), sep))


def _checked(x: Column, p: float, top: float) -> Column:
    if p is None or not 0 <= p <= top:
        raise ValueError(f"a percentile's argument lies between 0 and {top:g}")
    v = x.cast("double")
    endless = F.abs(v) == F.lit(float("inf"))
    return F.when(endless, F.raise_error(F.lit("percentile of an infinite value")).cast("double")).when(~F.isnan(v), v)


def percentile_cont(x: Column, p: float) -> Column:
    """Linear interpolation, p from 0 to 1; nulls and NaN are left out, infinities are an error."""
    return F.percentile(_checked(x, p, 1.0), p)


def percentile(x: Column, p: float) -> Column:
    """percentile_cont with p from 0 to 100."""
    return F.percentile(_checked(x, p, 100.0), p / 100)


def median(x: Column) -> Column:
    return percentile_cont(x, 0.5)


def percentile_disc(x: Column, p: float) -> Column:
    """The value at index floor(p (n - 1)) of the sorted values: it gathers a group's values, so it is for groups that
    fit a task; percentile_disc_table has no such bound."""
    values = F.array_sort(F.collect_list(_checked(x, p, 1.0)))
    return F.when(F.size(values) > 0, F.get(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int")))


def percentile_disc_table(df: DataFrame, x: str, p: float, by: list[str], accuracy: int = 10_000) -> DataFrame:
    """percentile_disc of a column for each group without gathering or sorting a group's values.

    Two approximate percentiles, whose rank error is at most n / accuracy, bound the value from below and above. Values under
    the lower bound are counted as one and those over the upper bound are dropped, map-side, so that a share of about
    6 / accuracy of a group is left to be sorted. The answer is exact."""
    from pyspark.sql import Window

    values = df.select(*by, _checked(F.col(x), p, 1.0).alias("_v")).filter("_v IS NOT NULL")
    margin = 3.0 / accuracy
    bounds = values.groupBy(*by).agg(F.count("*").alias("_all"), F.percentile_approx("_v", [max(0.0, p - margin), min(1.0, p + margin)], accuracy).alias("_b"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    near = values.alias("v").join(bounds.alias("b"), same) if by else values.alias("v").crossJoin(F.broadcast(bounds).alias("b"))
    small = F.col("_all") <= accuracy  # a group of few rows is taken whole: there a rank is more than the margin
    near = near.filter(small | (F.col("_v") <= F.col("_b")[1])).select(*[F.col(f"v.{c}").alias(c) for c in by], "_all", F.when(small | (F.col("_v") >= F.col("_b")[0]), F.col("_v")).alias("_v"))
    counts = near.groupBy(*by, "_v").agg(F.count("*").alias("_n"), F.first("_all").alias("_all"))
    w = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w))
    return ranked.filter((F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1))) & F.col("_v").isNotNull()).groupBy(*by).agg(F.min("_v").alias("value"))
