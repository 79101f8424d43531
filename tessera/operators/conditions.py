"""Typed conditions folded into one filter, a conjunctive query builder, and its JSON form with keyset paging."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT, MAX_OFFSET, MAX_COLUMNS = 10_000, 100_000, 4_096
Condition = Callable[[DataFrame], Column]


def eq(column: str, value: object) -> Condition:
    return lambda df: df[column] == F.lit(value)


pk = eq


def is_in(column: str, values: list) -> Condition:
    return lambda df: df[column].isin(list(values))


def prefix(column: str, start: str) -> Condition:
    return lambda df: df[column].startswith(start)


def contains(column: str, *parts: str) -> Condition:
    """Every part occurs, in any order."""

    def made(df: DataFrame) -> Column:
        test = F.lit(True)
        for part in parts:
            test = test & df[column].contains(part)
        return test

    return made


def between(column: str, low: object = None, high: object = None, low_open: bool = False, high_open: bool = False) -> Condition:
    """A range over numbers or times; each bound may be left out or open."""

    def made(df: DataFrame) -> Column:
        c, test = df[column], F.lit(True)
        if low is not None:
            test = test & (c > low if low_open else c >= low)
        if high is not None:
            test = test & (c < high if high_open else c <= high)
        return test

    return made


def is_null(column: str) -> Condition:
    return lambda df: df[column].isNull()


def not_null(column: str) -> Condition:
    return lambda df: df[column].isNotNull()


_KINDS = {
    "pk": lambda c: eq(c["column"], c["value"]), "eq": lambda c: eq(c["column"], c["value"]), "in": lambda c: is_in(c["column"], c["values"]),
    "prefix": lambda c: prefix(c["column"], c["value"]), "contains": lambda c: contains(c["column"], c["value"]), "contains_all": lambda c: contains(c["column"], *c["values"]),
    "range": lambda c: between(c["column"], c.get("min"), c.get("max"), c.get("min_open", False), c.get("max_open", False)), "is_null": lambda c: is_null(c["column"]), "is_not_null": lambda c: not_null(c["column"]),
}


def from_json(spec: dict) -> Condition:
    if spec.get("kind") not in _KINDS:
        raise ValueError(f"unknown condition {spec.get('kind')!r}")
    return _KINDS[spec["kind"]](spec)


def where(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """df where all conditions hold, as one filter that reaches the scan."""
    test = None
    for c in conditions:
        test = c(df) if test is None else test & c(df)
    return df if test is None else df.filter(test)


@dataclass(frozen=True)
class Query:
    """A conjunction with projection, limit and offset. Without an order the rows of a page are Spark's choice."""

    conditions: tuple[Condition, ...] = ()
    columns: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0
    order: tuple[str, ...] = field(default=())

    def where(self, *conditions: Condition) -> Query:
        return replace(self, conditions=(*self.conditions, *conditions))

    def run(self, df: DataFrame) -> DataFrame:
        if (self.limit or 0) > MAX_LIMIT or self.offset > MAX_OFFSET or len(self.columns) > MAX_COLUMNS:
            raise ValueError("limit, offset or projection is too large")
        out = where(df, list(self.conditions))
        if self.order:
            out = out.orderBy(*[F.col(c).asc_nulls_last() for c in self.order])
        if self.offset:
            out = out.offset(self.offset)
        if self.limit is not None:
            out = out.limit(self.limit)
        return out.select(*self.columns) if self.columns else out

    def count(self, df: DataFrame) -> int:
        return where(df, list(self.conditions)).count()

    def exact(self, df: DataFrame, kind: str, column: str | None = None) -> DataFrame:
        """count, sum, min, max or avg over the rows that match, as `value`."""
        f = {"count": lambda c: F.count(c or F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[kind]
        return where(df, list(self.conditions)).agg(f(F.col(column) if column else None).alias("value"))


def page(df: DataFrame, request: dict, secret: bytes, row_id: str = "_row_id", epoch: int = 0) -> tuple[list[dict], str | None]:
    """One page of a JSON request {conditions, projection, limit, cursor} by keyset on row_id, and the cursor of the
    next. A cursor is signed and holds for the epoch it was made at."""
    after, limit = None, min(int(request.get("limit", 100)), MAX_LIMIT)
    if token := request.get("cursor"):
        body, _, mark = token.partition(".")
        if not hmac.compare_digest(mark, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()):
            raise ValueError("the cursor is not one of ours")
        after, made = json.loads(base64.urlsafe_b64decode(body))
        if made != epoch:
            raise ValueError("the cursor is from another epoch")
    out = where(df, [from_json(c) for c in request.get("conditions", [])])
    if after is not None:
        out = out.filter(F.col(row_id) > after)
    columns = request.get("projection") or [c for c in df.columns if c != row_id]
    rows = out.orderBy(row_id).select(row_id, *[F.col(c) for c in columns if c != row_id]).limit(limit + 1).collect()
    token = None
    if len(rows) > limit:
        body = base64.urlsafe_b64encode(json.dumps([rows[limit - 1][row_id], epoch]).encode()).decode()
        token = f"{body}.{hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()}"
    return [{c: r[c] for c in columns} for r in rows[:limit]], token
