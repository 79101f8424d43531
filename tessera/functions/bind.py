"""Evaluate a Column once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value bound to a lambda variable: Catalyst would write an expression out wherever it is named."""
    return F.transform(F.array(value), body)[0]
