"""Date and time functions of SQLite's shape, in UTC. All are expressions; formats and modifiers are literals.

A number, or text that is one, counts Unix seconds; other text is RFC 3339, a date with or without time, or a time on
1970-01-01; 'now', '' and a missing value mean the current time. Anything else gives null, as does an unknown modifier.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPES = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
_TIME = r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"
_UNITS = {"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def moment(value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    """The timestamp a value means after its modifiers. kind: 'text', 'number' or 'timestamp', the column's type."""
    if value is None:
        at = F.current_timestamp()
    elif kind == "timestamp":
        at = F.coalesce(value.cast("timestamp"), F.current_timestamp())
    elif kind == "number":
        at = F.coalesce(F.timestamp_seconds(value.cast("double")), F.current_timestamp())
    else:
        text = F.trim(value)
        number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
        parsed = F.when(text.rlike(_SHAPES), text.try_cast("timestamp")).when(text.rlike(_TIME), F.concat(F.lit("1970-01-01 "), text).try_cast("timestamp"))
        at = F.when(value.isNull() | (text == "") | (F.lower(text) == "now"), F.current_timestamp()).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(parsed)
    for modifier in modifiers:
        at = _modified(at, modifier.strip().lower())
    return at


def _modified(at: Column, modifier: str) -> Column:
    if modifier == "unixepoch":
        return at
    if modifier == "start of day":
        return F.date_trunc("day", at)
    if m := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second)s?", modifier):
        seconds = float(m[1]) * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[m[2]]
        return F.timestamp_micros(F.unix_micros(at) + F.lit(round(seconds * 1_000_000)))
    return F.lit(None).cast("timestamp")


def date(value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    return F.date_format(moment(value, *modifiers, kind=kind), "yyyy-MM-dd")


def time(value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    return F.date_format(moment(value, *modifiers, kind=kind), "HH:mm:ss")


def datetime(value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    return F.date_format(moment(value, *modifiers, kind=kind), "yyyy-MM-dd HH:mm:ss")


def unixepoch(value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    return F.unix_seconds(moment(value, *modifiers, kind=kind))


def julianday(value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    return unixepoch(value, *modifiers, kind=kind) / F.lit(86400.0) + F.lit(2440587.5)


def strftime(fmt: str, value: Column | None = None, *modifiers: str, kind: str = "text") -> Column:
    """%Y %m %d %H %M %S %f (seconds with milliseconds) %s %J and %%; other letters stay as they are written."""
    at = moment(value, *modifiers, kind=kind)
    plain = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "ss.SSS"}
    parts = []
    for piece in re.findall(r"%.|[^%]+|%$", fmt, re.DOTALL):
        code = piece[1:] if piece[0] == "%" else None
        if code in plain:
            parts.append(F.date_format(at, plain[code]))
        elif code == "s":
            parts.append(F.unix_seconds(at).cast("string"))
        elif code == "J":
            parts.append((F.unix_seconds(at) / F.lit(86400.0) + F.lit(2440587.5)).cast("string"))
        else:
            parts.append(F.lit("%" if code == "%" else piece))
    return F.when(at.isNotNull(), F.concat(F.lit(""), *parts))


def timediff(a: Column, b: Column, kind: str = "text") -> Column:
    """a - b in seconds, to the millisecond."""
    return (F.unix_millis(moment(a, kind=kind)) - F.unix_millis(moment(b, kind=kind))) / F.lit(1000.0)
