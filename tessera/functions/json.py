"""JSON functions over text: compact output with sorted keys; paths are $, .key, [n] and ["quoted"].

json_valid is an expression; what reads or rebuilds a document runs in Arrow batches, because key order, the form of
numbers (1.0 stays 1.0) and creation rules are ours. The table functions are generators over Arrow batches.
"""

from __future__ import annotations

import functools
import json as _json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r'\.([A-Za-z_0-9$-]+)|\."([^"]*)"|\[(\d+)\]|\["([^"]*)"\]')


class _MISSING:
    """Stands for no value; a class, which pickles by name and so stays one and the same on every worker."""



#: One encoder and one decoder for all values: json.dumps and json.loads make one a call for other than their defaults.
_encode = _json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def dumps(value: object) -> str:
    return _encode(value)


def _no_constant(name: str) -> None:
    raise ValueError(name)


_decode = _json.JSONDecoder(parse_constant=_no_constant).decode


def loads(text: str | None) -> object:
    """The value of a text, _MISSING if it is none."""
    if text is None:
        return _MISSING
    try:
        return _decode(text) if isinstance(text, str) else _json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return _MISSING


@functools.lru_cache(4096)
def parse_path(path: str) -> tuple[str | int, ...] | None:
    if not path or path[0] != "$":
        return None
    steps, at = [], 1
    while at < len(path):
        if not (m := _STEP.match(path, at)):
            return None
        steps.append(int(m[3]) if m[3] is not None else next(g for g in (m[1], m[2], m[4]) if g is not None))
        at = m.end()
    return tuple(steps)


def find(value: object, path: str) -> object:
    steps = parse_path(path)
    if steps is None:
        return _MISSING
    for step in steps:
        if isinstance(step, int):
            if not isinstance(value, list) or step >= len(value):
                return _MISSING
            value = value[step]
        else:
            if not isinstance(value, dict) or step not in value:
                return _MISSING
            value = value[step]
    return value


def _shown(value: object) -> str | None:
    if value is _MISSING or value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else dumps(value)


def kind_of(value: object) -> str | None:
    if value is _MISSING:
        return None
    for kind, name in ((bool, "true" if value else "false"), (type(None), "null"), (int, "integer"), (float, "real"), (str, "text"), (list, "array"), (dict, "object")):
        if isinstance(value, kind):
            return name
    return None


def edit(text: str | None, path: str, new: object, create: bool, replace: bool) -> str | None:
    """The document with a value put at a path: made if absent and `create`, overwritten if present and `replace`."""
    value, steps = loads(text), parse_path(path)
    if value is _MISSING or steps is None:
        return None
    if not steps:
        return dumps(new if replace else value)
    holder = value
    for step in steps[:-1]:
        if isinstance(step, int) and isinstance(holder, list) and step < len(holder) or isinstance(step, str) and isinstance(holder, dict) and step in holder:
            holder = holder[step]
        else:
            return dumps(value)
    last = steps[-1]
    if isinstance(last, str) and isinstance(holder, dict):
        if replace if last in holder else create:
            holder[last] = new
    elif isinstance(last, int) and isinstance(holder, list):
        if last < len(holder):
            if replace:
                holder[last] = new
        elif last == len(holder) and create:
            holder.append(new)
    return dumps(value)


def remove(text: str | None, *paths: str) -> str | None:
    value = loads(text)
    if value is _MISSING:
        return None
    for path in paths:
        steps = parse_path(path)
        if steps is None:
            return None
        if not steps:
            return None
        holder = find(value, _path(steps[:-1]))
        last = steps[-1]
        if isinstance(last, str) and isinstance(holder, dict):
            holder.pop(last, None)
        elif isinstance(last, int) and isinstance(holder, list) and last < len(holder):
            del holder[last]
    return dumps(value)


def _path(steps: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in steps)


def array_insert(text: str | None, path: str, new: object) -> str | None:
    value, steps = loads(text), parse_path(path)
    if value is _MISSING or not steps or not isinstance(steps[-1], int):
        return None
    holder = find(value, _path(steps[:-1]))
    if isinstance(holder, list) and steps[-1] <= len(holder):
        holder.insert(steps[-1], new)
    return dumps(value)


def merge_patch(target: object, patch: object) -> object:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


def error_position(text: str | None) -> int | None:
    if text is None:
        return None
    try:
        _json.loads(text, parse_constant=_no_constant)
    except _json.JSONDecodeError as e:
        return e.pos + 1
    except ValueError:
        return 1
    return 0


def _clean(v: object) -> object:
    if v is None or (isinstance(v, float) and v != v):
        return None
    return v.item() if hasattr(v, "item") else v


def _udf(f, kind: str = "string"):
    def over(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*map(_clean, row)) for row in zip(*[s.astype(object) for s in series], strict=True)], dtype=object)

    return F.pandas_udf(over, kind)


def json(x: Column) -> Column:
    return _udf(lambda t: None if (v := loads(t)) is _MISSING else dumps(v))(x)


def json_valid(x: Column) -> Column:
    return F.when(F.try_parse_json(x).isNull(), 0).otherwise(1)


def json_extract(x: Column, *paths: str) -> Column:
    def one(t: str | None) -> str | None:
        v = loads(t)
        found = [find(v, p) for p in paths]
        if v is _MISSING:
            return None
        return _shown(found[0]) if len(paths) == 1 else dumps([None if f is _MISSING else f for f in found])

    return _udf(one)(x)


def json_type(x: Column, path: str = "$") -> Column:
    return _udf(lambda t: kind_of(find(v, path)) if (v := loads(t)) is not _MISSING else None)(x)


def json_array_length(x: Column, path: str = "$") -> Column:
    """Length of the array at the path; 0 for other values, null where nothing is."""

    def one(t: str | None) -> int | None:
        v = loads(t)
        v = v if v is _MISSING else find(v, path)
        return None if v is _MISSING else len(v) if isinstance(v, list) else 0

    return _udf(one, "bigint")(x)


def json_quote(x: Column) -> Column:
    return _udf(dumps)(x)


def json_array(*parts: Column) -> Column:
    return _udf(lambda *v: dumps(list(v)))(*parts) if parts else F.lit("[]")


def json_object(**parts: Column) -> Column:
    names = list(parts)
    return _udf(lambda *v: dumps(dict(zip(names, v, strict=True))))(*parts.values()) if parts else F.lit("{}")


def json_patch(target: Column, patch: Column) -> Column:
    def one(a: str | None, b: str | None) -> str | None:
        x, y = loads(a), loads(b)
        return None if x is _MISSING or y is _MISSING else dumps(merge_patch(x, y))

    return _udf(one)(target, patch)


def json_pretty(x: Column) -> Column:
    return _udf(lambda t: None if (v := loads(t)) is _MISSING else _json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False))(x)


def json_error_position(x: Column) -> Column:
    return _udf(error_position, "bigint")(x)


def json_array_insert(x: Column, path: str, new: Column) -> Column:
    return _udf(lambda t, v: array_insert(t, path, v))(x, new)


def json_set(x: Column, path: str, new: Column) -> Column:
    return _udf(lambda t, v: edit(t, path, v, True, True))(x, new)


def json_insert(x: Column, path: str, new: Column) -> Column:
    return _udf(lambda t, v: edit(t, path, v, True, False))(x, new)


def json_replace(x: Column, path: str, new: Column) -> Column:
    return _udf(lambda t, v: edit(t, path, v, False, True))(x, new)


def json_remove(x: Column, *paths: str) -> Column:
    return _udf(lambda t: remove(t, *paths))(x)


EACH = "key string, value string, type string, atom string, id long, parent long, fullkey string, path string"


def rows(text: str | None, root: str = "$", deep: bool = False) -> Iterator[tuple]:
    """json_each (children of the root, or the root itself if it is a scalar) and json_tree (every node, parents first)."""
    value = loads(text)
    top = value if value is _MISSING else find(value, root)
    if top is _MISSING or (top is None and not deep):
        return
    count = 0

    def row(key: object, v: object, parent: int | None, full: str, path: str) -> tuple:
        atom = None if isinstance(v, (list, dict)) else _shown(v)
        return (None if key is None else str(key), _shown(v), kind_of(v), atom, count, parent, full, path)

    def children(v: object, full: str) -> Iterator[tuple[object, object, str]]:
        if isinstance(v, dict):
            yield from ((k, v[k], f"{full}.{k}") for k in sorted(v))
        elif isinstance(v, list):
            yield from ((i, x, f"{full}[{i}]") for i, x in enumerate(v))

    if not deep:
        if not isinstance(top, (list, dict)):
            yield row(None, top, None, root, root)
        for key, v, full in children(top, root):
            yield row(key, v, None, full, root)
            count += 1
        return
    stack = [(None, top, None, root, root)]
    while stack:
        key, v, parent, full, path = stack.pop()
        yield row(key, v, parent, full, path)
        own, count = count, count + 1
        stack += [(k, x, own, f, full) for k, x, f in children(v, full)][::-1]


def json_each(df: DataFrame, column: str, root: str = "$", deep: bool = False) -> DataFrame:
    """df with a row for each row of the JSON text in the column; deep: json_tree."""
    kind = f"array<struct<{', '.join(c.replace(' ', ': ') for c in EACH.split(', '))}>>"
    names = [c.split()[0] for c in EACH.split(", ")]

    def over(s: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r, strict=True)) for r in rows(t, root, deep)] for t in s], dtype=object)

    made = F.pandas_udf(over, kind)(F.col(column))
    return df.withColumn("_each", F.explode(made)).select(*df.columns, *[F.col(f"_each.{n}").alias(n) for n in names])


def json_tree(df: DataFrame, column: str, root: str = "$") -> DataFrame:
    return json_each(df, column, root, deep=True)


jsonb, jsonb_extract, jsonb_array, jsonb_object, jsonb_patch = json, json_extract, json_array, json_object, json_patch
jsonb_set, jsonb_insert, jsonb_replace, jsonb_remove, jsonb_array_insert = json_set, json_insert, json_replace, json_remove, json_array_insert
jsonb_each, jsonb_tree = json_each, json_tree
