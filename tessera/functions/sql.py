"""The function library's names in SQL text: calls become Spark expressions, or Arrow-batched functions where Spark has none.

``rewrite(text)`` replaces the calls it knows, outside quotes and comments, from the inside out. Most become plain
expressions of Spark's own functions, so they stay in generated code and are pushed down like any other; names that Spark
has with another meaning (log, hex, round, char, date, ...) get ours. The rest call functions named ``tessera_...``, which
``register(spark, text)`` adds to a session when a text first needs them. Nothing of Spark's own is replaced in the session.

A call that is ours in name only (an unknown number of arguments, as in ``x LIKE ('a')`` or ``CAST(x AS CHAR(3))``) stays.
"""

from __future__ import annotations

import json as _json
import math
import os
import re
from collections.abc import Callable, Iterator
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.functions import strings as S
from tessera.operators import retrieval as V

PREFIX = "tessera_"
_QUOTED = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"


class FunctionError(ValueError):
    pass


def split_commas(text: str, sep: str = ",") -> list[str]:
    """Parts between separators outside quotes and brackets."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|[()\[\]]|" + re.escape(sep), text):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif m[0] == sep and not depth:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [*out, text[start:].strip()]


def call_args(text: str, at: int) -> tuple[str, int]:
    """The text inside the bracket that opens at `at`, and the place after its end."""
    depth = 0
    for m in re.finditer(r"'(?:[^']|'')*'|[()]", text[at:]):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : at + m.start()], at + m.end()
    raise FunctionError("a bracket is not closed")


def literal(arg: str, raw: bool = False) -> str:
    """The text of a quoted literal; raw: before rewriting, which doubles backslashes."""
    if not re.fullmatch(r"'(?:[^']|'')*'", arg):
        raise FunctionError(f"{arg} is not a text literal")
    text = arg[1:-1].replace("''", "'")
    return text if raw else text.replace("\\\\", "\\")


def quoted(text: str) -> str:
    """Spark's literal of a text; its backslashes are escapes there."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_text(arg: str) -> bool:
    return bool(re.fullmatch(r"'(?:[^']|'')*'", arg))


# Expressions

_NUMBER = r"r'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_SHAPE = r"r'^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$'"
_CLOCK = r"r'^[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$'"


def moment(args: list[str]) -> str:
    """The timestamp of a value after its modifiers, which are literals; values of any type are read by their text."""
    if not args:
        return "current_timestamp()"
    v = f"trim(CAST({args[0]} AS STRING))"
    at = (
        f"CASE WHEN coalesce({v}, '') = '' OR lower({v}) = 'now' THEN current_timestamp() WHEN {v} RLIKE {_NUMBER} THEN timestamp_seconds(try_cast({v} AS DOUBLE)) "
        f"WHEN {v} RLIKE {_SHAPE} THEN try_cast({v} AS TIMESTAMP) WHEN {v} RLIKE {_CLOCK} THEN try_cast(concat('1970-01-01 ', {v}) AS TIMESTAMP) END"
    )
    for arg in args[1:]:
        word = literal(arg).strip().lower()
        if word == "unixepoch":
            continue
        if word == "start of day":
            at = f"date_trunc('DAY', {at})"
        elif m := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second)s?", word):
            micros = round(float(m[1]) * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[m[2]] * 1_000_000)
            at = f"timestamp_micros(unix_micros({at}) + {micros})"
        else:
            return "CAST(NULL AS TIMESTAMP)"
    return at


def _julian(at: str) -> str:
    return f"(unix_seconds({at}) / 86400.0D + 2440587.5D)"


def strftime(args: list[str]) -> str:
    at, parts = moment(args[1:]), ["''"]
    plain = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "ss.SSS"}
    for piece in re.findall(r"%.|[^%]+|%$", literal(args[0]), re.DOTALL):
        code = piece[1:] if piece[0] == "%" else ""
        if code in plain:
            parts.append(f"date_format({at}, '{plain[code]}')")
        elif code == "s":
            parts.append(f"CAST(unix_seconds({at}) AS STRING)")
        elif code == "J":
            parts.append(f"CAST({_julian(at)} AS STRING)")
        else:
            parts.append(quoted("%" if code == "%" else piece))
    return f"CASE WHEN {at} IS NOT NULL THEN concat({', '.join(parts)}) END"


def _double(x: str) -> str:
    return f"try_cast({x} AS DOUBLE)"


def _not_nan(x: str) -> str:
    return f"nanvl({x}, CAST(NULL AS DOUBLE))"


def _plain_math(name: str) -> Callable[[list[str]], str]:
    return lambda a: _not_nan(f"{name}({', '.join(map(_double, a))})")


def _log(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"CASE WHEN {_double(a[0])} = 0 THEN -double('infinity') WHEN {_double(a[0])} > 0 THEN {name}({_double(a[0])}) END"


def _round(a: list[str]) -> str:
    """Half away from zero on the binary value, after scaling by a power of ten; digits below 0 count as 0."""
    if len(a) > 1 and not re.fullmatch(r"[+-]?\d+", a[1]):
        raise FunctionError("round's digits are a literal")
    scale = f"{float(10 ** max(0, int(a[1]) if len(a) > 1 else 0))}D".replace("e+", "E")
    x = _double(a[0])
    s = f"({x} * {scale})"
    return f"CASE WHEN abs{s} >= 4503599627370496.0D THEN {x} WHEN abs{s} < 0.5D THEN 0.0D WHEN {s} < 0 THEN -CAST(floor(0.5D - {s}) AS DOUBLE) / {scale} ELSE CAST(floor({s} + 0.5D) AS DOUBLE) / {scale} END"


def _abs(a: list[str]) -> str:
    if _is_text(a[0]):
        return f"abs(coalesce({_double(a[0])}, 0.0D))"
    return f"abs(nullif({a[0]}, -9223372036854775808L))"


def _whole(name: str) -> Callable[[list[str]], str]:
    """ceil and floor as doubles: what is whole already, and a zero's sign, stays."""

    def made(a: list[str]) -> str:
        x = _double(a[0])
        low = f" WHEN {x} > -1 AND {x} < 0 THEN -0.0D" if name == "ceil" else ""
        return f"CASE WHEN abs({x}) >= 4503599627370496.0D OR {x} = 0 THEN {x}{low} ELSE CAST({name}({x}) AS DOUBLE) END"

    return made


def _log_of(a: list[str]) -> str:
    return _log("log10")(a) if len(a) == 1 else _not_nan(f"(({_log('ln')(a[1:])}) / nullif({_log('ln')(a[:1])}, 0.0D))")


def like_pattern(pattern: str, escape: str | None) -> str:
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if escape and ch == escape and i + 1 < len(pattern):
            i += 1
            out += S._literal(pattern[i])
        else:
            out += ".*" if ch == "%" else "." if ch == "_" else S._literal(ch)
        i += 1
    return f"(?s)^{out}$"


def glob_pattern(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^")) if ch == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end]
            no, inner = ("^", inner[1:]) if inner[:1] == "^" else ("", inner)
            out += f"[{no}{re.sub(r'([\\\[\]^&])', r'\\\1', inner)}]"
            i = end
        else:
            out += ".*" if ch == "*" else "." if ch == "?" else re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def _matched(x: str, pattern: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST({x} RLIKE {quoted(pattern)} AS INT) END"


def _regexp(a: list[str]) -> str:
    if not _is_text(a[0]):
        return f"{PREFIX}regexp({a[0]}, {a[1]})"
    try:
        re.compile(literal(a[0]))
    except re.error:
        return f"CASE WHEN {a[1]} IS NOT NULL THEN 0 END"
    return _matched(a[1], literal(a[0]))


def _glob(a: list[str]) -> str:
    return _matched(a[1], glob_pattern(literal(a[0]))) if _is_text(a[0]) else f"{PREFIX}glob({a[0]}, {a[1]})"


def _like(a: list[str]) -> str:
    if not _is_text(a[0]):
        return f"{PREFIX}like({', '.join(a)})"
    return _matched(a[1], like_pattern(literal(a[0]), literal(a[2]) if len(a) > 2 else None))


_WHOLE = "('boolean', 'tinyint', 'smallint', 'int', 'bigint')"


def _typeof(a: list[str]) -> str:
    x = a[0]
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN {_WHOLE} THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN typeof({x}) = 'binary' THEN 'blob' ELSE 'text' END"


def _quote(a: list[str]) -> str:
    x = a[0]
    numbers = _WHOLE[:-1] + ", 'float', 'double')"
    return f"CASE WHEN {x} IS NULL THEN 'NULL' WHEN typeof({x}) = 'binary' THEN concat('X\\'', hex({x}), '\\'') WHEN typeof({x}) IN {numbers} OR typeof({x}) LIKE 'decimal%' THEN CAST({x} AS STRING) ELSE concat('\\'', replace(CAST({x} AS STRING), '\\'', '\\'\\''), '\\'') END"


def _unhex(a: list[str]) -> str:
    digits = f"translate({a[0]}, {a[1]}, '')" if len(a) > 1 else a[0]
    raw = f"CAST(unhex(CASE WHEN {digits} RLIKE '^([0-9A-Fa-f][0-9A-Fa-f])*$' THEN {digits} END) AS STRING)"
    return f"CASE WHEN is_valid_utf8({raw}) THEN {raw} END"


def _substr(a: list[str]) -> str:
    x, start = a[0], a[1]
    first = f"CASE WHEN {start} > 0 THEN {start} WHEN {start} = 0 THEN 1 ELSE greatest(length({x}) + {start} + 1, 1) END"
    size = f"length({x})" if len(a) < 3 else f"CASE WHEN {a[2]} IS NOT NULL THEN greatest({a[2]}, 0) END"
    return f"CASE WHEN {x} IS NOT NULL AND {start} IS NOT NULL THEN substring({x}, CAST({first} AS INT), CAST({size} AS INT)) END"


def _trim(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"{name}({a[0]}, {a[1] if len(a) > 1 else quoted(' ')})"


def _iif(a: list[str]) -> str:
    test = a[0]
    truth = f"coalesce(CASE WHEN typeof({test}) = 'boolean' THEN CAST({test} AS STRING) = 'true' ELSE try_cast(CAST({test} AS STRING) AS DOUBLE) <> 0 END, false)"
    return f"CASE WHEN {truth} THEN {a[1]} ELSE {a[2] if len(a) > 2 else 'NULL'} END"


def _likelihood(a: list[str]) -> str:
    if not 0 <= float(a[1]) <= 1:
        raise FunctionError("a likelihood lies between 0 and 1")
    return f"({a[0]})"


def _bytes(a: list[str]) -> int:
    if not re.fullmatch(r"[+-]?\d+", a[0]):
        raise FunctionError("the number of bytes is a literal")
    return max(1, int(a[0]))


def _randomblob(a: list[str]) -> str:
    n = _bytes(a)
    parts = ", ".join("lpad(hex(CAST(rand() * 281474976710656 AS BIGINT)), 12, '0')" for _ in range(-(-n // 6)))
    return f"substring(unhex(concat({parts})), 1, {n})"


def _extreme(name: str) -> Callable[[list[str]], str | None]:
    def made(a: list[str]) -> str | None:
        if len(a) < 2:
            return None  # the aggregate
        return f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END"

    return made


def _rank(a: list[str]) -> str:
    """As strings.fts_rank: one pass of a pattern finds the hits, which are counted by token."""
    wanted = S.rank_tokens(literal(a[1]))
    if not wanted:
        return f"CASE WHEN {a[0]} IS NOT NULL THEN 0.0D END"
    hits = f"regexp_extract_all(translate({a[0]}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(S.rank_pattern(wanted))}, 1)"
    terms = " + ".join(f"transform(array(CAST(size(filter(h, w -> w = {quoted(t)})) AS DOUBLE)), tf -> {float(n)}D * tf * 2.2D / (tf + 1.2D))[0]" for t, n in wanted.items())
    return f"transform(array({hits}), h -> 0.0D + {terms})[0]"


# Functions over Arrow batches


def _value(v: object) -> object:
    """A JSON value of a SQL value."""
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() and -v.as_tuple().exponent <= 0 else float(v)
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, bytes):
        return v.hex().upper()
    if isinstance(v, (date, datetime)):
        return v.isoformat(sep=" ") if isinstance(v, datetime) else v.isoformat()
    return v


def _json_extract(text: str | None, *paths: str) -> str | None:
    v = J.loads(text)
    if v is J._MISSING:
        return None
    found = [J.find(v, p) if p is not None else J._MISSING for p in paths]
    return J._shown(found[0]) if len(paths) == 1 else J.dumps([None if f is J._MISSING else f for f in found])


def _json_length(text: str | None, path: str = "$") -> int | None:
    v = J.loads(text)
    v = v if v is J._MISSING or path is None else J.find(v, path)
    return None if v is J._MISSING else len(v) if isinstance(v, list) else 0


def _json_object(*parts: object) -> str:
    if len(parts) % 2:
        raise FunctionError("json_object takes pairs")
    return J.dumps({str(k): v for k, v in zip(parts[::2], parts[1::2], strict=True)})


def _json_edit(create: bool, replace: bool) -> Callable[..., str | None]:
    def made(text: str | None, *pairs: object) -> str | None:
        for path, new in zip(pairs[::2], pairs[1::2], strict=True):
            if text is not None:
                text = J.edit(text, path, new, create, replace)
        return text

    return made


def _json_patch(a: str | None, b: str | None) -> str | None:
    x, y = J.loads(a), J.loads(b)
    return None if x is J._MISSING or y is J._MISSING else J.dumps(J.merge_patch(x, y))


def _json_text(text: str | None) -> str | None:
    v = J.loads(text)
    return None if v is J._MISSING else J.dumps(v)


def _json_pretty(text: str | None) -> str | None:
    v = J.loads(text)
    return None if v is J._MISSING else _json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False)


def _json_type(text: str | None, path: str = "$") -> str | None:
    v = J.loads(text)
    return None if v is J._MISSING else J.kind_of(J.find(v, path))


def _each(deep: bool) -> Callable[..., list[dict]]:
    names = [c.split()[0] for c in J.EACH.split(", ")]
    return lambda text, root="$": [dict(zip(names, r, strict=True)) for r in J.rows(text, root, deep)]


def _regexp_of(pattern: str | None, text: str | None) -> int | None:
    if text is None or pattern is None:
        return None
    try:
        return int(re.search(pattern, text) is not None)
    except re.error:
        return 0


_ROWS = f"array<struct<{', '.join(c.replace(' ', ': ') for c in J.EACH.split(', '))}>>"
#: name: (function of a row's values, type). Registered as tessera_<name>.
BATCHED: dict[str, tuple[Callable, str]] = {
    "json": (_json_text, "string"),
    "json_extract": (_json_extract, "string"),
    "json_type": (_json_type, "string"),
    "json_array_length": (_json_length, "bigint"),
    "json_quote": (J.dumps, "string"),
    "json_array": (lambda *v: J.dumps(list(v)), "string"),
    "json_object": (_json_object, "string"),
    "json_patch": (_json_patch, "string"),
    "json_pretty": (_json_pretty, "string"),
    "json_error_position": (J.error_position, "bigint"),
    "json_array_insert": (J.array_insert, "string"),
    "json_set": (_json_edit(True, True), "string"),
    "json_insert": (_json_edit(True, False), "string"),
    "json_replace": (_json_edit(False, True), "string"),
    "json_remove": (J.remove, "string"),
    "json_each": (_each(False), _ROWS),
    "json_tree": (_each(True), _ROWS),
    "printf": (S.printf_of, "string"),
    "char": (S.char_of, "string"),
    "soundex": (S.soundex_of, "string"),
    "unistr": (S.unistr_of, "string"),
    "unistr_quote": (S.unistr_quote_of, "string"),
    "regexp": (_regexp_of, "int"),
    "sparse_vector": (lambda t: None if t is None else J.dumps([list(x) for x in V.sparse_vector(t)]), "string"),
    "member_set": (lambda t: None if t is None else "[" + ",".join(V.set_members(t)) + "]", "string"),
    "glob": (lambda p, x: None if p is None or x is None else int(re.search(glob_pattern(p), x) is not None), "int"),
    "like": (lambda p, x, e=None: None if p is None or x is None else int(re.search(like_pattern(p, e), x) is not None), "int"),
}


def _listed(c: pa.Array) -> list:
    """A column's JSON values; a text that many rows have is made once."""
    if pa.types.is_string(c.type):
        found = c.dictionary_encode()
        if 2 * len(found.dictionary) > len(c):
            return c.to_pylist()
        texts = [*found.dictionary.to_pylist(), None]
        return [texts[i] for i in found.indices.fill_null(len(texts) - 1).to_numpy().tolist()]
    if (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)) and not c.null_count:
        return c.to_numpy(zero_copy_only=False).tolist()
    return [_value(v) for v in c.to_pylist()]


def _plain(kind: pa.DataType) -> bool:
    """Whether equal values of a column are the same value in every form (0.0 and -0.0 are not)."""
    return pa.types.is_string(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_null(kind)


def _over_rows(f: Callable, columns: tuple[pa.Array, ...]) -> list:
    """f of every row; rows of a batch that are equal in all columns are worked out once."""
    rows = zip(*map(_listed, columns), strict=True)
    if not all(_plain(c.type) for c in columns):
        return [f(*row) for row in rows]
    rows = list(rows)
    made = {row: f(*row) for row in dict.fromkeys(rows)}
    return [made[row] for row in rows]


def batched(f: Callable, kind: str):
    """An Arrow function of whole columns that keeps each value's own type."""
    arrow = F.arrow_udf  # types come as they are: no integer becomes a float because a row is null

    def over(*columns: pa.Array) -> pa.Array:
        return pa.array(_over_rows(f, columns), arrow_type)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_type = to_arrow_type(_parse_datatype_string(kind))
    return arrow(over, kind)


def register(spark: SparkSession, text: str) -> None:
    """The functions named tessera_... in a text, each once a session."""
    have = spark.__dict__.setdefault("_tessera_functions", set())
    own, here = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if here not in own.get("PYTHONPATH", "").split(os.pathsep):  # workers that start without the package's folder
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [here, own.get("PYTHONPATH")]))
    for name in set(re.findall(rf"\b{PREFIX}(\w+)\s*\(", text)) & set(BATCHED) - have:
        spark.udf.register(PREFIX + name, batched(*BATCHED[name]))
        have.add(name)


def _batched(name: str, least: int = 1, most: int = 1 << 10) -> Callable[[list[str]], str | None]:
    return lambda a: f"{PREFIX}{name}({', '.join(a)})" if least <= len(a) <= most else None


def _json_one(a: list[str]) -> str:
    return _batched("json_extract")(a)


def _table(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"inline({PREFIX}{name}({', '.join(a)}))"


def _series(a: list[str]) -> str:
    bounds = [int(x) for x in a]
    start, stop, step = (0, bounds[0], 1) if len(bounds) == 1 else (*bounds, 1)[:3]
    if step == 0:
        raise FunctionError("a series' step is not 0")
    if max(0, (stop - start) // step + 1) > 1_000_000:
        raise FunctionError("a series has at most 1,000,000 rows")
    return f"(SELECT id AS value FROM range({start}, {stop + (1 if step > 0 else -1)}, {step}))"


Maker = Callable[[list[str]], "str | None"]
#: name: (least arguments, most, text of the call). None leaves the call as it stands.
SCALARS: dict[str, tuple[int, int, Maker]] = {
    "date": (0, 99, lambda a: f"date_format({moment(a)}, 'yyyy-MM-dd')"),
    "time": (0, 99, lambda a: f"date_format({moment(a)}, 'HH:mm:ss')"),
    "datetime": (0, 99, lambda a: f"date_format({moment(a)}, 'yyyy-MM-dd HH:mm:ss')"),
    "unixepoch": (0, 99, lambda a: f"unix_seconds({moment(a)})"),
    "julianday": (0, 99, lambda a: _julian(moment(a))),
    "strftime": (1, 99, strftime),
    "timediff": (2, 2, lambda a: f"((unix_millis({moment(a[:1])}) - unix_millis({moment(a[1:])})) / 1000.0D)"),
    "json": (1, 1, _batched("json")),
    "json_valid": (1, 1, lambda a: f"CASE WHEN try_parse_json({a[0]}) IS NULL THEN 0 ELSE 1 END"),
    "json_extract": (2, 99, _json_one),
    "json_type": (1, 2, _batched("json_type")),
    "json_array_length": (1, 2, _batched("json_array_length")),
    "json_quote": (1, 1, _batched("json_quote")),
    "json_array": (0, 999, lambda a: _batched("json_array")(a) if a else "'[]'"),
    "json_object": (0, 999, lambda a: _batched("json_object")(a) if a else "'{}'"),
    "json_patch": (2, 2, _batched("json_patch")),
    "json_pretty": (1, 1, _batched("json_pretty")),
    "json_error_position": (1, 1, _batched("json_error_position")),
    "json_array_insert": (3, 3, _batched("json_array_insert")),
    "json_set": (3, 99, _batched("json_set")),
    "json_insert": (3, 99, _batched("json_insert")),
    "json_replace": (3, 99, _batched("json_replace")),
    "json_remove": (1, 99, _batched("json_remove")),
    "json_each": (1, 2, _table("json_each")),
    "json_tree": (1, 2, _table("json_tree")),
    "instr": (2, 2, lambda a: f"CAST(instr({a[0]}, {a[1]}) AS BIGINT)"),
    "quote": (1, 1, _quote),
    "hex": (1, 1, lambda a: f"hex(CAST({a[0]} AS STRING))"),
    "unhex": (1, 2, _unhex),
    "printf": (1, 99, _batched("printf")),
    "format": (1, 99, _batched("printf")),
    "char": (0, 99, lambda a: _batched("char")(a) if a else "''"),
    "concat": (1, 99, lambda a: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})"),
    "like": (2, 3, _like),
    "glob": (2, 2, _glob),
    "regexp": (2, 2, _regexp),
    "replace": (3, 3, lambda a: f"CASE WHEN {a[1]} = '' THEN {a[0]} ELSE replace({a[0]}, {a[1]}, {a[2]}) END"),
    "substr": (2, 3, _substr),
    "substring": (2, 3, _substr),
    "typeof": (1, 1, _typeof),
    "unicode": (1, 1, lambda a: f"CASE WHEN {a[0]} <> '' THEN CAST(ascii({a[0]}) AS BIGINT) END"),
    "unistr": (1, 1, _batched("unistr")),
    "unistr_quote": (1, 1, _batched("unistr_quote")),
    "trim": (1, 2, _trim("btrim")),
    "ltrim": (1, 2, lambda a: f"ltrim({a[1] if len(a) > 1 else quoted(' ')}, {a[0]})"),
    "rtrim": (1, 2, lambda a: f"rtrim({a[1] if len(a) > 1 else quoted(' ')}, {a[0]})"),
    "soundex": (1, 1, _batched("soundex")),
    "likely": (1, 1, lambda a: f"({a[0]})"),
    "unlikely": (1, 1, lambda a: f"({a[0]})"),
    "likelihood": (2, 2, _likelihood),
    "nullif": (2, 2, lambda a: f"CASE WHEN coalesce(CAST({a[0]} AS STRING) = CAST({a[1]} AS STRING), false) THEN NULL ELSE {a[0]} END"),
    "iif": (2, 3, _iif),
    "if": (2, 3, _iif),
    "randomblob": (1, 1, _randomblob),
    "zeroblob": (1, 1, lambda a: f"X'{'00' * _bytes(a)}'"),
    "random": (0, 0, lambda a: "CAST((rand() - 0.5D) * 1.8446744073709552E19D AS BIGINT)"),
    "max": (2, 99, _extreme("greatest")),
    "min": (2, 99, _extreme("least")),
    "fts_rank": (2, 2, _rank),
    "abs": (1, 1, _abs),
    "mod": (2, 2, lambda a: _not_nan(f"try_mod({_double(a[0])}, nullif({_double(a[1])}, 0.0D))")),
    "pow": (2, 2, _plain_math("pow")),
    "power": (2, 2, _plain_math("pow")),
    "round": (1, 2, _round),
    "sign": (1, 1, lambda a: f"CAST(sign({_double(a[0])}) AS BIGINT)"),
    "atan2": (2, 2, _plain_math("atan2")),
    "ceil": (1, 1, _whole("ceil")),
    "ceiling": (1, 1, _whole("ceil")),
    "floor": (1, 1, _whole("floor")),
    "ln": (1, 1, _log("ln")),
    "log10": (1, 1, _log("log10")),
    "log2": (1, 1, _log("log2")),
    "log": (1, 2, _log_of),
    "series": (1, 3, _series),
    "rtree_intersects": (8, 8, lambda a: f"coalesce({a[0]} <= {a[5]} AND {a[4]} <= {a[1]} AND {a[2]} <= {a[7]} AND {a[6]} <= {a[3]}, false)"),
    "sparse_vector": (1, 1, _batched("sparse_vector")),
    "member_set": (1, 1, _batched("member_set")),
    **{n: (1, 1, _plain_math(n)) for n in "acos acosh asin asinh atan atanh cos cosh sin sinh tan tanh degrees radians exp sqrt".split()},
}
for _name in [n for n in SCALARS if n.startswith("json_")] + ["json"]:
    if _name not in ("json_valid", "json_quote", "json_error_position", "json_pretty", "json_type", "json_array_length"):
        SCALARS["jsonb" + _name.removeprefix("json")] = SCALARS[_name]


# Aggregates: what follows a call (FILTER, OVER) belongs to the innermost aggregate

_SUFFIX = r"\s*(filter\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*(over\s*(?:\w+|\([^()]*(?:\([^()]*\)[^()]*)*\)))?"


def _share(name: str, arg: str, top: float) -> float:
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dD]?", arg):
        raise FunctionError(f"{name}'s argument is a constant number")
    p = float(arg.rstrip("dD"))
    if not 0 <= p <= top:
        raise FunctionError(f"{name}'s argument lies between 0 and {top:g}")
    return p / top


def _checked(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({v}) = double('infinity') THEN CAST(raise_error('percentile of an infinite value') AS DOUBLE) WHEN NOT isnan({v}) THEN {v} END"


def _aggregate(name: str, a: list[str], suffix: str) -> str | None:
    if name == "total" and len(a) == 1:
        return f"coalesce(CAST(sum({a[0]}){suffix} AS DOUBLE), 0.0D)"
    if name == "group_concat" and len(a) in (1, 2):
        return f"string_agg({a[0]}, {a[1] if len(a) > 1 else quoted(',')}){suffix}"
    if name == "median" and len(a) == 1:
        return f"percentile({_checked(a[0])}, 0.5D){suffix}"
    if name in ("percentile", "percentile_cont") and len(a) == 2:
        return f"percentile({_checked(a[0])}, {_share(name, a[1], 100.0 if name == 'percentile' else 1.0)}D){suffix}"
    if name == "percentile_disc" and len(a) == 2:
        p = _share(name, a[1], 1.0)
        values = f"array_sort(collect_list({_checked(a[0])}){suffix})"
        return f"get({values}, CAST(floor({p}D * (size({values}) - 1)) AS INT))"
    return None


AGGREGATES = ("total", "group_concat", "median", "percentile", "percentile_cont", "percentile_disc")
_CALL = re.compile(rf"{_QUOTED}|(?<![\w.`])({'|'.join(sorted({*SCALARS, *AGGREGATES}, key=len, reverse=True))})\s*(?=\()", re.I | re.S)
_TABLES = {n for n in SCALARS if n.endswith(("_each", "_tree"))}


def rewrite(sql: str) -> str:
    """The text with every call that is ours replaced."""
    out, i = "", 0
    while m := _CALL.search(sql, i):
        out += sql[i : m.start()]
        if not m[1]:
            plain = m[0][0] == "'" and out[-1:].lower() != "r"  # a backslash is no escape in a text given to us
            out, i = out + (m[0].replace("\\", "\\\\") if plain else m[0]), m.end()
            continue
        name, before = m[1].lower(), out.rstrip()
        body, end = call_args(sql, m.end())
        args = split_commas(rewrite(body)) if body.strip() else []
        made = None
        if re.search(r"\b(as|table|into|update|from|join)$", before, re.I) and name not in ("series", *_TABLES):
            pass  # a type or a table of that name
        elif name in AGGREGATES:
            suffix = re.match(_SUFFIX, sql[end:], re.I)[0].rstrip()
            if (made := _aggregate(name, args, rewrite(suffix))) is not None:
                end += len(suffix)
        elif name in SCALARS and SCALARS[name][0] <= len(args) <= SCALARS[name][1]:
            made = SCALARS[name][2](args)
        if made is not None and name in _TABLES and re.search(r",$|\bjoin$", before, re.I):
            made = "LATERAL " + made
        elif made is not None and made.startswith("CASE"):
            made = f"({made})"
        out += made if made is not None else f"{m[1]}({', '.join(args)})"
        i = end
    return out + sql[i:]


def calls(text: str, names: tuple[str, ...]) -> Iterator[tuple[str, list[str], int, int]]:
    """(name, arguments, start, end) of the calls of given names outside quotes."""
    for m in re.finditer(rf"{_QUOTED}|(?<![\w.])({'|'.join(names)})\s*(?=\()", text, re.I | re.S):
        if m[1]:
            body, end = call_args(text, m.end())
            yield m[1].lower(), split_commas(body), m.start(), end
