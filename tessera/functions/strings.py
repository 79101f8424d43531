"""String and other scalar functions where SQLite's meaning differs from Spark's. Expressions where they can be, else
Arrow-batched pandas UDFs (printf, char, unistr, soundex)."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let


def _text(c: Column) -> Column:
    return c.cast("string")


def instr(text: Column, part: Column) -> Column:
    return F.instr(text, part)


def quote(x: Column, kind: str = "text") -> Column:
    """A SQL literal: kind 'text', 'number' or 'blob'."""
    if kind == "blob":
        made = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    elif kind == "number":
        made = _text(x)
    else:
        made = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(made, F.lit("NULL"))


def hex(x: Column) -> Column:
    return F.hex(_text(x))


def unhex(x: Column, ignored: str = "") -> Column:
    """Text of the bytes; null where an odd or foreign digit, or what is no UTF-8, remains."""
    digits = F.translate(x, ignored, "") if ignored else x
    good = digits.rlike(r"^([0-9A-Fa-f]{2})*$")
    raw = F.unhex(F.when(good, digits))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def concat(*parts: Column) -> Column:
    """Nulls count as ''."""
    return F.concat_ws("", *map(_text, parts))


def concat_ws(sep: Column, *parts: Column) -> Column:
    return F.call_function("concat_ws", sep, *map(_text, parts))


def like(pattern: str, value: Column, escape: str | None = None) -> Column:
    """1 or 0; ASCII letters match in either case."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if escape and ch == escape and i + 1 < len(pattern):
            i += 1
            out += _literal(pattern[i])
        else:
            out += ".*" if ch == "%" else "." if ch == "_" else _literal(ch)
        i += 1
    return F.when(value.isNotNull(), value.rlike(f"(?s)^{out}$").cast("int"))


def _literal(ch: str) -> str:
    if ch.isascii() and ch.isalpha():
        return f"[{ch.lower()}{ch.upper()}]"
    return re.escape(ch)


def glob(pattern: str, value: Column) -> Column:
    """1 or 0; * ? and [..] classes, case-sensitive."""
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
    return F.when(value.isNotNull(), value.rlike(f"(?s)^{out}$").cast("int"))


def regexp(pattern: str, value: Column) -> Column:
    """1 or 0; a pattern that is none matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.when(value.isNotNull(), F.lit(0))
    return F.when(value.isNotNull(), value.rlike(pattern).cast("int"))


def length(x: Column) -> Column:
    return F.length(x)


def octet_length(x: Column) -> Column:
    return F.octet_length(x)


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", x).otherwise(F.replace(x, old, new))


def substr(x: Column, start: Column, size: Column | None = None) -> Column:
    """Start 0 means 1; a negative one counts from the end and stops at the first character; a negative size is ''."""
    n = F.length(x)
    first = F.when(start > 0, start).when(start == 0, F.lit(1)).otherwise(F.greatest(n + start + 1, F.lit(1)))
    many = n if size is None else F.greatest(size, F.lit(0))
    return F.when(x.isNotNull() & start.isNotNull() & (F.lit(True) if size is None else size.isNotNull()), F.substring(x, first, many))


def typeof(x: Column) -> Column:
    kind = F.typeof(x)
    named = F.when(kind.isin("boolean", "tinyint", "smallint", "int", "bigint"), "integer").when(kind.isin("float", "double") | kind.startswith("decimal"), "real").when(kind == "binary", "blob").otherwise("text")
    return F.when(x.isNull(), "null").otherwise(named)


def unicode(x: Column) -> Column:
    return F.when(x != "", F.ascii(x).cast("bigint"))


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def likely(x: Column) -> Column:
    return x


def unlikely(x: Column) -> Column:
    return x


def likelihood(x: Column, chance: float) -> Column:
    if not 0 <= chance <= 1:
        raise ValueError("a likelihood lies between 0 and 1")
    return x


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def nullif(a: Column, b: Column) -> Column:
    """Compares text forms: 1 and '1' are equal."""
    return F.when(~F.coalesce(_text(a) == _text(b), F.lit(False)), a)


def iif(test: Column, yes: Column, no: Column, kind: str = "boolean") -> Column:
    """kind of the test: boolean, number (not 0) or text (a number that is not 0)."""
    truth = test if kind == "boolean" else test.try_cast("double") != 0
    return F.when(F.coalesce(truth, F.lit(False)), yes).otherwise(no)


def zeroblob(n: int) -> Column:
    return F.lit(bytes(max(1, n)))


def randomblob(n: int) -> Column:
    """n random bytes, one at least, drawn anew for each row."""
    return F.substring(F.unhex(F.concat(*[F.lpad(F.hex((F.rand() * 281474976710656).cast("bigint")), 12, "0") for _ in range(-(-max(1, n) // 6))])), 1, max(1, n))


def random() -> Column:
    return ((F.rand() - 0.5) * F.lit(1.8446744073709552e19)).cast("bigint")


def scalar_max(*parts: Column, numeric: bool = True) -> Column:
    """Null if any part is; otherwise the greatest, by number or by text."""
    return _extreme(F.greatest, parts, numeric)


def scalar_min(*parts: Column, numeric: bool = True) -> Column:
    return _extreme(F.least, parts, numeric)


def _extreme(f, parts, numeric: bool) -> Column:
    parts = parts if numeric else tuple(map(_text, parts))
    some = parts[0].isNull()
    for p in parts[1:]:
        some = some | p.isNull()
    return F.when(~some, f(*parts))


def fts_rank(text: Column, query: str) -> Column:
    """Sum over the query's tokens, repeats counted, of tf 2.2 / (tf + 1.2); tokens are ASCII-lower-cased runs of
    letters and digits. Null text gives null. One pass of a pattern finds the hits; only they become an array."""
    wanted = rank_tokens(query)
    if not wanted:
        return F.when(text.isNotNull(), F.lit(0.0))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def total(hits: Column) -> Column:
        parts = F.lit(0.0)
        for token, times in wanted.items():
            parts = parts + let(F.size(F.filter(hits, _equals(token))).cast("double"), _damped(float(times)))
        return parts

    return let(F.regexp_extract_all(lower, F.lit(rank_pattern(wanted)), F.lit(1)), total)


def _equals(token: str):
    return lambda w: w == token


def _damped(times: float):
    return lambda tf: F.lit(times) * tf * F.lit(2.2) / (tf + F.lit(1.2))


def rank_tokens(query: str) -> dict[str, int]:
    lower = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return dict(sorted(Counter(t for t in re.split(r"[\W_]+", lower) if t).items()))


def rank_pattern(wanted: dict[str, int]) -> str:
    """Finds whole tokens: no letter or digit stands beside them."""
    return r"(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, wanted)) + r")(?![\p{L}\p{N}])"


def soundex_of(word: str | None) -> str | None:
    """Letters code to digits, h and w end a run like vowels do; '?000' without a letter."""
    if word is None:
        return None
    letters = [c for c in word.upper() if c.isascii() and c.isalpha()]
    if not letters:
        return "?000"
    codes = {c: str(d) for d, group in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), start=1) for c in group}
    out, last = letters[0], codes.get(letters[0])
    for c in letters[1:]:
        if (code := codes.get(c)) and code != last:
            out += code
        last = code
    return (out + "000")[:4]


def unistr_of(text: str | None) -> str | None:
    r"""\XXXX, \uXXXX, \+XXXXXX and \UXXXXXXXX escapes, \\ for a backslash; null where an escape is broken."""
    if text is None:
        return None
    out, i = [], 0
    while i < len(text):
        if text[i] != "\\":
            out.append(text[i])
            i += 1
            continue
        if m := re.match(r"\\\\", text[i:]):
            out.append("\\")
        elif m := re.match(r"\\(?:u([0-9A-Fa-f]{4})|\+([0-9A-Fa-f]{6})|U([0-9A-Fa-f]{8})|([0-9A-Fa-f]{4}))", text[i:]):
            point = int(next(g for g in m.groups() if g), 16)
            if point > 0x10FFFF or 0xD800 <= point < 0xE000:
                return None
            out.append(chr(point))
        else:
            return None
        i += m.end()
    return "".join(out)


def unistr_quote_of(text: str | None) -> str:
    if text is None:
        return "NULL"
    if all(c >= " " for c in text):
        return "'" + text.replace("'", "''") + "'"
    body = "".join(c if c >= " " else f"\\u{ord(c):04x}" for c in text.replace("\\", "\\\\").replace("'", "''"))
    return f"unistr('{body}')"


_FORMAT = re.compile(r"%([-+ 0#,!]*)(\d+)?(?:\.(\d+))?(?:hh|h|ll|l|j|z|t|L)?([%sqQzdiuxXocfeEgGn])")


def printf_of(fmt: str | None, *args) -> str | None:
    """C-style formatting of the codes s z q Q d i u x X o c f e E g G and %%, with flags, width and precision."""
    if fmt is None:
        return None
    rest = iter(args)

    def number(v) -> float:
        try:
            return float(v)
        except (TypeError, ValueError):
            m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", str(v or ""))
            return float(m[0]) if m else 0.0

    def put(m: re.Match) -> str:
        flags, width, precision, code = m[1], int(m[2] or 0), m[3], m[4]
        if code == "%":
            return "%"
        if code == "n":
            return ""
        value = next(rest, None)
        if code in "szqQc":
            text = "" if value is None else str(value)
            if code == "c":
                text = text[:1]
            elif precision is not None:
                text = text[: int(precision)]
            if code in "qQ":
                text = text.replace("'", "''")
                text = text if code == "q" else "NULL" if value is None else f"'{text}'"
        else:
            own = "".join(f for f in flags if f in "+ #0" and not (f == "0" and "-" in flags))
            spec = f"%{own}{'' if '-' in flags or not width else width}{'' if precision is None else '.' + precision}"
            if code in "diuxXo":
                whole = int(value) if isinstance(value, int) else int(number(value))
                whole = whole & 0xFFFFFFFFFFFFFFFF if code in "uxXo" and whole < 0 else whole
                text = (spec + ("d" if code == "u" else code)) % whole
                if "," in flags and code in "diu":
                    text = re.sub(r"\d+", lambda d: f"{int(d[0]):,}", text, count=1)
            else:
                text = (spec + code) % number(value)
        return text.ljust(width) if "-" in flags else text.rjust(width)

    return _FORMAT.sub(put, fmt)


def char_of(*codes) -> str:
    return "".join(chr(int(c)) for c in codes if c is not None and 0 <= int(c) <= 0x10FFFF and not 0xD800 <= int(c) < 0xE000)


def _udf(f, kind: str = "string"):
    def over(*series: pd.Series) -> pd.Series:
        clean = [[None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in s.astype(object)] for s in series]
        return pd.Series([f(*row) for row in zip(*clean, strict=True)], dtype=object)

    return F.pandas_udf(over, kind)


def printf(fmt: str, *args: Column) -> Column:
    return _udf(lambda *a: printf_of(fmt, *a))(*args) if args else F.lit(printf_of(fmt))


def char(*codes: Column) -> Column:
    return _udf(char_of)(*codes)


def soundex(x: Column) -> Column:
    return _udf(soundex_of)(x)


def unistr(x: Column) -> Column:
    return _udf(unistr_of)(x)


def unistr_quote(x: Column) -> Column:
    return _udf(unistr_quote_of)(x)

