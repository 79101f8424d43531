"""Expected values of the scalar libraries, each trap once."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions import datetime as D
from tessera.functions import json as J
from tessera.functions import math as M
from tessera.functions import strings as S


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_datetime(spark):
    t = lambda s: F.lit(s).cast("string")
    got = values(spark, a=D.date(t("2024-02-29T12:30:00Z")), b=D.datetime(t("86400")), c=D.time(t("04:05:06")), d=D.date(t("nonsense")), e=D.date(t("2024-01-31"), "+1 day", "start of day"), f=D.date(t("2024-01-01"), "+1 month"), g=D.unixepoch(t("2024")), h=D.julianday(t("1970-01-01")), i=D.strftime("%Y/%m %f %s %q%%", t("1970-01-02")), j=D.timediff(t("2024-01-01 00:00:01.5"), t("2024-01-01")), k=D.datetime(t("2024-01-01"), "-1.5 hours"))
    assert got == {"a": "2024-02-29", "b": "1970-01-02 00:00:00", "c": "04:05:06", "d": None, "e": "2024-02-01", "f": None, "g": 2024, "h": 2440587.5, "i": "1970/01 00.000 86400 %q%", "j": 1.5, "k": "2023-12-31 22:30:00"}


def test_math(spark):
    x = F.lit
    got = values(spark, a=M.sqrt(x(-1.0)), b=M.acos(x(2.0)), c=M.ln(x(0.0)), d=M.log(x(100.0)), e=M.log(x(2.0), x(8.0)), f=M.round(x(2.5)), g=M.round(x(-2.5)), h=M.round(x(1.005), 2), i=M.mod(x(-7.0), x(3.0)), j=M.mod(x(1.0), x(0.0)), k=M.sign(x(-3.0)), l=M.ceil(x(1.2)), m=M.abs(x("abc")), n=M.round(x(0.49999999999999994)))
    assert got["a"] is None and got["b"] is None and got["c"] == -math.inf and got["d"] == 2.0 and got["e"] == pytest.approx(3.0)
    assert (got["f"], got["g"], got["h"], got["i"], got["j"], got["k"], got["l"], got["m"], got["n"]) == (3.0, -3.0, 1.0, -1.0, None, -1, 2.0, 0.0, 0.0)


def test_strings(spark):
    x = F.lit
    null = F.lit(None).cast("string")
    got = values(spark, a=S.concat(x("a"), null, x("b")), b=S.substr(x("abcdef"), x(-9), x(3)), c=S.substr(x("abcdef"), x(0), x(2)), d=S.substr(x("abcdef"), x(-2)), e=S.like("A%c_", x("abxCd")), f=S.like("a!%", x("a%"), "!"), g=S.glob("[a-c]*?", x("bxy")), h=S.regexp("(", x("a")), i=S.unhex(x("48-69"), "-"), j=S.unhex(x("4")), k=S.typeof(x(1)), l=S.typeof(null), m=S.unicode(x("")), n=S.quote(x("it's")), o=S.quote(null), p=S.nullif(x("1"), x("1")), q=S.instr(x("abc"), x("")), r=S.scalar_max(x(1), F.lit(None).cast("int")), s=S.hex(x(12)), t=S.substr(x("abc"), x(2), x(-1)))
    assert got == {"a": "ab", "b": "abc", "c": "ab", "d": "ef", "e": 1, "f": 1, "g": 1, "h": 0, "i": "Hi", "j": None, "k": "integer", "l": "null", "m": None, "n": "'it''s'", "o": "NULL", "p": None, "q": 1, "r": None, "s": "3132", "t": ""}


def test_python_strings(spark):
    got = values(spark, a=S.soundex(F.lit("Ashcraft")), b=S.soundex(F.lit("")), c=S.char(F.lit(72), F.lit(105)), d=S.printf("%05.1f|%-4d|%x|%q|%s", F.lit(3.14159), F.lit(7), F.lit(255), F.lit("o'k"), F.lit("z")), e=S.unistr(F.lit(r"\0041B\\")), f=S.unistr(F.lit(r"\zz")))
    assert got == {"a": "A226", "b": "?000", "c": "Hi", "d": "003.1|7   |ff|o''k|z", "e": "AB\\", "f": None}
    assert S.printf_of("%,d %+d %e %c", 1234567, 5, 12345.678, "xyz") == "1,234,567 +5 1.234568e+04 x"
    assert S.fts_rank(F.lit("x"), "x") is not None


def test_fts_rank(spark):
    got = values(spark, a=S.fts_rank(F.lit("Rust rust, RUST db"), "rust rust"), b=S.fts_rank(F.lit(""), "rust"), c=S.fts_rank(F.lit(None).cast("string"), "rust"))
    assert got["a"] == pytest.approx(2 * 3 * 2.2 / 4.2) and got["b"] == 0.0 and got["c"] is None


def test_json(spark):
    j = F.lit('{"b":[1,2,{"c":null}],"a":"x"}')
    got = values(spark, a=J.json(j), b=J.json(F.lit("{")), c=J.json_valid(F.lit("null")), d=J.json_extract(j, "$.b[0]"), e=J.json_extract(j, "$.a", "$.z"), f=J.json_type(j, "$.b[2].c"), g=J.json_array_length(j, "$.b"), h=J.json_array_length(j), i=J.json_set(j, "$.n", F.lit(1)), k=J.json_insert(j, "$.a", F.lit("y")), l=J.json_replace(j, "$.q", F.lit(1)), m=J.json_remove(j, "$.b[1]"), n=J.json_patch(j, F.lit('{"a":null,"d":{"e":1}}')), o=J.json_error_position(F.lit('{"a":}')), p=J.json_array_insert(j, "$.b[1]", F.lit(9)), q=J.json_object(x=F.lit(1), a=F.lit("t")), r=J.json_array(F.lit(1), F.lit(None).cast("string")), s=J.json_quote(F.lit('a"b')))
    same = '{"a":"x","b":[1,2,{"c":null}]}'
    assert got == {"a": same, "b": None, "c": 1, "d": "1", "e": '["x",null]', "f": "null", "g": 3, "h": 0, "i": '{"a":"x","b":[1,2,{"c":null}],"n":1}', "k": same, "l": same, "m": '{"a":"x","b":[1,{"c":null}]}', "n": '{"b":[1,2,{"c":null}],"d":{"e":1}}', "o": 6, "p": '{"a":"x","b":[1,9,2,{"c":null}]}', "q": '{"a":"t","x":1}', "r": "[1,null]", "s": '"a\\"b"'}
    tree = [(r["key"], r["type"], r["id"], r["parent"], r["fullkey"]) for r in J.json_tree(spark.range(1).select(j.alias("j")), "j").collect()]
    assert tree == [(None, "object", 0, None, "$"), ("a", "text", 1, 0, "$.a"), ("b", "array", 2, 0, "$.b"), ("0", "integer", 3, 2, "$.b[0]"), ("1", "integer", 4, 2, "$.b[1]"), ("2", "object", 5, 2, "$.b[2]"), ("c", "null", 6, 5, "$.b[2].c")]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1, 10.0, "a"), (2, 1, 20.0, "b"), (3, 1, None, "c"), (4, 2, 5.0, "d"), (5, 2, 5.0, None), (6, 2, 30.0, "e")], "id long, g long, v double, s string")
    got = {r["g"]: r for r in df.groupBy("g").agg(A.median(F.col("v")).alias("m"), A.percentile_disc(F.col("v"), 0.5).alias("d"), A.percentile(F.col("v"), 50).alias("p"), A.group_concat(F.col("s"), "-", F.col("id")).alias("c"), A.total(F.when(F.col("id") < 0, 1)).alias("t")).collect()}
    assert (got[1]["m"], got[1]["d"], got[1]["p"], got[1]["c"], got[1]["t"]) == (15.0, 10.0, 15.0, "a-b-c", 0.0)
    assert (got[2]["m"], got[2]["d"], got[2]["c"]) == (5.0, 5.0, "d-e")
    assert {r["g"]: r["value"] for r in A.percentile_disc_table(df, "v", 0.5, ["g"]).collect()} == {1: 10.0, 2: 5.0}
    with pytest.raises(ValueError):
        A.percentile(F.col("v"), 101)
    with pytest.raises(Exception, match="infinite"):
        df.select(A.median(F.lit(math.inf))).collect()


def test_equal_rows_of_a_batch_are_worked_out_once():
    import pyarrow as pa

    from tessera.functions.sql import BATCHED, _over_rows

    calls = []
    rows = (pa.array(["a", "a", None, "a", None, "b"]), pa.array([1, 1, 2, 1, None, 1]))
    assert _over_rows(lambda *r: calls.append(r) or r, rows) == [("a", 1), ("a", 1), (None, 2), ("a", 1), (None, None), ("b", 1)] and len(calls) == 4
    signs = pa.array([0.0, -0.0, None])
    assert _over_rows(BATCHED["json_array"][0], (signs, pa.array([True, False, None]))) == ["[0.0,true]", "[-0.0,false]", "[null,null]"]
    assert _over_rows(BATCHED["json_set"][0], (pa.array(['{"k":1}', '{"k":1}', "{"]), pa.array(["$.k"] * 3), pa.array([5, 6, 7]))) == ['{"k":5}', '{"k":6}', None]
