"""Math functions: doubles in and out; a result that is not a number is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _unary(f):
    def call(x: Column) -> Column:
        return nan_to_null(f(_double(x)))

    return call


acos, acosh, asin, asinh, atan, atanh = map(_unary, (F.acos, F.acosh, F.asin, F.asinh, F.atan, F.atanh))
cos, cosh, sin, sinh, tan, tanh = map(_unary, (F.cos, F.cosh, F.sin, F.sinh, F.tan, F.tanh))
degrees, radians, exp, sqrt = map(_unary, (F.degrees, F.radians, F.exp, F.sqrt))


def abs(x: Column, kind: str = "double") -> Column:
    """kind 'bigint' keeps integers, with null where there is no positive twin; text that is no number is 0.0."""
    if kind == "bigint":
        return F.when(x != F.lit(-(1 << 63)), F.abs(x))
    return F.when(x.isNotNull(), F.abs(F.coalesce(_double(x), F.lit(0.0))))


def mod(a: Column, b: Column) -> Column:
    """Floating remainder with the dividend's sign; null for a divisor of 0."""
    return nan_to_null(F.try_mod(_double(a), F.nullif(_double(b), F.lit(0.0))))


def pow(a: Column, b: Column) -> Column:
    return nan_to_null(F.pow(_double(a), _double(b)))


def pi() -> Column:
    return F.pi()


def round(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the binary value, after scaling by a power of ten; digits below 0 count as 0."""
    scale = F.lit(float(10 ** max(0, digits)))
    scaled = _double(x) * scale
    whole = F.when(scaled < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.floor(F.abs(scaled) + F.lit(0.5)).cast("double")
    # From 2**52 on every double is whole, and adding a half could move it; just under a half it must not round up.
    near = F.when(F.abs(scaled) < F.lit(0.5), F.lit(0.0)).otherwise(whole)
    return F.when(F.abs(scaled) >= F.lit(float(1 << 52)), _double(x)).otherwise(near / scale)


def sign(x: Column) -> Column:
    return F.signum(_double(x)).cast("bigint")


def atan2(y: Column, x: Column) -> Column:
    return nan_to_null(F.atan2(_double(y), _double(x)))


def _whole(f, low: bool):
    """Double results: what is whole already, and a zero's sign, stays."""

    def call(x: Column) -> Column:
        v = _double(x)
        out = F.when((F.abs(v) >= F.lit(float(1 << 52))) | (v == 0), v)
        if low:
            out = out.when((v > -1) & (v < 0), F.lit(-0.0))
        return out.otherwise(f(v).cast("double"))

    return call


ceil, floor = _whole(F.ceil, True), _whole(F.floor, False)


def _log(f):
    """0 has the logarithm minus infinity, a negative number none."""

    def call(x: Column) -> Column:
        v = _double(x)
        return F.when(v == 0, F.lit(float("-inf"))).when(v > 0, f(v))

    return call


ln, log10, log2 = _log(lambda v: F.log(v)), _log(lambda v: F.log10(v)), _log(lambda v: F.log2(v))


def log(a: Column, b: Column | None = None) -> Column:
    """log(x) is to base 10, log(base, x) to a base."""
    return log10(a) if b is None else nan_to_null(ln(b) / F.nullif(ln(a), F.lit(0.0)))
