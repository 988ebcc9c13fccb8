"""Operations on one column. Guards keep results equal under ANSI mode: no overflow, no division by zero, no log of a negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.registry import op


def number(c: Column) -> Column:
    return c.cast("double")


@op("unary", 1)
def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.when(c.isNotNull(), F.greatest(number(c), F.lit(0.0))))


@op("unary", 1)
def log1p_abs(c: Column) -> Column:
    return F.log1p(F.abs(number(c)))


@op("unary", 1)
def safe_log(c: Column, zero: float | str | None = None) -> Column:
    """Natural logarithm of the absolute value; at zero ``zero``, null unless given ("-inf" is SQL's)."""
    log = F.when(number(c) != 0, F.ln(F.abs(number(c))))
    return log if zero is None else F.when(number(c) == 0, F.lit(float(zero))).otherwise(log)


@op("unary", 1)
def sqrt_clipped(c: Column) -> Column:
    return F.sqrt(F.when(c.isNotNull(), F.greatest(number(c), F.lit(0.0))))


@op("unary", 1)
def square(c: Column) -> Column:
    return number(c) * number(c)


@op("unary", 1)
def power(c: Column, exponent: float = 2.0) -> Column:
    return F.pow(number(c), F.lit(float(exponent)))


@op("unary", 1)
def exp_neg(c: Column) -> Column:
    return F.exp(-number(c))


@op("unary", 1)
def absolute(c: Column) -> Column:
    return F.abs(number(c))


@op("unary", 1)
def scaled(c: Column, by: float = 1.0, plus: float = 0.0) -> Column:
    return number(c) * F.lit(float(by)) + F.lit(float(plus))


@op("unary", 1)
def to_number(c: Column) -> Column:
    """What isn't a number becomes null."""
    return c.cast("string").try_cast("double")


@op("unary", 1)
def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    x = number(c)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


@op("unary", 1)
def fill(c: Column, value=0) -> Column:
    return F.coalesce(c, F.lit(value))


@op("unary", 1)
def flag(c: Column, above: float | None = None, equals=None) -> Column:
    """1 where the predicate holds, else 0, also for null."""
    hit = c == F.lit(equals) if above is None else number(c) > F.lit(float(above))
    return F.coalesce(hit, F.lit(False)).cast("int")


@op("unary", 1)
def mapped(c: Column, mapping: dict | None = None, otherwise=-1) -> Column:
    if not mapping:
        return F.lit(otherwise)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(otherwise))


@op("unary", 1)
def digitized(c: Column, bins: list | None = None) -> Column:
    """How many of the rising ``bins`` are at most the value."""
    edges = [F.when(number(c) >= F.lit(float(b)), 1).otherwise(0) for b in bins or []]
    return F.when(c.isNotNull(), sum(edges, F.lit(0)))


@op("unary", 1)
def signed_log(c: Column) -> Column:
    return F.signum(number(c)) * F.log1p(F.abs(number(c)))


@op("unary", 1)
def squashed(c: Column) -> Column:
    return F.tanh(number(c))


@op("unary", 1)
def cube_root(c: Column) -> Column:
    return F.cbrt(number(c))


@op("unary", 1)
def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-number(c)))


@op("unary", 1)
def rounded(c: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(number(c), digits)


@op("unary", 1)
def residual(c: Column) -> Column:
    return number(c) - F.floor(number(c))


@op("unary", 1)
def json_number(c: Column, path: str = "$") -> Column:
    return F.get_json_object(c, path).try_cast("double")


@op("unary", 1)
def first_number(c: Column) -> Column:
    """The first number in a text."""
    return F.regexp_extract(c.cast("string"), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
