"""Operations across columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.registry import op
from tessera.functions.unary import number


@op("cross_compositional", None)
def total(*columns: Column) -> Column:
    """Sum across columns; nulls count as nothing."""
    return reduce(lambda a, b: a + b, (F.coalesce(number(c), F.lit(0.0)) for c in columns))


@op("cross_compositional", 2)
def add(a: Column, b: Column) -> Column:
    return number(a) + number(b)


@op("cross_compositional", 2)
def subtract(a: Column, b: Column) -> Column:
    return number(a) - number(b)


@op("cross_compositional", 2)
def multiply(a: Column, b: Column) -> Column:
    return number(a) * number(b)


@op("cross_compositional", 2)
def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(number(b) != 0, F.try_divide(number(a), number(b))).when(b.isNotNull() & a.isNotNull(), 0.0)


@op("cross_compositional", 2)
def eps_ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return number(a) / (F.abs(number(b)) + F.lit(float(eps)))


@op("cross_compositional", 2)
def smaller(a: Column, b: Column, skip_nulls: bool = False) -> Column:
    found = F.least(number(a), number(b))
    return found if skip_nulls else F.when(a.isNotNull() & b.isNotNull(), found)


@op("cross_compositional", 2)
def larger(a: Column, b: Column, skip_nulls: bool = False) -> Column:
    found = F.greatest(number(a), number(b))
    return found if skip_nulls else F.when(a.isNotNull() & b.isNotNull(), found)


@op("cross_compositional", None)
def energy(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, (number(c) * number(c) for c in columns))


@op("cross_compositional", 2)
def combined(a: Column, b: Column, null: str = "<null>") -> Column:
    """Two categories as one."""
    return F.concat_ws("_", F.coalesce(a.cast("string"), F.lit(null)), F.coalesce(b.cast("string"), F.lit(null)))


def pairs(names: list[str], most: int | None = None) -> list[tuple[str, str]]:
    """All pairs in order, ``most`` at most."""
    found = list(combinations(names, 2))
    return found if most is None else found[:most]
