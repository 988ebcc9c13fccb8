"""Statistics of groups, given back to the rows of each group. A null key has no group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.registry import Stat, op
from tessera.functions.unary import number

STATS = ("mean", "count", "sum", "min", "max", "median", "std", "nunique")


def _declare(fn: str) -> None:
    def stats(key: str, value: str) -> list[Stat]:
        return [Stat(fn, value, (key,))]

    @op("aggregation", 2, stats, name=f"group_{fn}")
    def build(found: dict[Stat, Column], key: str, value: str) -> Column:
        return found[Stat(fn, value, (key,))]


for _fn in STATS:
    _declare(_fn)


@op("aggregation", 2, lambda key, value: [Stat("mean", value, (key,))])
def group_deviation(found: dict[Stat, Column], key: str, value: str) -> Column:
    return number(F.col(value)) - found[Stat("mean", value, (key,))]


@op("aggregation", 2, lambda key, value: [Stat("mean", value, (key,))])
def group_ratio(found: dict[Stat, Column], key: str, value: str) -> Column:
    mean = found[Stat("mean", value, (key,))]
    return F.when(mean != 0, number(F.col(value)) / mean)


@op("aggregation", 1, lambda key: [Stat("rows", key, (key,))])
def frequency(found: dict[Stat, Column], key: str) -> Column:
    """Rows that share the value."""
    return found[Stat("rows", key, (key,))]


@op("aggregation", 2, lambda key, value: [Stat("rank", value, (key, value))])
def group_rank(found: dict[Stat, Column], key: str, value: str) -> Column:
    """Average rank within the group."""
    return found[Stat("rank", value, (key, value))]
