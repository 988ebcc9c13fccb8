"""Where a value stands in its column: standard scores, quantiles, ranks, outliers, rare values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.registry import Stat, op
from tessera.functions.unary import number


@op("local_transform", 1, lambda c: [Stat("mean", c), Stat("std", c)])
def zscore(found: dict[Stat, Column], c: str, eps: float = 1e-8) -> Column:
    return (number(F.col(c)) - found[Stat("mean", c)]) / (found[Stat("std", c)] + F.lit(eps))


@op("local_transform", 1, lambda c, q=0.5: [Stat("quantile", c, (), q)])
def above_quantile(found: dict[Stat, Column], c: str, q: float = 0.5) -> Column:
    return F.coalesce(number(F.col(c)) > found[Stat("quantile", c, (), q)], F.lit(False)).cast("int")


@op("local_transform", 1, lambda c, parts=4: [Stat("quantile", c, (), i / parts) for i in range(1, parts)])
def quantile_bin(found: dict[Stat, Column], c: str, parts: int = 4) -> Column:
    cuts = [F.when(number(F.col(c)) > found[Stat("quantile", c, (), i / parts)], 1).otherwise(0) for i in range(1, parts)]
    return F.when(F.col(c).isNotNull(), sum(cuts, F.lit(0)))


@op("local_pattern", 1, lambda c, k=3.0: [Stat("mean", c), Stat("std", c)])
def zscore_outlier(found: dict[Stat, Column], c: str, k: float = 3.0) -> Column:
    return F.coalesce(F.abs(number(F.col(c)) - found[Stat("mean", c)]) > F.lit(float(k)) * found[Stat("std", c)], F.lit(False)).cast("int")


@op("local_pattern", 1, lambda c, k=1.5: [Stat("quantile", c, (), 0.25), Stat("quantile", c, (), 0.75)])
def iqr_outlier(found: dict[Stat, Column], c: str, k: float = 1.5) -> Column:
    low, high, x = found[Stat("quantile", c, (), 0.25)], found[Stat("quantile", c, (), 0.75)], number(F.col(c))
    reach = F.lit(float(k)) * (high - low)
    return F.coalesce((x < low - reach) | (x > high + reach), F.lit(False)).cast("int")


@op("local_pattern", 1, lambda c, share=0.01: [Stat("rows", c, (c,)), Stat("rows", c)])
def rare_value(found: dict[Stat, Column], c: str, share: float = 0.01) -> Column:
    return F.coalesce(found[Stat("rows", c, (c,))] < F.lit(float(share)) * found[Stat("rows", c)], F.lit(False)).cast("int")


@op("local_transform", 1, lambda c: [Stat("rank", c, (c,)), Stat("values", c)])
def percent_rank_average(found: dict[Stat, Column], c: str) -> Column:
    """Average rank over the number of values: ties share their mean rank."""
    return found[Stat("rank", c, (c,))] / found[Stat("values", c)]


@op("local_transform", 1, lambda c: [Stat("rank", c, (c,))])
def average_rank(found: dict[Stat, Column], c: str) -> Column:
    return found[Stat("rank", c, (c,))]
