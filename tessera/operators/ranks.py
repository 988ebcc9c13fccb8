"""Ranks and quantiles over whole tables without a one-partition window.

Values are first reduced to counts by value, which are written once. Where there are more different values than one task should
order, approximate quantiles of them cut them into ranges; sums of earlier ranges are added to ranks inside each range. Results
are exact whatever the cuts are.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import lasting

#: Different values that a task orders.
VALUES_PER_RANGE = 1 << 18
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def scaled(value: Column, kind: str, low: str | None = None, high: str | None = None) -> Column | None:
    """A double that never falls where ``value`` rises: equal ones are in one range. None for kinds without one.

    Of texts, the six bytes after what the least and the greatest of them begin with.
    """
    if kind in NUMBERS or kind.startswith("decimal"):
        return value.cast("double")
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind == "timestamp":
        return value.cast("double")
    if kind == "timestamp_ntz":
        return F.unix_date(value.cast("date")).cast("double")
    if kind == "string":
        shared = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), shared + 1, 6)), 12, "0"), 16, 10).cast("double")
    return None


def value_ranks(df: DataFrame, column: str, by: list[str] | None = None, **more: Column) -> DataFrame:
    """(``by``, ``value``, ``n``, ``below``): how often each value occurs and how many are smaller, within ``by``; ``more`` aggregates of each value."""
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()])
    counts, kind = lasting(counts, "counts"), dict(df.dtypes)[column]
    ranges, cuts, scale = -(-counts.count() // VALUES_PER_RANGE), [], None
    if ranges > 1:
        ends = counts.agg(F.min("value"), F.max("value")).first() if kind == "string" else (None, None)
        scale = scaled(F.col("value"), kind, *ends)
        if scale is not None:
            cuts = sorted(set(counts.select(scale.alias("value")).approxQuantile("value", [i / ranges for i in range(1, ranges)], min(0.005, 0.25 / ranges))))
    place = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda e: e <= scale))
    ranged = counts.withColumn("__range", place)
    inside = Window.partitionBy(*by, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sums = ranged.groupBy(*by, "__range").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row for each range and group
    same = F.col("r.__range") == F.col("s.__range")
    for c in by:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = ranged.alias("r").join(starts.alias("s"), same)
    return joined.select(*[F.col(f"r.{c}") for c in by], "value", "n", (F.col("__before") + F.col("__inside")).alias("below"), *more)


def average_ranks(df: DataFrame, column: str, by: list[str] | None = None, **more: Column) -> DataFrame:
    """(``by``, ``value``, ``n``, ``rank``): ties share the mean of their ranks."""
    by = by or []
    return value_ranks(df, column, by, **more).select(*by, "value", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"), *more)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(``by``, a column for each share): exact quantiles, linear between neighbours, of numbers; a row for each group that has values."""
    by = by or []
    ranks = value_ranks(df.select(*by, F.col(column).cast("double").alias("value")), "value", by)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("__total"))
    same = F.lit(True)
    for c in by:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    # without groups the total is one row
    joined = ranks.alias("r").join(total.alias("t"), same) if by else ranks.alias("r").crossJoin(F.broadcast(total.alias("t")))
    sides = []
    for i, share in enumerate(shares.values()):
        at = (F.col("__total") - 1) * F.lit(float(share))
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
            sides.append(F.max(F.when(here, F.col("value"))).alias(f"__{side}{i}"))
        sides.append(F.first(at - F.floor(at)).alias(f"__part{i}"))
    found = joined.groupBy(*[F.col(f"r.{c}").alias(c) for c in by]).agg(*sides, F.count("*").alias("__values")).filter("__values > 0")
    between = lambda i: F.when(F.col(f"__low{i}") == F.col(f"__high{i}"), F.col(f"__low{i}")).otherwise((1 - F.col(f"__part{i}")) * F.col(f"__low{i}") + F.col(f"__part{i}") * F.col(f"__high{i}"))
    return found.select(*by, *[between(i).alias(name) for i, name in enumerate(shares)])
