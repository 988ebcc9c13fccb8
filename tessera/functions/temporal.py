"""Parts of dates, elapsed time, lags and rolling windows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.registry import op
from tessera.functions.unary import number

PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "week": F.weekofyear, "hour": F.hour, "minute": F.minute, "weekday": F.weekday}


@op("temporal", 1)
def date_part(c: Column, part: str = "year") -> Column:
    """``weekday`` is 0 on Mondays."""
    return PARTS[part](c)


@op("temporal", 1)
def cyclic(c: Column, part: str = "month", period: float = 12, wave: str = "sin") -> Column:
    angle = PARTS[part](c).cast("double") * F.lit(2 * math.pi / period)
    return F.sin(angle) if wave == "sin" else F.cos(angle)


@op("temporal", 1)
def days_since(c: Column, reference: str = "1970-01-01") -> Column:
    return F.datediff(c, F.lit(reference).cast("date"))


@op("temporal", 1)
def is_weekend(c: Column) -> Column:
    return (F.weekday(c) >= 5).cast("int")


@op("temporal", 1)
def is_month_start(c: Column) -> Column:
    return (F.dayofmonth(c) == 1).cast("int")


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


@op("temporal", None)
def seconds_since_previous(key: Column, time: Column, *tie: Column) -> Column:
    return seconds(time) - seconds(F.lag(time).over(Window.partitionBy(key).orderBy(time, *tie)))


@op("temporal", 2)
def seconds_since_first(key: Column, time: Column) -> Column:
    return seconds(time) - seconds(F.min(time).over(Window.partitionBy(key)))


@op("local_transform", None)
def lagged(key: Column, time: Column, value: Column, *tie: Column, steps: int = 1) -> Column:
    """The value ``steps`` rows before (after, if negative)."""
    return F.lag(value, steps).over(Window.partitionBy(key).orderBy(time, *tie))


@op("local_transform", None)
def difference(key: Column, time: Column, value: Column, *tie: Column) -> Column:
    return number(value) - F.lag(number(value)).over(Window.partitionBy(key).orderBy(time, *tie))


ROLLING = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}


@op("local_transform", None)
def rolling(key: Column, time: Column, value: Column, *tie: Column, rows: int = 3, fn: str = "mean") -> Column:
    """Of the last ``rows`` rows; null until there are so many."""
    w = Window.partitionBy(key).orderBy(time, *tie).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) == rows, ROLLING[fn](number(value)).over(w))
