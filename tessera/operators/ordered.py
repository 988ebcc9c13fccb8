"""Windows over the order of a whole table, or of hot keys, without a window of one partition.

Rows are cut into ranges of the order. Each range also gets the last rows of the ranges before it, as many as the windows look back; where a
range has fewer rows than that, the ones before it give the rest. Windows then run within ranges, and the rows that were
lent are left out. What is lent is at most the look-back times the number of ranges, and no task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranks import scaled

#: Rows that a range should have.
ROWS_PER_RANGE = 1 << 17


def loans(counts: list[int], back: int) -> list[tuple[int, int, int]]:
    """(lender, borrower, rows): how many of its last rows each range lends to later ones, so that each sees ``back`` rows."""
    out = []
    for borrower in range(1, len(counts)):
        missing, lender = back, borrower - 1
        while missing > 0 and lender >= 0:
            if counts[lender]:
                out.append((lender, borrower, min(missing, counts[lender])))
                missing -= counts[lender]
            lender -= 1
    return out


def over_order(df: DataFrame, order: list[str], back: int, made: Callable[[WindowSpec], dict[str, Column]], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with the columns that ``made`` gives for the window ordered by ``order`` (nulls first), which may look ``back`` rows back.

    ``order`` should tell rows apart; its first column cuts the ranges.
    """
    kind = df.schema[order[0]].dataType.simpleString()
    many = df.count()
    ranges, place = -(-many // rows_per_range), F.lit(0)
    if ranges > 1:
        ends = df.agg(F.min(order[0]), F.max(order[0])).first() if kind == "string" else (None, None)
        scale = scaled(F.col(order[0]), kind, *ends)
        if scale is None:
            raise ValueError(f"no ranges of {kind}")
        cuts = sorted(set(df.select(scale.alias("value")).approxQuantile("value", [i / ranges for i in range(1, ranges)], min(0.005, 0.25 / ranges))))
        place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda e: e <= scale))
    placed = df.withColumn("__range", place)
    held = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}  # a row for each range
    counts = [held.get(i, 0) for i in range(max(held, default=0) + 1)]
    lent = loans(counts, back)
    everything = placed.withColumn("__lent", F.lit(False))
    if lent:
        table = df.sparkSession.createDataFrame(lent, "__range int, __to int, __rows int")
        keys = [F.col(c).desc_nulls_last() for c in order]
        last = placed.withColumn("__back", F.row_number().over(Window.partitionBy("__range").orderBy(*keys))).filter(F.col("__back") <= back)
        halo = last.join(F.broadcast(table), "__range").filter(F.col("__back") <= F.col("__rows"))  # look-back times ranges at most
        everything = everything.unionByName(halo.select(*df.columns, F.col("__to").alias("__range"), F.lit(True).alias("__lent")))
    window = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    done = everything.select("*", *[c.alias(name) for name, c in made(window).items()])
    return done.filter(~F.col("__lent")).drop("__range", "__lent")


def trailing(df: DataFrame, column: str, order: list[str], rows: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with the column's ``lag``, ``diff`` and ``mean``, ``sum`` and ``std`` of the last ``rows`` values, in the order of the whole table."""

    def made(window: WindowSpec) -> dict[str, Column]:
        value, last = F.col(column), window.rowsBetween(1 - rows, 0)
        full = F.count(F.lit(1)).over(last) == rows
        before = F.lag(value).over(window)
        rolled = {f"{column}_{name}": F.when(full, f(value).over(last)) for name, f in (("mean", F.avg), ("sum", F.sum), ("std", F.stddev_samp))}
        return {f"{column}_lag": before, f"{column}_diff": value - before} | rolled

    return over_order(df, order, max(rows - 1, 1), made, rows_per_range)
