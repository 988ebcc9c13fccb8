"""Where the counted curve of a column breaks: the best division into straight pieces, for each key.

Values fall into ``bins`` equally wide bins between the extremes of their key, and are counted in one aggregate; a curve has ``bins`` points at
most, whatever the number of rows. For each key's curve dynamic programming finds the ``parts`` neighbouring pieces, each at
least ``degree`` + 1 bins long, whose level (``degree`` 0) or line (1) leaves the least squared error in all; of equally good ones those
that break first. Curves are spread over tasks by their keys. Keys without values have no row; one value makes one bin.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def curve(df: DataFrame, value: str, keys: list[str], bins: int) -> DataFrame:
    """``keys``, ``lo``, ``width``, ``bin``, ``n`` of bins that hold rows; null keys are a key."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).filter("__x is not null and not isnan(__x)")
    ends = rows.groupBy(*keys).agg(F.min("__x").alias("lo"), ((F.max("__x") - F.min("__x")) / bins).alias("width"))
    small = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], "lo", "width")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = rows.join(small, same, "left") if keys else rows.crossJoin(F.broadcast(small))
    place = F.when(F.col("width") > 0, F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("lo")) / F.col("width")))).otherwise(0)
    return both.groupBy(*keys, "lo", "width", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def costs(y: np.ndarray, degree: int) -> np.ndarray:
    """Least squared error of a level or line through points i to j - 1 (at [i, j]); infinite where they are too few."""
    i = np.arange(len(y))
    up = [np.concatenate(([0.0], np.cumsum(v))) for v in (np.ones(len(y)), y, y * y, i, i * i, i * y)]
    n, sy, syy, sx, sxx, sxy = [u[None, :] - u[:, None] for u in up]
    with np.errstate(divide="ignore", invalid="ignore"):
        error = syy - sy * sy / n
        if degree:
            error = error - np.where(n > 2, (sxy - sx * sy / n) ** 2 / (sxx - sx * sx / n), error)
    return np.where(n > degree, np.maximum(error, 0.0), np.inf)


def best_breaks(y: np.ndarray, parts: int, degree: int = 0) -> tuple[list[int], float]:
    """First points of the pieces, and their error; fewer pieces where there are too few points."""
    parts = max(1, min(parts, len(y) // (degree + 1)))
    cost = costs(np.asarray(y, float), degree)
    if not np.isfinite(cost[0, -1]):
        return [0], 0.0
    best, starts = cost[:, -1], []  # from each point to the end, with one piece
    for _ in range(parts - 1):
        whole = cost[:, :] + best[None, :]
        starts.append(whole.argmin(1))
        best = whole.min(1)
    out = [0]
    for at in reversed(starts):
        out.append(int(at[out[-1]]))
    return out, float(best[0])


def segments(df: DataFrame, value: str, keys: Iterable[str] = (), bins: int = 50, parts: int = 3, degree: int = 1) -> DataFrame:
    """``keys``, ``segment`` (from 0), ``first_bin``, ``begin`` (its value), ``n`` (rows), ``slope`` (rows a bin), ``turns`` (whether the slope's sign differs from that of the piece before)."""
    keys = list(keys)

    def divide(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
        y = np.zeros(bins if groups["width"].iloc[0] > 0 else 1)
        y[groups["bin"]] = groups["n"]
        first, _ = best_breaks(y, parts, degree)
        rows, before = [], 0.0
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(y)], strict=True)):
            slope = float(np.polyfit(np.arange(b - a), y[a:b], 1)[0]) if b - a > 1 else 0.0
            rows.append([k, a, float(groups["lo"].iloc[0] + a * groups["width"].iloc[0]), int(y[a:b].sum()), slope, int(slope * before < 0)])
            before = slope or before
        made = pd.DataFrame(rows, columns=["segment", "first_bin", "begin", "n", "slope", "turns"])
        for k in reversed(keys):
            made.insert(0, k, [groups[k].iloc[0]] * len(made))
        return made

    counted = curve(df, value, keys, bins)
    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return counted.groupBy(*keys).applyInPandas(divide, f"{own + ', ' if own else ''}segment int, first_bin int, begin double, n long, slope double, turns int")
