"""Exact order statistics of many columns by repeated histograms, for whole tables and for the training rows of folds.

A double becomes 64 bits whose order is that of the numbers. Each pass counts, by fold, the next bits of the values that share the
bits found so far with an order statistic that is looked for; counts of a training fold are the total less its own fold. A
pass is one aggregate for all columns, of bounded state, and none counts all different values. When few values are left they
come back as they are, so three passes are the rule and ``len(DIGITS)`` the most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that each pass settles.
DIGITS = (16, 12, 12, 12, 12)
#: Values left at which they are returned.
FEW = 1 << 14
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    bits = (values + 0.0).view(np.uint64)  # -0.0 is 0.0
    return np.where(bits & _SIGN != 0, ~bits, bits | _SIGN)


def number_of(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _counts(known: int, digit: int, sought: list[list[int]]):
    """Counts by (column, fold, first ``known + digit`` bits) of the values whose first ``known`` bits are sought."""

    def run(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            fold = np.asarray(batch.column(0))
            for c, prefixes in enumerate(sought):
                values = np.asarray(batch.column(c + 1).cast(pa.float64()).fill_null(np.nan))
                here = ~np.isnan(values)
                bits = ordered_bits(values[here])
                if known:
                    on = np.isin(bits >> np.uint64(64 - known), np.array(prefixes, np.uint64))
                    bits, own = bits[on], fold[here][on]
                else:
                    own = fold[here]
                head = bits >> np.uint64(64 - known - digit)
                for f in np.unique(own).tolist():
                    keys, n = np.unique(head[own == f], return_counts=True)
                    if (c, f) in total:
                        before, m = total[c, f]
                        keys, at = np.unique(np.concatenate((before, keys)), return_inverse=True)
                        n = np.bincount(at, np.concatenate((m, n))).astype(np.int64)
                    total[c, f] = keys, n
        for (c, f), (keys, n) in total.items():
            yield pa.record_batch([pa.array(np.full(len(n), c, np.int32)), pa.array(np.full(len(n), f, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["c", "fold", "head", "n"])

    return run


def training_quantiles(df: DataFrame, values: dict[str, Column], share: float, k: int, lower: bool = False) -> dict[str, list[float | None]]:
    """Of each value, the exact quantile (linear between neighbours) of the training rows of folds 0 to k - 1 of ``fold``; null where there are none; with ``lower``, the lower neighbour."""
    return {name: found[0] for name, found in quantiles_of(df, values, [share], k, lower).items()}


def quantiles_of(df: DataFrame, values: dict[str, Column], shares: list[float], k: int = 1, lower: bool = False) -> dict[str, list[list[float | None]]]:
    """The same for several shares at once, by value and share; without a column ``fold``, of all rows."""
    df = df if "fold" in df.columns else df.withColumn("fold", F.lit(-1))
    names = list(values)
    data = df.select(F.col("fold").cast("int").alias("fold"), *[v.cast("double").alias(f"x{i}") for i, v in enumerate(values.values())])
    sought: list[list[int]] = [[0] for _ in names]
    rank: dict[tuple[int, int, int], tuple[int, int]] = {}  # (column, training fold, side): bits so far, and rank among the values that have them
    part: dict[tuple[int, int, int], float] = {}
    known, done = 0, False
    for step, width in enumerate(DIGITS):
        digit = 64 - known if done else width
        found = data.mapInArrow(_counts(known, digit, sought), "c int, fold int, head long, n long").groupBy("c", "fold", "head").agg(F.sum("n").alias("n")).toArrow()
        column, fold, head, n = np.asarray(found["c"]), np.asarray(found["fold"]), np.asarray(found["head"]).view(np.uint64), np.asarray(found["n"])
        left = 0
        for c in range(len(names)):
            mine = column == c
            heads, at = np.unique(head[mine], return_inverse=True)
            every = np.bincount(at, n[mine], len(heads)).astype(np.int64)
            following: set[int] = set()
            for f in range(k):
                own = fold[mine] == f
                train = every - np.bincount(at[own], n[mine][own], len(heads)).astype(np.int64)
                if step == 0:
                    many = int(train.sum())
                    if not many:
                        continue
                    for q, share in enumerate(shares):
                        place = (many - 1) * share
                        part[c, f, q] = place - math.floor(place)
                        for side, r in enumerate((math.floor(place), math.ceil(place))):
                            rank[c, f, 2 * q + side] = (0, r)
                for side in range(2 * len(shares)):
                    if (c, f, side) in rank:
                        bits, r = rank[c, f, side]
                        lo, hi = (0, len(heads)) if not known else np.searchsorted(heads, np.array([bits << digit, ((bits + 1) << digit) - 1], np.uint64), "left").tolist()
                        hi = hi + 1 if known and hi < len(heads) and int(heads[hi]) == ((bits + 1) << digit) - 1 else hi
                        up = np.cumsum(train[lo:hi])
                        at_digit = int(np.searchsorted(up, r, "right"))
                        rank[c, f, side] = (int(heads[lo + at_digit]), r - int(up[at_digit - 1] if at_digit else 0))
                        following.add(int(heads[lo + at_digit]))
            sought[c] = sorted(following)
            left += int(every[np.isin(heads, np.array(sought[c], np.uint64))].sum())
        known += digit
        if known == 64:
            break
        done = left <= FEW * max(len(names), 1)
    out: dict[str, list[list[float | None]]] = {}
    for c, name in enumerate(names):
        out[name] = []
        for q in range(len(shares)):
            ends = [(number_of(rank[c, f, 2 * q][0]), number_of(rank[c, f, 2 * q + 1][0]), part[c, f, q]) if (c, f, 2 * q) in rank else None for f in range(k)]
            out[name].append([None if e is None else e[0] if lower or e[0] == e[1] else (1 - e[2]) * e[0] + e[2] * e[1] for e in ends])
    return out
