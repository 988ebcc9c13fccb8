"""Cross-validated scores of linear models with one more column each, from one pass over the rows.

Each fold's products of columns (1, target, base columns, candidates, and whether a value is missing) are summed in one aggregate. A training
fold is the total less its fold. Missing values that become a fold's median are a linear map of those products, so they need
no pass of their own. The base columns' matrix is inverted once for each fold, and each candidate borders it.
The held fold's squared errors follow from its own products.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import value_of

#: Metrics of a held fold, from its rows, squared errors, squared deviations and range of the target.
CLOSED: dict[str, Callable[[float, float, float, float], float]] = {
    "rmse": lambda n, error, spread, reach: (error / n) ** 0.5,
    "r2": lambda n, error, spread, reach: 1 - error / spread if spread > 0 else 0.0,
    "nrmse": lambda n, error, spread, reach: (error / n) ** 0.5 / reach if reach > 0 else 0.0,
}
#: Share of a column's variance that must be left when the others are known.
LEAST_LEFT = 1e-10


def _products(width: int, left: int, folds: int):
    """Sums by fold of the products of the first ``left`` columns with all, and of each column and its missing marks with themselves."""

    def run(batches):
        total = np.zeros((folds, left + 3, 2 * width))
        for batch in batches:
            fold = np.asarray(batch.column(0))
            values = np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan), np.float64) for c in batch.columns[1:]], 1)
            lost = np.isnan(values)
            z = np.concatenate((np.where(lost, 0.0, values), lost.astype(np.float64)), 1)
            for k in np.unique(fold).tolist():
                rows = z[fold == k]
                x, m = rows[:, :width], rows[:, width:]
                total[k, :left] += np.concatenate((x[:, : left // 2], m[:, : left // 2]), 1).T @ rows
                for i, own in enumerate((x * x, x * m, m * m)):
                    total[k, left + i, :width] += own.sum(0)
        flat = total.ravel()
        slot = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(slot), pa.array(flat[slot])], ["slot", "value"])

    return run


def linear_scores(df: DataFrame, label: str, columns: list[str], features: list[str], folds: int, medians: dict[str, list[float | None]], metric: str, reg: float) -> tuple[float, dict[str, float]]:
    """The score of ``columns``, and of each of ``features`` with them; ``df`` has ``fold``. As a ridge of standardised columns."""
    names = [*columns, *features]
    data = df.select("fold", value_of(label).alias("y"), *[value_of(c).alias(f"x{i}") for i, c in enumerate(names)]).filter("y is not null")
    middle = data.agg(F.avg("y"), *[F.avg(f"x{i}") for i in range(len(names))]).first()
    middle = np.array([0.0 if v is None else v for v in middle])
    reach = {r.fold: r[1] - r[2] for r in data.groupBy("fold").agg(F.max("y"), F.min("y")).collect()}
    shifted = data.select("fold", F.lit(1.0).alias("one"), (F.col("y") - F.lit(float(middle[0]))).alias("y"), *[(F.col(f"x{i}") - F.lit(float(middle[i + 1]))).alias(f"x{i}") for i in range(len(names))])
    width, base = len(names) + 2, len(columns) + 2
    left = 2 * base
    found = shifted.mapInArrow(_products(width, left, folds), "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(folds * (left + 3) * 2 * width)
    sums[np.asarray(found["slot"])] = np.asarray(found["value"])
    sums = sums.reshape(folds, left + 3, 2 * width)
    total, scores = sums.sum(0), []
    for k in range(folds):
        given = np.array([0.0, 0.0, *[(0.0 if medians.get(c, [None] * folds)[k] is None else medians[c][k]) - middle[i + 1] for i, c in enumerate(names)]])
        train, held = _filled(total - sums[k], given, base, width), _filled(sums[k], given, base, width)
        if held[0][0, 0] > 0:
            scores.append(_fold(train, held, base, reg, lambda n, e, s, k=k: CLOSED[metric](n, e, s, float(reach.get(k) or 0.0))))
    if not scores:
        return float("nan"), {}
    mean = np.mean(scores, 0)
    return float(mean[0]), dict(zip(features, mean[1:].tolist(), strict=True))


def _filled(sums: np.ndarray, given: np.ndarray, base: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the base columns with all, and each column's with itself, once missing values are ``given``."""
    xx, xm, mx, mm = sums[:base, :width], sums[:base, width:], sums[base : 2 * base, :width], sums[base : 2 * base, width:]
    g = given[:base, None]
    square = sums[-3, :width] + 2 * given * sums[-2, :width] + given**2 * sums[-1, :width]
    return xx + xm * given + g * mx + g * mm * given, square


def _fold(train: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], base: int, reg: float, metric: Callable[[float, float, float], float]) -> list[float]:
    """The metric of the base columns (the first), and with each other column."""
    rows, squares = train
    n = rows[0, 0]
    mean = rows[0] / n if n else rows[0]
    cross = rows / max(n, 1) - mean[:base, None] * mean
    variance = np.maximum(squares / max(n, 1) - mean**2, 0.0)
    spread = np.sqrt(variance)
    good = variance > LEAST_LEFT * np.maximum(squares / max(n, 1), 1e-300)
    scale = np.where(good, spread, 1.0)
    ridge = reg / spread[1] if spread[1] > 0 else 0.0
    on = np.flatnonzero(good[2:base]) + 2
    between = cross[np.ix_(on, on)] / np.outer(scale[on], scale[on])
    inverse = np.linalg.pinv(between + ridge * np.eye(len(on)), rcond=LEAST_LEFT, hermitian=True) if len(on) else np.zeros((0, 0))
    toward = cross[1] / scale  # each column with the target
    own = inverse @ toward[on]

    def error(columns: np.ndarray, slope: np.ndarray, at: int | None) -> float:
        """Squared errors of the held fold, for slopes of plain columns."""
        (h, square), m = held, mean
        lone = h[0, 0]
        centre = lambda i, j: h[i, j] - m[i] * h[0, j] - m[j] * h[0, i] + lone * m[i] * m[j]
        value = centre(1, 1) - 2 * sum(s * centre(1, c) for s, c in zip(slope, columns, strict=True))
        for s, c in zip(slope, columns, strict=True):
            for t, d in zip(slope, columns, strict=True):
                both = square[c] - 2 * m[c] * h[0, c] + lone * m[c] ** 2 if c == d == at else centre(min(c, d), max(c, d))
                value += s * t * both
        return max(float(value), 0.0)

    lone = held[0][0, 0]
    around = max(float(held[0][1, 1] - held[0][0, 1] ** 2 / lone), 0.0)
    out = [metric(lone, error(on, own / scale[on], None), around)]
    for c in range(base, rows.shape[1]):
        beside = cross[on, c] / (scale[on] * scale[c])
        solved = inverse @ beside
        rest = (1.0 + ridge if good[c] else 0.0) - beside @ solved
        if rest <= LEAST_LEFT:
            out.append(out[0])
            continue
        slope = (toward[c] - beside @ own) / rest
        out.append(metric(lone, error(np.append(on, c), np.append(own - solved * slope, slope) / scale[np.append(on, c)], c), around))
    return out


def applies(params: dict[str, Any], metric: str) -> bool:
    return metric in CLOSED and set(params) <= {"regParam"}
