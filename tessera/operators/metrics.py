"""Metrics as exact aggregates of (label, prediction); each gives a frame of one row, or a row for each group."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EvaluationError
from tessera.operators.ranks import average_ranks


def auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by the sum of average ranks; labels are 0 and 1. Null where a class is missing."""
    by = by or []
    counted = df.select(*by, F.col(label).cast("int").alias("__y"), F.col(score).cast("double").alias("__s"))
    ranked = average_ranks(counted, "__s", by, p=F.count_if(F.col("__y") == 1))
    p, n = F.sum("p").cast("double"), F.sum("n").cast("double")
    area = (F.sum(F.col("p") * F.col("rank")) - p * (p + 1) / 2) / (p * (n - p))
    return ranked.groupBy(*by).agg(F.when((p > 0) & (p < n), area).alias("auc"))


def auc_ovr(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """Mean of each class against the rest; ``scores`` names the score column of each class."""
    parts = [auc(df.select((F.col(label).cast("string") == F.lit(c)).cast("int").alias("y"), F.col(s).alias("s")), "y", "s") for c, s in scores.items()]
    every = parts[0]
    for other in parts[1:]:
        every = every.union(other)
    return every.agg(F.avg("auc").alias("auc"))


def auc_of_classes(df: DataFrame, label: str, scores: str, classes: int, by: list[str]) -> DataFrame:
    """The same within ``by``, for labels from 0 on and an array of a score for each; classes that a group lacks don't count."""
    one = F.explode(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("c"), (F.col(label) == c).cast("int").alias("y"), F.get(F.col(scores), c).alias("s"))))
    each = auc(df.select(*by, one.alias("one")).select(*by, F.col("one.c").alias("class"), "one.y", "one.s"), "y", "s", [*by, "class"])
    return each.groupBy(*by).agg(F.avg("auc").alias("auc"))


def acc(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"))


def f1_macro(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Mean over the classes that labels or predictions hold of ``2tp / (2tp + fp + fn)``, 0 where undefined."""
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("is_y"), (F.col("y") == F.col("p")).cast("int").alias("tp"), "n"), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_y"), F.lit(0).alias("tp"), "n"))).alias("s")).select("s.*")
    each = sides.groupBy("c").agg(F.sum(F.col("tp") * F.col("n")).alias("tp"), F.sum("n").alias("both"))
    return each.agg(F.avg(F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both")).otherwise(0.0)).alias("f1"))


def _error(label: str, pred: str) -> Column:
    return F.col(label).cast("double") - F.col(pred).cast("double")


def rmse(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(_error(label, pred) * _error(label, pred))).alias("rmse"))


def mae(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg(F.abs(_error(label, pred))).alias("mae"))


def r2(df: DataFrame, label: str, pred: str) -> DataFrame:
    e, y = _error(label, pred), F.col(label).cast("double")
    spread = F.var_pop(y) * F.count(y)
    return df.agg(F.when(spread > 0, 1 - F.sum(e * e) / spread).otherwise(0.0).alias("r2"))


def nrmse(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Root mean square error over the labels' range; 0 without a range."""
    e, y = _error(label, pred), F.col(label).cast("double")
    reach = F.max(y) - F.min(y)
    return df.agg(F.when(reach > 0, F.sqrt(F.avg(e * e)) / reach).otherwise(0.0).alias("nrmse"))


@dataclass(frozen=True)
class Metric:
    name: str
    fn: Callable[[DataFrame, str, str], DataFrame]
    greater_is_better: bool = True
    needs_score: bool = False

    def value(self, df: DataFrame, label: str, pred: str) -> float | None:
        return self.fn(df, label, pred).first()[0]

    def gain(self, new: float, base: float) -> float:
        """Improvement, positive where ``new`` is better."""
        return new - base if self.greater_is_better else base - new


class MetricRegistry:
    def __init__(self):
        self._replaced: set[str] = set()
        self._known = {m.name: m for m in (Metric("auc", auc, needs_score=True), Metric("acc", acc), Metric("f1", f1_macro), Metric("rmse", rmse, False), Metric("mae", mae, False), Metric("r2", r2), Metric("nrmse", nrmse, False))}

    def register(self, metric: Metric) -> None:
        if metric.name in self._known:
            warnings.warn(f"metric {metric.name} is replaced", stacklevel=2)
        self._replaced.add(metric.name)
        self._known[metric.name] = metric

    def get(self, name: str) -> Metric:
        if name not in self._known:
            raise EvaluationError(f"unknown metric {name}; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def is_builtin(self, name: str) -> bool:
        return name in self._known and name not in self._replaced

    def names(self) -> list[str]:
        return sorted(self._known)
