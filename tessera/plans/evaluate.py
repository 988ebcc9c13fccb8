"""Cross-validated gain of features over a baseline, with preprocessing learned on training folds only."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import EvaluationError
from tessera.operators.folds import FoldState, kfold, learn, stratified_folds, value_of
from tessera.operators.gram import applies, linear_scores
from tessera.operators.metrics import MetricRegistry, auc_of_classes
from tessera.operators.profile import content_key, is_number
from tessera.operators.selection import training_quantiles
from tessera.plans.models import ModelRegistry
from tessera.sources.dataset import TableSpec


@dataclass
class Evaluator:
    """Scores of columns by cross-validation. ``model_params`` go to the model; folds depend on row ids and seed alone."""

    task: str = "classification"
    metric: str = "auc"
    model: str = "random_forest"
    folds: int = 5
    seed: int = 42
    workers: int = 4
    model_params: dict[str, Any] = field(default_factory=dict)
    metrics: MetricRegistry = field(default_factory=MetricRegistry)
    models: ModelRegistry = field(default_factory=ModelRegistry)
    _baselines: dict[tuple, float] = field(default_factory=dict, repr=False)

    def folded(self, df: DataFrame, table: TableSpec) -> DataFrame:
        """``df`` with ``fold``, its own if it has one."""
        if "fold" in df.columns:
            return df
        return stratified_folds(df, table.target, table.row_id, self.folds, self.seed) if self.task == "classification" else kfold(df, table.row_id, self.folds, self.seed)

    def labelled(self, df: DataFrame, target: str) -> tuple[DataFrame, int]:
        """``df`` with a numeric ``__label``, and the number of classes."""
        if self.task == "regression":
            return df.withColumn("__label", F.col(target).cast("double")), 0
        classes = [r[0] for r in df.select(F.col(target)).filter(F.col(target).isNotNull()).distinct().limit(1001).collect()]
        if len(classes) > 1000:
            raise EvaluationError("more than 1000 classes")
        ordered = sorted(classes)
        table = F.create_map(*[x for i, c in enumerate(ordered) for x in (F.lit(c), F.lit(float(i)))]) if ordered else None
        return df.withColumn("__label", table[F.col(target)] if table is not None else F.lit(None).cast("double")), len(ordered)

    def usable(self, df: DataFrame, columns: list[str]) -> list[str]:
        return [c for c in columns if c in df.columns and (is_number(df.schema[c].dataType) or df.schema[c].dataType.simpleString() == "string")]

    def score(self, df: DataFrame, table: TableSpec, columns: list[str], state: FoldState | None = None) -> float:
        """Mean of the metric over folds, for a model of ``columns``; ``df`` may have its folds in ``fold``, and their state may be known."""
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise EvaluationError(f"no column {', '.join(missing)}")
        columns = self.usable(df, columns)
        if not columns:
            raise EvaluationError("no columns that a model can take")
        metric = self.metrics.get(self.metric)
        data = self.folded(df, table)
        data, classes = self.labelled(data.select(table.target, "fold", *columns), table.target)
        data = data.filter("__label is not null")
        state = state or learn(data, columns, self.folds)
        many = metric.needs_score and classes > 2

        def one(k: int) -> DataFrame:
            ready = state.apply(data.select("fold", F.col("__label").alias("label"), *columns), columns, k)
            assembled = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(ready).select("fold", "label", "features")
            estimator = self.models.get(self.model, self.task, self.seed, classes, len(columns), **self.model_params)
            out = estimator.fit(assembled.filter(F.col("fold") != k)).transform(assembled.filter(F.col("fold") == k))
            given = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
            if many:
                if given is None:
                    raise EvaluationError(f"{self.model} gives no score for each class")
                return out.select("fold", "label", vector_to_array(given).alias("prediction"))
            if metric.needs_score and given == "probability":
                out = out.withColumn("prediction", vector_to_array("probability")[1])
            return out.select("fold", "label", "prediction")

        with ThreadPoolExecutor(self.workers) as pool:
            predicted = reduce(DataFrame.union, pool.map(one, range(self.folds))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if many:
                scores = [r["auc"] for r in auc_of_classes(predicted, "label", "prediction", classes, ["fold"]).collect()]
            elif metric.name == "auc":
                scores = [r["auc"] for r in metric.fn(predicted, "label", "prediction", ["fold"]).collect()]
            else:
                scores = [metric.value(predicted.filter(F.col("fold") == k), "label", "prediction") for k in range(self.folds)]
        finally:
            predicted.unpersist()
        scores = [s for s in scores if s is not None]
        if not scores:
            raise EvaluationError("no fold could be scored")
        return sum(scores) / len(scores)

    def baseline(self, df: DataFrame, table: TableSpec, columns: list[str], state: FoldState | None = None) -> float:
        """The score of ``columns``, remembered by the content of the frame."""
        key = (content_key(df.select(table.target, *columns)), self.metric, self.model, self.folds, self.seed)
        if key not in self._baselines:
            self._baselines[key] = self.score(df, table, columns, state)
        return self._baselines[key]

    def gain(self, df: DataFrame, table: TableSpec, columns: list[str], feature: str, base: float | None = None, state: FoldState | None = None) -> float:
        base = self.baseline(df, table, columns, state) if base is None else base
        return self.metrics.get(self.metric).gain(self.score(df, table, [*[c for c in columns if c != feature], feature], state), base)

    def gains(self, df: DataFrame, table: TableSpec, columns: list[str], features: list[str], fail: bool = False) -> tuple[float, list[dict]]:
        """The baseline, and ``{feature, gain, error}`` of each feature.

        The folded frame is computed once for all, and so is what preprocessing learns; ``workers`` features are scored at a time.
        """
        data = self.folded(df, table).persist(StorageLevel.MEMORY_AND_DISK)
        context = df.sparkSession.sparkContext
        try:
            known = self.usable(data, [*columns, *[f for f in features if f not in columns]])
            if self._closed(data, known):
                return self._closed_gains(data, table, columns, features)
            try:
                state = learn(data.filter(F.col(table.target).isNotNull()), known, self.folds)
            except EvaluationError:  # of one column: each score says so for itself
                state = None
            base = self.baseline(data, table, columns, state)

            def one(f: str) -> dict:
                context.setJobDescription(f"gain of {f}")
                try:
                    return {"feature": f, "gain": self.gain(data, table, columns, f, base, state), "error": None}
                except Exception as err:  # noqa: BLE001  one feature must not stop the others
                    if fail:
                        raise
                    return {"feature": f, "gain": None, "error": str(err).splitlines()[0]}
                finally:
                    context.setJobDescription(None)

            with ThreadPoolExecutor(self.workers) as pool:
                return base, list(pool.map(one, features))
        finally:
            data.unpersist()


    def _closed(self, data: DataFrame, known: list[str]) -> bool:
        """Whether scores follow from sums of products: linear regression of numbers, with its own builder and metric."""
        plain = self.models.is_builtin("linear") and self.metrics.is_builtin(self.metric)
        return self.task == "regression" and self.model == "linear" and plain and applies(self.model_params, self.metric) and all(is_number(data.schema[c].dataType) for c in known)

    def _closed_gains(self, data: DataFrame, table: TableSpec, columns: list[str], features: list[str]) -> tuple[float, list[dict]]:
        base, new = self.usable(data, columns), [f for f in self.usable(data, features) if f not in columns]
        if not base:
            raise EvaluationError("no columns that a model can take")
        labelled = data.filter(F.col(table.target).isNotNull())
        lost = labelled.agg(*[F.count_if(value_of(c).isNull()).alias(f"n{i}") for i, c in enumerate([*base, *new])]).first()
        holes = [c for c, n in zip([*base, *new], lost, strict=True) if n]
        medians = training_quantiles(labelled, {c: value_of(c) for c in holes}, 0.5, self.folds) if holes else {}
        score, scores = linear_scores(data, table.target, base, new, self.folds, medians, self.metric, float(self.model_params.get("regParam", 1e-3)))
        if score != score:
            raise EvaluationError("no fold could be scored")
        gain = self.metrics.get(self.metric).gain
        found = {f: gain(s, score) for f, s in scores.items()} | {f: 0.0 for f in features if f in base}
        return score, [{"feature": f, "gain": found.get(f), "error": None if f in found else f"no column {f}" if f not in data.columns else "a model can't take it"} for f in features]


def select_top(gains: list[dict], k: int) -> list[str]:
    """Features of positive gain, the ``k`` best; earlier ones first among equals."""
    good = [g for g in gains if g["gain"] is not None and g["gain"] > 0]
    return [g["feature"] for g in sorted(good, key=lambda g: -g["gain"])[:k]]
