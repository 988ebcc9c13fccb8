"""Runs a matrix of configurations, one by one or in threads, and the platform that ties datasets, methods and models."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.experiment.matrix import ExperimentMatrix
from tessera.experiment.reporter import report_best, report_mean, report_summary
from tessera.experiment.tracker import Track
from tessera.operators.metrics import Metric, MetricRegistry
from tessera.plans.evaluate import Evaluator
from tessera.plans.methods import MethodRegistry, RoundsMethod
from tessera.plans.models import ModelRegistry
from tessera.settings import Settings
from tessera.sources.dataset import Dataset, DatasetRegistry

RESULT = "run_id long, dataset string, method string, model string, seed long, cv_score double, gain double, baseline_score double, num_features_generated long, error string"


@dataclass
class Runner:
    track: Track = field(default_factory=Track)

    def _one(self, i: int, config: dict[str, Any], fn: Callable[[dict], dict]) -> dict[str, Any]:
        with self.track.run(f"run-{i}", config) as log:
            try:
                row = config | fn(config)
            except Exception as err:  # noqa: BLE001  a failed run is a row
                row = config | {"error": str(err).splitlines()[0] if str(err) else type(err).__name__}
            log.put("result", {k: v for k, v in row.items() if k not in config})
        return {"run_id": i} | row

    def run(self, configs: list[dict[str, Any]], fn: Callable[[dict], dict], workers: int = 1, progress: Callable[[int, int], None] | None = None) -> list[dict[str, Any]]:
        """Rows in the order of the configurations. Threads share the session; a process could not."""
        rows: list[dict[str, Any]] = []
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for row in pool.map(lambda x: self._one(x[0], x[1], fn), enumerate(configs)):
                rows.append(row)
                if progress:
                    progress(len(rows), len(configs))
        return rows


@dataclass
class Platform:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    datasets: DatasetRegistry = field(default_factory=DatasetRegistry)
    methods: MethodRegistry = field(default_factory=MethodRegistry)
    models: ModelRegistry = field(default_factory=ModelRegistry)
    metrics: MetricRegistry = field(default_factory=MetricRegistry)
    client: Any = None
    rows: list[dict[str, Any]] = field(default_factory=list)

    def register_dataset(self, dataset: Dataset) -> None:
        self.datasets.register(dataset.name, lambda spark: dataset, dataset.metadata)

    def register_method(self, name: str, build: Callable[..., Any]) -> None:
        self.methods.register(name, build)

    def register_model(self, name: str, build: Callable[..., Any]) -> None:
        self.models.register(name, build)

    def register_metric(self, metric: Metric) -> None:
        self.metrics.register(metric)

    def _evaluator(self, config: dict[str, Any], folds: int | None) -> Evaluator:
        s = self.settings
        return Evaluator(task=s.task, metric=s.metric, model=config["model"], folds=folds or s.evaluation.cv_folds, seed=config["seed"], metrics=self.metrics, models=self.models, model_params=config.get("model_params", {}))

    def _method(self, config: dict[str, Any], evaluator: Evaluator):
        method = self.methods.get(config["method"], **config.get("method_config", {}))
        if isinstance(method, RoundsMethod):
            method.engine.settings = replace(self.settings, random_state=config["seed"], n_rounds=config.get("n_rounds", self.settings.n_rounds))
            method.engine.evaluator = evaluator
        for name, value in (("client", self.client), ("evaluator", evaluator), ("settings", self.settings)):
            if value is not None and getattr(method, name, 0) is None:
                setattr(method, name, value)
        return method

    def run(self, datasets: list[str], methods: list[str], models: list[str] | None = None, seeds: list[int] | None = None, cv_folds: int | None = None, workers: int = 1, track: Track | None = None, holdout: bool = False, model_params: dict[str, Any] | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
        """Runs all combinations; with ``holdout`` methods learn on the training part and are scored on the test part."""
        matrix = ExperimentMatrix().datasets(*datasets).methods(*methods).models(*(models or [self.settings.model])).seeds(*(seeds or [self.settings.random_state]))

        def one(config: dict[str, Any]) -> dict[str, Any]:
            data = self.datasets.load(self.spark, config["dataset"])
            evaluator = self._evaluator(config | {"model_params": model_params or {}}, cv_folds)
            method = self._method(config, evaluator).fit(data.train, data.table)
            scored = data.test if holdout and data.test is not None else data.train
            base = evaluator.baseline(scored, data.table, data.table.features(scored))
            out = method.transform(scored)
            score = evaluator.score(out, data.table, data.table.features(out))
            return {"cv_score": score, "gain": evaluator.metrics.get(evaluator.metric).gain(score, base), "baseline_score": base, "num_features_generated": len(method.scripts)}

        self.rows += Runner(track or Track()).run(matrix.generate(), one, workers, progress)
        return self.to_frame()

    def to_frame(self) -> DataFrame:
        names = [x.split()[0] for x in RESULT.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows], RESULT)

    def report(self) -> DataFrame:
        return report_mean(self.to_frame())

    def report_best(self, metric: str = "cv_score") -> DataFrame:
        return report_best(self.to_frame(), metric)

    def summary(self) -> DataFrame:
        return report_summary(self.to_frame())
