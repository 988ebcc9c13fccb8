"""Models by name, as ``pyspark.ml`` estimators over a vector column ``features`` and a column ``label``."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from tessera.errors import EvaluationError


def _forest(task: str, seed: int, classes: int, width: int, **params: Any):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return kind(**{"numTrees": 100, "maxDepth": 8, "seed": seed} | params)


#: What tells the three boosters apart: how trees grow, and what keeps leaves from being small.
BOOSTERS = {
    "xgboost": {"growth": "depth", "depth": 6, "l2": 1.0, "min_hessian": 1.0},
    "lightgbm": {"growth": "leaves", "leaves": 31, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20},
    "catboost": {"growth": "symmetric", "depth": 6, "l2": 3.0, "min_hessian": 0.0},
}


def _boosted(name: str):
    def build(task: str, seed: int, classes: int, width: int, **params: Any):
        from tessera.operators.boosting import Booster

        kind = "regression" if task == "regression" else "binary" if classes <= 2 else "softmax"
        names = {"maxIter": "rounds", "stepSize": "rate", "maxDepth": "depth"}  # as pyspark.ml calls them
        return Booster(kind=kind, outputs=classes if kind == "softmax" else 1, **BOOSTERS[name] | {names.get(k, k): v for k, v in params.items()})

    return build


def _perceptron(task: str, seed: int, classes: int, width: int, **params: Any):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    if task != "classification":
        from tessera.operators.perceptron import Perceptron

        names = {"maxIter": "steps", "layers": "hidden"}  # as pyspark.ml calls them; layers are the hidden ones here
        return Perceptron(**{"seed": seed} | {names.get(k, k): v for k, v in params.items()})
    return MultilayerPerceptronClassifier(**{"layers": [width, 128, 64, max(classes, 2)], "maxIter": 500, "seed": seed} | params)


def _linear(task: str, seed: int, classes: int, width: int, **params: Any):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    return LogisticRegression(**{"regParam": 1e-3, "maxIter": 30} | params) if task == "classification" else LinearRegression(**{"regParam": 1e-3} | params)


Builder = Callable[..., Any]


class ModelRegistry:
    def __init__(self):
        self._replaced: set[str] = set()
        self._known: dict[str, Builder] = {"random_forest": _forest, **{name: _boosted(name) for name in BOOSTERS}, "mlp": _perceptron, "linear": _linear}

    def register(self, name: str, build: Builder) -> None:
        if name in self._known:
            warnings.warn(f"model {name} is replaced", stacklevel=2)
        self._replaced.add(name)
        self._known[name] = build

    def is_builtin(self, name: str) -> bool:
        return name in self._known and name not in self._replaced

    def names(self) -> list[str]:
        return sorted(self._known)

    def get(self, name: str, task: str = "classification", seed: int = 42, classes: int = 2, width: int = 1, **params: Any):
        if name not in self._known:
            raise EvaluationError(f"unknown model {name}; known: {', '.join(self.names())}")
        if task not in ("classification", "regression"):
            raise EvaluationError(f"unknown task {task}")
        return self._known[name](task, seed, classes, width, **params)
