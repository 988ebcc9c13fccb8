"""All combinations of what an experiment varies."""

from __future__ import annotations

from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ExperimentMatrix:
    def __init__(self):
        self._axes: dict[str, list[Any]] = {}

    def _axis(self, name: str, values: list[Any]) -> ExperimentMatrix:
        self._axes[name] = list(values)
        return self

    def datasets(self, *names: str) -> ExperimentMatrix:
        return self._axis("dataset", list(names))

    def methods(self, *names: str, **configured: list[dict]) -> ExperimentMatrix:
        """Names, or names with a list of configurations each, which are expanded."""
        pairs = [(n, {}) for n in names] + [(n, c) for n, many in configured.items() for c in many]
        return self._axis("method", pairs)

    def models(self, *names: str) -> ExperimentMatrix:
        return self._axis("model", list(names))

    def seeds(self, *seeds: int) -> ExperimentMatrix:
        return self._axis("seed", list(seeds))

    def rounds(self, *rounds: int) -> ExperimentMatrix:
        return self._axis("n_rounds", list(rounds))

    def add_param(self, name: str, *values: Any) -> ExperimentMatrix:
        return self._axis(name, list(values))

    def generate(self) -> list[dict[str, Any]]:
        rows = []
        for values in product(*self._axes.values()) if self._axes else []:
            row = dict(zip(self._axes, values, strict=True))
            if isinstance(row.get("method"), tuple):
                row["method"], row["method_config"] = row["method"]
            rows.append(row)
        return rows

    def __len__(self) -> int:
        n = 1 if self._axes else 0
        for values in self._axes.values():
            n *= len(values)
        return n

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The matrix as a cross join of its axes; all but the first are broadcast, as a cartesian product would multiply their partitions."""
        out = None
        for name, values in self._axes.items():
            axis = spark.createDataFrame([(v[0] if isinstance(v, tuple) else v,) for v in values], [name])
            out = axis if out is None else out.crossJoin(F.broadcast(axis))
        if out is None:
            raise ValueError("the matrix has no axes")
        return out
