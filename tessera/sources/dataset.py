"""Datasets: what they are, where they come from, and a registry of them."""

from __future__ import annotations

import importlib.metadata
import json
import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.errors import DatasetError
from tessera.operators.profile import null_for_nan


@dataclass(frozen=True)
class TableSpec:
    """Which column identifies a row, and which one is learned."""

    row_id: str
    target: str
    ignored: tuple[str, ...] = ()

    def features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (self.row_id, self.target, "fold", *self.ignored)]


@dataclass
class Dataset:
    name: str
    train: DataFrame
    target: str
    test: DataFrame | None = None
    row_id: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def table(self) -> TableSpec:
        return TableSpec(self.row_id or self.train.columns[0], self.target)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV by the path's ending; missing numbers become null. A schema saves CSV and JSON a pass."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        out = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind in ("json", "jsonl"):
        out = reader.json(path)
    elif kind == "orc":
        out = reader.orc(path)
    else:
        out = reader.parquet(path)
    return null_for_nan(out)


class Fetcher(Protocol):
    """Brings the files of a remote dataset to a folder that Spark reads, and names them."""

    def fetch(self, slug: str) -> list[str]: ...


def load_fetched(spark: SparkSession, fetcher: Fetcher, slug: str, target: str, row_id: str | None = None) -> Dataset:
    """Of the fetched CSV files ``train.csv`` (or the first) is the table; ``test.csv`` is kept beside it."""
    files = {os.path.basename(p): p for p in sorted(fetcher.fetch(slug)) if p.endswith(".csv")}
    if not files:
        raise DatasetError(f"{slug} has no CSV files")
    train = read_table(spark, files.get("train.csv") or next(iter(files.values())))
    test = read_table(spark, files["test.csv"]) if "test.csv" in files else None
    return Dataset(slug, train, target, test, row_id, {"source": slug, "features": len(train.columns) - 1, "rows": train.count()})


Loader = Callable[[SparkSession], Dataset]


class DatasetRegistry:
    def __init__(self, folder: str | None = None, entry_points: str | None = "tessera.datasets"):
        self._known: dict[str, Loader] = {}
        self._info: dict[str, dict[str, Any]] = {}
        if folder:
            self.add_folder(folder)
        if entry_points:
            for point in importlib.metadata.entry_points(group=entry_points):
                try:
                    self.register(point.name, point.load(), {"source": "plugin"})
                except Exception as err:  # noqa: BLE001  a broken plugin must not stop the others
                    warnings.warn(f"dataset plugin {point.name} can't be loaded: {err}", stacklevel=2)

    def register(self, name: str, loader: Loader, info: dict[str, Any] | None = None) -> None:
        if name in self._known:
            warnings.warn(f"dataset {name} is replaced", stacklevel=2)
        self._known[name], self._info[name] = loader, {"name": name} | (info or {})

    def add_folder(self, folder: str) -> None:
        """Registers each subfolder that has a ``metadata.json`` with a ``target``; ``train`` and ``test`` are read beside it."""
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name, "metadata.json")
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as source:
                    info = json.load(source)
                if "target" not in info:
                    raise DatasetError(f"{path} names no target")
                self.register(info.get("name", name), lambda spark, at=os.path.join(folder, name), info=info: self._local(spark, at, info), info | {"source": "local"})

    @staticmethod
    def _local(spark: SparkSession, folder: str, info: dict[str, Any]) -> Dataset:
        def part(stem: str) -> DataFrame | None:
            for kind in ("parquet", "csv", "json"):
                if os.path.exists(f"{folder}/{stem}.{kind}"):
                    return read_table(spark, f"{folder}/{stem}.{kind}")
            return None

        train = part("train")
        if train is None:
            train = spark.createDataFrame([], T.StructType([T.StructField(info["target"], T.StringType())]))
        return Dataset(info.get("name", os.path.basename(folder)), train, info["target"], part("test"), info.get("row_id"), info)

    def names(self) -> list[str]:
        return sorted(self._known)

    def info(self, name: str) -> dict[str, Any]:
        return self._info[self._checked(name)]

    def load(self, spark: SparkSession, name: str) -> Dataset:
        return self._known[self._checked(name)](spark)

    def _checked(self, name: str) -> str:
        if name not in self._known:
            raise KeyError(f"unknown dataset {name}; known: {', '.join(self.names())}")
        return name
