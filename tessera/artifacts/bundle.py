"""Bundles of a method's features, scripts, iterations and provenance, saved as JSON and Parquet."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import ConfigurationError
from tessera.plans.methods import BaseMethod, MethodRegistry
from tessera.session import held
from tessera.sources.dataset import TableSpec

FORMATS = ("parquet", "csv", "orc", "json")
FEATURE = "method string, feature string, type string, transform string, logic string, base_columns array<string>, agent_name string, gain double"
PROVENANCE = "method string, feature string, script_sha256 string, base_columns array<string>, iteration long, details map<string,string>"


def digest(script: str) -> str:
    return hashlib.sha256(script.encode()).hexdigest()


@dataclass
class ArtifactBundle:
    method: str
    features: list[dict[str, Any]] = field(default_factory=list)
    scripts: dict[str, str] = field(default_factory=dict)
    iterations: list[dict[str, Any]] = field(default_factory=list)
    config: dict[str, Any] = field(default_factory=dict)
    error: str | None = None

    @classmethod
    def of(cls, method: BaseMethod, **config: Any) -> ArtifactBundle:
        """Scripts are kept once each, by their digest."""
        return cls(method.name, method.feature_metadata(), {digest(s): s for s in method.scripts}, method.iterations, config)

    def gains(self) -> list[tuple[str, float | None]]:
        return [(f["name"], f.get("gain")) for f in self.features]

    def feature_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.method, f["name"], f["type"], f["transform"], f["logic"], list(f["base_columns"]), f["agent_name"], f.get("gain")) for f in self.features], FEATURE)

    def provenance_frame(self, spark: SparkSession) -> DataFrame:
        rows = []
        for f in self.features:
            at = next((i["iteration"] if "iteration" in i else i.get("round") for i in self.iterations if f["name"] in (i.get("kept") or [])), None)
            made = next((d for d, s in self.scripts.items() if f["name"] in s), None)
            rows.append((self.method, f["name"], made, list(f["base_columns"]), at, {"agent": f["agent_name"], "transform": f["transform"]}))
        return spark.createDataFrame(rows, PROVENANCE)

    def save(self, spark: SparkSession, path: str, frames: dict[str, DataFrame] | None = None) -> None:
        """Through Spark's writers, so any store that Spark reaches will do."""
        manifest = asdict(self) | {"frames": sorted(frames or {})}
        spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        for name, frame in (frames or {}).items():
            frame.write.mode("overwrite").parquet(f"{path}/frames/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[ArtifactBundle, dict[str, DataFrame]]:
        manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
        names = manifest.pop("frames")
        return cls(**manifest), {n: spark.read.parquet(f"{path}/frames/{n}") for n in names}


class FrameStore:
    """Frames by key: ``memory`` keeps plans (persisted, spilling to disk), ``disk`` writes and reads lazily, ``hybrid`` writes those whose plan says they are large."""

    def __init__(self, spark: SparkSession, folder: str, mode: str = "hybrid", fmt: str = "parquet", spill_bytes: int = 50 << 20):
        if mode not in ("memory", "disk", "hybrid"):
            raise ConfigurationError(f"unknown storage mode {mode}")
        if fmt not in FORMATS:
            raise ConfigurationError(f"{fmt} isn't a format that Spark writes; use {', '.join(FORMATS)}")
        self.spark, self.folder, self.mode, self.fmt, self.spill_bytes = spark, folder, mode, fmt, spill_bytes
        self._memory: dict[str, DataFrame] = {}
        self._disk: dict[str, Any] = {}

    def store(self, key: str, df: DataFrame) -> None:
        large = self.mode == "hybrid" and self._bytes(df) > self.spill_bytes
        if self.mode == "disk" or large:
            writer = df.write.mode("overwrite")
            (writer.option("header", True) if self.fmt == "csv" else writer).format(self.fmt).save(f"{self.folder}/{key}")
            self._disk[key] = df.schema
        else:
            self._memory[key] = df.persist()

    @staticmethod
    def _bytes(df: DataFrame) -> int:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def load(self, key: str) -> DataFrame:
        if key in self._memory:
            return self._memory[key]
        if key not in self._disk:
            raise KeyError(key)
        reader = self.spark.read.schema(self._disk[key]).format(self.fmt)
        return (reader.option("header", True) if self.fmt == "csv" else reader).load(f"{self.folder}/{key}")

    def keys(self) -> list[str]:
        return sorted({*self._memory, *self._disk})


def compare_methods(registry: MethodRegistry, methods: list[str], df: DataFrame, table: TableSpec, options: dict[str, dict[str, Any]] | None = None) -> dict[str, ArtifactBundle]:
    """A bundle for each method; a method that fails leaves its error and doesn't stop the others."""
    found = {}
    with held(df):
        for name in methods:
            try:
                found[name] = ArtifactBundle.of(registry.get(name, **(options or {}).get(name, {})).fit(df, table))
                found[name].method = name
            except Exception as err:  # noqa: BLE001
                found[name] = ArtifactBundle(name, error=str(err))
    return found
