"""What rounds remember: how features were made, what they gained, and what failed."""

from __future__ import annotations

import json
import os
import tempfile
from collections import Counter, deque
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.spec import FeatureSpec

FEEDBACK_SCHEMA = "agent string, feature_name string, transform string, base_columns array<string>, type string, metric string, value double, effective boolean, ord long"
SUMMARIES = 20


@dataclass
class Memory:
    """Records by feature name; the first of a name stays."""

    procedural: dict[str, dict[str, Any]] = field(default_factory=dict)
    feedback: dict[str, dict[str, Any]] = field(default_factory=dict)
    unused: dict[str, dict[str, Any]] = field(default_factory=dict)
    conceptual: dict[str, str] = field(default_factory=dict)
    summaries: deque = field(default_factory=lambda: deque(maxlen=SUMMARIES))

    def record(self, spec: FeatureSpec, gain: float | None, metric: str, agent: str | None = None) -> None:
        own = {"agent": agent or spec.agent_name, "feature_name": spec.name}
        effective = gain is not None and gain > 0
        self.procedural.setdefault(spec.name, own | {"transform": spec.transform, "base_columns": list(spec.base_columns), "type": spec.type, "logic": spec.logic})
        self.feedback.setdefault(spec.name, own | {"metric": metric, "value": gain, "effective": effective})
        if not effective:
            self.unused.setdefault(spec.name, own)

    def positive(self, agent: str | None = None) -> list[str]:
        return [n for n, r in self.feedback.items() if r["effective"] and agent in (None, r["agent"])]

    def negative(self, agent: str | None = None) -> list[str]:
        return [n for n, r in self.unused.items() if agent in (None, r["agent"])]

    def top(self, k: int = 5, agent: str | None = None) -> list[str]:
        """The ``k`` best, as ``name → metric: value (rank i)``."""
        good = [(n, r) for n, r in self.feedback.items() if r["effective"] and agent in (None, r["agent"])]
        good.sort(key=lambda x: -x[1]["value"])
        return [f"{n} → {r['metric']}: {r['value']:.4f} (rank {i})" for i, (n, r) in enumerate(good[:k], 1)]

    def prompt(self, agent: str | None = None) -> str:
        best = self.top(agent=agent)
        return "Effective before:\n" + "\n".join(best) if best else ""

    def stats(self, min_effective: int = 1) -> dict[str, dict[str, int]]:
        kept = [self.procedural[n] for n, r in self.feedback.items() if r["effective"] and n in self.procedural]
        counted = {"transforms": Counter(p["transform"] for p in kept), "fields": Counter("-".join(sorted(p["base_columns"])) for p in kept), "types": Counter(p["type"] for p in kept)}
        return {k: {x: n for x, n in c.items() if n >= min_effective} for k, c in counted.items()}

    def summarise(self, agent: str) -> str:
        tried = [r for r in self.feedback.values() if r["agent"] == agent]
        good = sum(r["effective"] for r in tried)
        kinds = Counter(self.procedural[r["feature_name"]]["transform"] for r in tried if r["effective"])
        self.conceptual[agent] = f"{agent}: {good} of {len(tried)} features effective" + (f"; best kinds: {', '.join(k for k, _ in kinds.most_common(3))}" if kinds else "")
        return self.conceptual[agent]

    def summarise_round(self, text: str) -> None:
        self.summaries.append(text)

    def save(self, path: str) -> None:
        """Writes beside the file and renames, so a reader never sees half of it."""
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".json")
        with os.fdopen(fd, "w", encoding="utf-8") as out:
            json.dump(asdict(self) | {"summaries": list(self.summaries)}, out)
        os.replace(temp, path)

    @classmethod
    def load(cls, path: str) -> Memory:
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as source:
            data = json.load(source)
        return cls(**{k: data[k] for k in ("procedural", "feedback", "unused", "conceptual")}, summaries=deque(data["summaries"], maxlen=SUMMARIES))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r["agent"], n, p.get("transform"), p.get("base_columns"), p.get("type"), r["metric"], r["value"], r["effective"], i) for i, (n, r) in enumerate(self.feedback.items()) for p in (self.procedural.get(n, {}),)]
        return spark.createDataFrame(rows, FEEDBACK_SCHEMA)


def memory_stats(feedback: DataFrame, procedural: DataFrame, min_effective: int = 1) -> DataFrame:
    """``kind``, ``value``, ``n``: how often effective features used a transform, a set of columns, a type. First record of a name wins."""
    first = lambda df: df.groupBy("feature_name").agg(*[F.min_by(c, "ord").alias(c) for c in df.columns if c not in ("feature_name", "ord")])
    kept = first(feedback).filter("effective").join(first(procedural), "feature_name")
    kinds = F.array(F.struct(F.lit("transform").alias("kind"), F.col("transform").alias("value")), F.struct(F.lit("fields").alias("kind"), F.array_join(F.array_sort("base_columns"), "-").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")))
    return kept.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n")).filter(F.col("n") >= min_effective)


def feedback_top(feedback: DataFrame, k: int = 5) -> DataFrame:
    """``rank``, ``feature_name``, ``line`` of the best effective features."""
    from pyspark.sql.window import Window

    best = feedback.filter("effective").orderBy(F.desc("value"), "ord").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("value"), "ord")))
    return ranked.select("rank", "feature_name", F.concat("feature_name", F.lit(" → "), "metric", F.lit(": "), F.format_number("value", 4), F.lit(" (rank "), F.col("rank").cast("string"), F.lit(")")).alias("line"))
