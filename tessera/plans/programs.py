"""Programs that a client writes for specs, asked again with what was wrong when one is refused or fails."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.errors import ExecutionError, UnsafeExpressionError
from tessera.operators.program import check_program, run_program
from tessera.plans.client import Client
from tessera.settings import EvaluationSettings
from tessera.spec import FeatureSpec, strip_fences

TASK = (
    "Write a Python function generate_features(df) that takes a pandas DataFrame and returns a DataFrame with a row for each of its rows and the columns that are asked for, all numbers. "
    "Import pandas, numpy and math only; read and write nothing. Answer with code alone."
)


@dataclass
class ProgramWriter:
    """``attempts`` answers at most: the first that passes the checks, and runs on ``sample`` rows, is taken."""

    client: Client
    settings: EvaluationSettings = field(default_factory=EvaluationSettings)
    attempts: int = 2
    sample: int = 20
    failures: list[str] = field(default_factory=list)

    def messages(self, df: DataFrame, specs: list[FeatureSpec]) -> list[dict[str, str]]:
        wanted = json.dumps({"table": {f.name: f.dataType.simpleString() for f in df.schema}, "features": [json.loads(s.to_json()) for s in specs]})
        return [{"role": "system", "content": TASK}, {"role": "user", "content": wanted}]

    def write(self, df: DataFrame, specs: list[FeatureSpec], row_id: str) -> str:
        asked = self.messages(df, specs)
        for _ in range(self.attempts):
            code = strip_fences(self.client.complete(asked))
            try:
                check_program(code, columns=df.columns)
                self.run(df.limit(self.sample), code, specs, row_id).count()
                return code
            except (UnsafeExpressionError, ExecutionError) as err:
                self.failures.append(str(err))
                asked = [*asked, {"role": "assistant", "content": code}, {"role": "user", "content": f"That was refused: {err}. Answer with the whole code, mended."}]
        raise ExecutionError(f"no usable program after {self.attempts} attempts: {self.failures[-1]}")

    def run(self, df: DataFrame, code: str, specs: list[FeatureSpec], row_id: str, **options: Any) -> DataFrame:
        """``row_id`` and the features, within the time and memory of the settings."""
        schema = T.StructType([T.StructField(s.name, T.DoubleType()) for s in specs])
        return run_program(df.sparkSession, df, code, schema, row_id, timeout_s=self.settings.timeout_s, memory_mb=self.settings.memory_mb, **options)
