"""The engine as a ``pyspark.ml`` estimator; the fitted transformer keeps specs, and can be saved."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame

from tessera.errors import ConfigurationError
from tessera.functions.registry import Stat
from tessera.operators.compile import Compiler, State
from tessera.plans.engine import Engine, RunResult
from tessera.settings import load_settings
from tessera.sources.dataset import TableSpec
from tessera.spec import FeatureSpec


class _Writer(DefaultParamsWriter):
    """Parameters, and the tables of statistics beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for i, state in enumerate(self.instance.states or []):
            if state.whole is not None:
                state.whole.write.parquet(f"{path}/states/{i}/whole")
            for k, table in enumerate(state.keyed.values()):
                table.write.parquet(f"{path}/states/{i}/key-{k}")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> FeatureModel:
        model = super().load(path)
        shapes = json.loads(model.getOrDefault(model.shapes))
        if shapes is not None:
            read = self.sparkSession.read.parquet
            model.states = []
            for i, shape in enumerate(shapes):
                names = {Stat(f, v, tuple(k), a): n for f, v, k, a, n in shape["names"]}
                keyed = {tuple(key): read(f"{path}/states/{i}/key-{k}") for k, key in enumerate(shape["keys"])}
                model.states.append(State(read(f"{path}/states/{i}/whole") if shape["whole"] else None, keyed, names))
        return model


class FeatureModel(Transformer, MLWritable, MLReadable):
    """Appends the selected features, with the statistics of the frame that was fitted.

    Without fitted statistics (``states`` is None) they are those of the frame that is transformed. Rows of groups that the
    fitted frame hadn't get nulls from features of those groups.
    """

    specs = Param(Params._dummy(), "specs", "selected specs as JSON", TypeConverters.toString)
    shapes = Param(Params._dummy(), "shapes", "which statistics there are, as JSON", TypeConverters.toString)

    def __init__(self, specs: list[FeatureSpec] | None = None, states: list[State] | None = None):
        super().__init__()
        self._setDefault(specs="[]", shapes="null")
        if specs is not None:
            self._set(specs=json.dumps([json.loads(s.to_json()) for s in specs]))
        self.states = states
        if states is not None:
            shape = [{"whole": s.whole is not None, "keys": [list(k) for k in s.keyed], "names": [[x.fn, x.value, list(x.key), x.arg, n] for x, n in s.names.items()]} for s in states]
            self._set(shapes=json.dumps(shape))
        self.result: RunResult | None = None

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def feature_specs(self) -> list[FeatureSpec]:
        return [FeatureSpec.from_dict(d) for d in json.loads(self.getOrDefault(self.specs))]

    def get_feature_names_out(self, columns: list[str]) -> list[str]:
        return [*columns, *[s.name for s in self.feature_specs() if s.name not in columns]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        done = Compiler().transform(dataset, self.feature_specs(), self.states)
        self.failures = done.failures
        return done.frame


class FeatureEngineer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Runs the engine on the frame; ``settings`` is a JSON object of settings."""

    row_id = Param(Params._dummy(), "row_id", "column that identifies a row", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "column that is learned", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "engine mode", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, row_id: str | None = None, target: str | None = None, mode: str = "full", settings: str = "{}"):
        super().__init__()
        self._setDefault(mode="full", settings="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.engine: Engine | None = None

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        if not self.isSet(self.row_id) or not self.isSet(self.target):
            raise ConfigurationError("row_id and target must be set")
        engine = self.engine or Engine(load_settings(environ={}, **json.loads(self.getOrDefault(self.settings))), self.getOrDefault(self.mode))
        result = engine.run(dataset, TableSpec(self.getOrDefault(self.row_id), self.getOrDefault(self.target)))
        model = FeatureModel(result.specs, Compiler().fit(dataset, result.specs))
        model.result = result
        return model
