"""Feature-generation methods behind one protocol.

* ``rounds``: the engine of ``tessera.plans.engine``, with agents, router and memory;
* ``expressions``: a client proposes SQL expressions, once or over iterations with feedback; only those that gain are kept;
* ``iterative``: a client proposes specs per iteration, each feature judged on its own (with or without feedback);
* ``expansion``: all first-order operations, screened by variance, then by gain over growing samples (successive halving),
  and ranked by the importances of a forest.
"""

from __future__ import annotations

import importlib.metadata
import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import EvaluationError, PlanError, ProposalError
from tessera.operators.compile import Compiler, State, unique
from tessera.operators.profile import describe, is_classification, is_number
from tessera.operators.relevance import cuts_of, relevance
from tessera.operators.screen import prefilter
from tessera.operators.univariate import univariate_gains
from tessera.plans.client import Client
from tessera.plans.engine import Engine
from tessera.plans.evaluate import Evaluator
from tessera.plans.proposers import expansion, interaction_specs
from tessera.session import held
from tessera.settings import Settings
from tessera.sources.dataset import TableSpec
from tessera.spec import FeatureSpec, parse_specs, strip_fences


class Method(Protocol):
    name: str

    def fit(self, df: DataFrame, table: TableSpec) -> Method: ...

    def transform(self, df: DataFrame) -> DataFrame: ...


@dataclass
class BaseMethod:
    """Specs that ``fit`` has found, appended by ``transform``; ``gains`` and ``scripts`` say what was tried."""

    name: str = "base"
    specs: list[FeatureSpec] = field(default_factory=list)
    gains: dict[str, float | None] = field(default_factory=dict)
    scripts: list[str] = field(default_factory=list)
    iterations: list[dict[str, Any]] = field(default_factory=list)
    fitted: bool = False
    states: list[State] | None = None

    def fit(self, df: DataFrame, table: TableSpec) -> BaseMethod:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise PlanError(f"{self.name} isn't fitted")
        return Compiler().transform(df, self.specs, self.states).frame

    def _found(self, df: DataFrame, specs: list[FeatureSpec]) -> None:
        """What is fitted: specs, and their statistics on the training frame, which ``transform`` uses on any other."""
        self.specs, self.states, self.fitted = specs, Compiler().fit(df, specs), True

    def new_columns(self, df: DataFrame) -> DataFrame:
        """Only what ``transform`` adds."""
        out = self.transform(df)
        return out.select(*[c for c in out.columns if c not in df.columns])

    def fit_transform(self, df: DataFrame, table: TableSpec) -> DataFrame:
        return self.fit(df, table).transform(df)

    def feature_metadata(self) -> list[dict[str, Any]]:
        return [json.loads(s.to_json()) | {"gain": self.gains.get(s.name)} for s in self.specs]


@dataclass
class RoundsMethod(BaseMethod):
    name: str = "rounds"
    engine: Engine = field(default_factory=Engine)

    def fit(self, df: DataFrame, table: TableSpec) -> RoundsMethod:
        done = self.engine.run(df, table)
        self._found(df, done.specs)
        self.gains = {g["feature"]: g["gain"] for r in done.rounds for g in r.gains}
        self.scripts = [s.to_json() for r in done.rounds for s in r.specs]
        self.iterations = [r.summary() for r in done.rounds]
        return self


def feedback_line(gains: dict[str, float | None], kept: list[str], error: str | None) -> str:
    if error:
        return f"Previous iteration failed: {error}"
    told = "; ".join(f"{n}: {g:.4f} ({'kept' if n in kept else 'dropped'})" for n, g in gains.items() if g is not None)
    return f"Previous iteration feedback: {told}" if told else ""


@dataclass
class ClientMethod(BaseMethod):
    """A client proposes; each iteration is judged against the original table, and what gains is kept."""

    name: str = "expressions"
    client: Client | None = None
    evaluator: Evaluator | None = None
    settings: Settings = field(default_factory=Settings)
    n_features: int = 5
    max_iterations: int = 5
    single_shot: bool = False
    feedback: bool = True
    expressions: bool = True

    def _prompt(self, description: dict, told: str, task: str) -> list[dict[str, str]]:
        shape = "a JSON list of {name, code, description}; code is a Spark SQL expression" if self.expressions else "a JSON list of {base_columns, derived_features: [{name, type, transform, logic}]}"
        return [{"role": "system", "content": "You design features."}, {"role": "user", "content": f"Up to {self.n_features} features for {task}. Columns: {json.dumps(description, default=str)}. {told} Answer with {shape}."}]

    def _parse(self, answer: str) -> list[FeatureSpec]:
        if not self.expressions:
            return parse_specs(answer, self.name)
        try:
            found = json.loads(strip_fences(answer))
        except ValueError as err:
            raise ProposalError(f"the answer isn't JSON: {err}") from err
        found = found.get("features", []) if isinstance(found, dict) else found
        return [FeatureSpec(name=d["name"], logic=d["code"], transform="", agent_name=self.name, params={}) for d in found if isinstance(d, dict) and d.get("name") and d.get("code")]

    def fit(self, df: DataFrame, table: TableSpec) -> ClientMethod:
        if self.client is None:
            raise PlanError(f"{self.name} needs a client")
        task = "classification" if is_classification(df, table.target) else "regression"
        evaluator = self.evaluator or Evaluator(task=task, metric=self.settings.metric if task == "classification" else "r2", model=self.settings.model, folds=self.settings.evaluation.cv_folds, seed=self.settings.random_state)
        description, told = describe(df, table.features(df)), ""
        kept: list[FeatureSpec] = []
        for i in range(1 if self.single_shot else self.max_iterations):
            gains, names, error = {}, [], None
            try:
                answer = self.client.complete(self._prompt(description, told, task))
                self.scripts.append(answer)
                specs = self._parse(answer)[: self.n_features]
                done = Compiler().transform(df, specs)
                if self.single_shot:
                    kept, names = [s for s in specs if s.name in done.names], done.names
                else:
                    _, found = evaluator.gains(done.frame, table, table.features(df), done.names)
                    gains = {g["feature"]: g["gain"] for g in found}
                    names = [n for n, g in gains.items() if g is not None and g > 0]
                    kept += [s for s in specs if s.name in names]
                self.gains |= gains
                if done.failures and not done.names:
                    error = "; ".join(done.failures.values())
            except (ProposalError, EvaluationError) as err:
                error = str(err)
            told = feedback_line(gains, names, error) if self.feedback else ""
            self.iterations.append({"iteration": i + 1, "gains": gains, "kept": names, "error": error})
        self._found(df, unique(kept))
        return self


@dataclass
class ExpansionMethod(BaseMethod):
    """Expands columns, screens what comes out, and keeps the ``n_features`` of the largest importance.

    ``screen_to`` columns are left by variance. With ``order`` 2 all products of the ``paired`` best of them, by gain, are
    screened beside them. Targets may be numbers or any number of classes.
    """

    name: str = "expansion"
    evaluator: Evaluator | None = None
    n_features: int = 10
    screen_to: int = 50
    order: int = 1
    paired: int = 20
    task: str = "classification"
    importances: dict[str, float] = field(default_factory=dict)

    def candidates(self, df: DataFrame, table: TableSpec) -> list[FeatureSpec]:
        columns = table.features(df)
        numbers = [c for c in columns if is_number(df.schema[c].dataType)]
        texts = [c for c in columns if df.schema[c].dataType.simpleString() == "string"]
        return expansion(numbers, texts)

    def _judge(self, frame: DataFrame, names: list[str], classes: int) -> Callable[[DataFrame, list[str]], dict[str, float]]:
        """Scores of columns on a frame: how far the area under the curve is from a half for two classes, mutual information for
        several, the correlation ratio for numbers. Bins are those of the whole frame."""
        if classes == 2:
            return lambda part, some: {r["feature"]: r["gain"] for r in univariate_gains(part, "__label", some).collect()}
        cuts = cuts_of(frame.filter("__label is not null").withColumn("__target", F.col("__label")), [*names, *([] if classes else ["__target"])], 16)
        return lambda part, some: {r["feature"]: r["information"] if classes else r["ratio"] for r in relevance(part, "__label", some, classes, cuts=cuts).collect()}

    def _halve(self, frame: DataFrame, table: TableSpec, names: list[str], classes: int) -> list[str]:
        """Keeps the better half by univariate gain on twice as many rows each time; hashes of ids choose the rows."""
        share, judge = 1 / 4, None
        while len(names) > 2 * self.n_features and share <= 1:
            judge = judge or self._judge(frame, names, classes)
            part = frame.filter(F.pmod(F.xxhash64(table.row_id), F.lit(1000)) < int(share * 1000)) if share < 1 else frame
            gains = judge(part, names)
            names = sorted(names, key=lambda n: -(gains.get(n) or 0.0))[: max(len(names) // 2, self.n_features)]
            share *= 2
        return names

    def _screened(self, df: DataFrame, table: TableSpec, specs: list[FeatureSpec]) -> tuple[list[str], list[FeatureSpec]]:
        """Names that screening and halving leave, their ``importances`` known, and the specs with products. What is judged more than once is computed once."""
        from pyspark.ml.feature import VectorAssembler

        done = Compiler().transform(df, specs)
        numeric = [n for n in done.names if is_number(done.frame.schema[n].dataType)]
        names = prefilter(done.frame, numeric, self.screen_to)
        evaluator = self.evaluator or Evaluator(task=self.task, model_params={"numTrees": 20, "maxDepth": 5})
        if self.order > 1:
            best = names
            if len(names) > self.paired:
                with held(self._rows(done.frame, table, names)) as frame:
                    data, classes = evaluator.labelled(frame, table.target)
                    gains = self._judge(data, names, classes)(data, names)
                best = sorted(names, key=lambda n: -(gains.get(n) or 0.0))
            products = interaction_specs(best[: self.paired])
            specs, done = specs + products, Compiler().transform(done.frame, products)
            names = prefilter(done.frame, names + done.names, self.screen_to)
        with held(self._rows(done.frame, table, names)) as frame:
            data, classes = evaluator.labelled(frame, table.target)
            names = self._halve(data, table, names, classes)
            if names:
                ready = data.select("__label", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]).filter("__label is not null")
                model = evaluator.models.get("random_forest", self.task, evaluator.seed, 2, len(names), numTrees=20, maxDepth=5).fit(VectorAssembler(inputCols=names, outputCol="features").transform(ready).withColumnRenamed("__label", "label"))
                self.importances = {n: float(model.featureImportances[i]) for i, n in enumerate(names)}
        return names, specs

    def _rows(self, df: DataFrame, table: TableSpec, names: list[str]) -> DataFrame:
        return df.select(*dict.fromkeys([table.row_id, table.target, *names]))

    def fit(self, df: DataFrame, table: TableSpec) -> ExpansionMethod:
        specs = self.candidates(df, table)
        with held(df):
            names, specs = self._screened(df, table, specs)
        best = sorted(names, key=lambda n: -self.importances.get(n, 0.0))[: self.n_features]
        by_name = {s.name: s for s in specs}
        wanted = list(best)
        for n in wanted:  # parents of second-order features come along
            wanted += [b for b in by_name[n].base_columns if b in by_name and b not in wanted]
        self.gains = dict(self.importances)
        self._found(df, [by_name[n] for n in reversed(wanted)])
        return self


def feedback_method(**kw: Any) -> ClientMethod:
    """Two iterations with feedback."""
    return ClientMethod(**({"name": "feedback", "max_iterations": 2} | kw))


def evolving_method(**kw: Any) -> ClientMethod:
    """Five iterations without feedback."""
    return ClientMethod(**({"name": "evolving", "feedback": False, "expressions": False} | kw))


class MethodRegistry:
    def __init__(self, entry_points: str | None = "tessera.methods"):
        self._known: dict[str, Callable[..., BaseMethod]] = {"rounds": RoundsMethod, "expressions": ClientMethod, "feedback": feedback_method, "evolving": evolving_method, "expansion": ExpansionMethod}
        if entry_points:
            for point in importlib.metadata.entry_points(group=entry_points):
                try:
                    self.register(point.name, point.load())
                except Exception as err:  # noqa: BLE001  a broken plugin must not stop the others
                    warnings.warn(f"method plugin {point.name} can't be loaded: {err}", stacklevel=2)

    def register(self, name: str, build: Callable[..., BaseMethod]) -> None:
        if name in self._known:
            warnings.warn(f"method {name} is replaced", stacklevel=2)
        self._known[name] = build

    def names(self) -> list[str]:
        return sorted(self._known)

    def get(self, name: str, **options: Any) -> BaseMethod:
        if name not in self._known:
            raise KeyError(f"unknown method {name}; known: {', '.join(self.names())}")
        return self._known[name](**options)
