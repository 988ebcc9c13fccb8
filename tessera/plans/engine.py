"""Rounds: propose, compile, screen, score, select; and what a whole run gives back.

A run keeps expressions, not frames: what a round selects is a list of specs, and the enhanced table is one lazy plan over
the source, however many rounds there were.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tessera.errors import PlanError
from tessera.operators.compile import Compiler, unique
from tessera.operators.profile import describe
from tessera.operators.screen import prefilter
from tessera.plans.evaluate import Evaluator, select_top
from tessera.plans.memory import Memory
from tessera.plans.proposers import Context, ProposerRegistry
from tessera.plans.router import FixedRouter, Router
from tessera.session import held
from tessera.settings import Settings
from tessera.sources.dataset import TableSpec
from tessera.spec import FeatureSpec

log = logging.getLogger("tessera")


@dataclass
class RoundResult:
    index: int
    agents: list[str]
    baseline: float
    specs: list[FeatureSpec] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    gains: list[dict] = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)

    @property
    def agent_gains(self) -> dict[str, list[dict]]:
        owner = {s.name: s.agent_name for s in reversed(self.specs)}
        found: dict[str, list[dict]] = {a: [] for a in self.agents}
        for g in self.gains:
            found.setdefault(owner.get(g["feature"], ""), []).append(g)
        return found

    def summary(self) -> dict[str, Any]:
        return {"round": self.index + 1, "agents": self.agents, "baseline_score": self.baseline, "num_features_generated": len(self.specs), "num_features_selected": len(self.selected)}


@dataclass
class RunResult:
    rounds: list[RoundResult]
    specs: list[FeatureSpec]
    memory: Memory

    @property
    def selected(self) -> list[str]:
        return [s.name for s in self.specs]


MODES = ("full", "no_memory", "no_memory_static_router", "no_router", "single_agent")


@dataclass
class Engine:
    """``mode`` switches parts off: memory, the router, or all agents but ``single_agent``; an unknown mode is the full engine."""

    settings: Settings = field(default_factory=Settings)
    mode: str = "full"
    single_agent: str = "unary"
    proposers: ProposerRegistry = field(default_factory=ProposerRegistry)
    evaluator: Evaluator | None = None
    memory_path: str | None = None
    client: Any = None

    def _evaluator(self) -> Evaluator:
        s = self.settings
        return self.evaluator or Evaluator(task=s.task, metric=s.metric, model=s.model, folds=s.evaluation.cv_folds, seed=s.random_state, workers=s.evaluation.max_cv_workers or Evaluator.workers)

    def _router(self) -> Router | FixedRouter:
        names = tuple(self.proposers.names())
        if self.mode == "single_agent":
            return FixedRouter((self.single_agent,))
        if self.mode in ("no_router", "no_memory_static_router"):
            return FixedRouter(names)
        return Router(self.settings.router, names, self.client)

    def propose(self, agents: list[str], context: Context, memory: Memory | None) -> tuple[list[FeatureSpec], dict[str, str]]:
        specs, failures = [], {}
        for a in agents:
            own = Context(**{**context.__dict__, "positive": memory.positive(a), "negative": memory.negative(a), "memory": memory.prompt(a)}) if memory else context
            try:
                specs += self.proposers.get(a).propose(own)
            except Exception as err:  # noqa: BLE001  one agent must not stop the others
                if self.settings.evaluation.fail_on_agent_error:
                    raise
                failures[a] = str(err)
        return specs, failures

    def round(self, df: DataFrame, table: TableSpec, index: int, agents: list[str], description: dict, memory: Memory | None, evaluator: Evaluator) -> RoundResult:
        specs, failures = self.propose(agents, Context(description, self.settings.task, index), memory)
        if not specs:
            return RoundResult(index, agents, 0.0, failures=failures)
        done = Compiler().transform(df, specs)
        failures |= done.failures
        if not done.names:
            if done.failures:
                raise PlanError("no feature could be computed: " + "; ".join(f"{k}: {v}" for k, v in done.failures.items()))
            return RoundResult(index, agents, 0.0, specs, failures=failures)
        columns = table.features(df)
        candidates = prefilter(done.frame, done.names, self.settings.evaluation.max_candidate_features)
        base, gains = evaluator.gains(done.frame, table, columns, candidates, self.settings.evaluation.fail_on_feature_error)
        return RoundResult(index, agents, base, unique(specs), select_top(gains, self.settings.max_selected_per_round), gains, failures)

    def run(self, df: DataFrame, table: TableSpec) -> RunResult:
        with held(df):
            return self._run(df, table)

    def _run(self, df: DataFrame, table: TableSpec) -> RunResult:
        remember = self.mode not in ("no_memory", "no_memory_static_router")
        memory = Memory.load(self.memory_path) if self.memory_path and remember else Memory()
        router, evaluator = self._router(), self._evaluator()
        description = describe(df, table.features(df))
        chosen: list[FeatureSpec] = []
        rounds: list[RoundResult] = []
        for i in range(self.settings.n_rounds):
            enhanced = Compiler().transform(df, chosen).frame
            agents = router.select(i, description)
            done = self.round(enhanced, table, i, agents, description, memory if remember else None, evaluator)
            rounds.append(done)
            by_name = {s.name: s for s in done.specs}
            needed = [by_name[n] for n in done.selected]
            for s in list(needed):  # what a selected feature is built on comes with it
                needed = [by_name[b] for b in s.base_columns if b in by_name and by_name[b] not in needed] + needed
            chosen = unique([*chosen, *needed])
            for agent, gains in done.agent_gains.items():
                good = [g["gain"] for g in gains if g["gain"] is not None]
                router.update(agent, sum(good) / len(good) if good else None)
                for g in gains:
                    if remember and g["feature"] in by_name:
                        memory.record(by_name[g["feature"]], g["gain"], self.settings.metric, agent)
                if remember and gains:
                    memory.summarise(agent)
            if remember:
                memory.summarise_round(f"round {i + 1}: {len(done.selected)} of {len(done.specs)} features kept")
                if self.memory_path:
                    memory.save(self.memory_path)
            log.info("round %s", done.summary())
        return RunResult(rounds, chosen, memory)
