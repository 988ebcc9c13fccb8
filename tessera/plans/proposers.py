"""Proposers: rules for each family of operations, and one that asks a model client."""

from __future__ import annotations

import importlib.metadata
import warnings
from dataclasses import dataclass, field
from itertools import permutations
from typing import Any, Protocol

from tessera.functions.cross import pairs
from tessera.plans.client import Client
from tessera.spec import FeatureSpec, parse_specs

AGENTS = ("unary", "cross_compositional", "aggregation", "temporal", "local_transform", "local_pattern")


@dataclass
class Context:
    """What a proposer may know: the column descriptions, the task, earlier successes and failures."""

    description: dict[str, dict[str, Any]] = field(default_factory=dict)
    task: str = "classification"
    round_index: int = 0
    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    memory: str = ""

    def of_type(self, kind: str) -> list[str]:
        return [c for c, d in self.description.items() if d.get("type") == kind]


class Proposer(Protocol):
    name: str

    def propose(self, context: Context) -> list[FeatureSpec]: ...


@dataclass
class RuleProposer:
    """Specs of one family over the columns of fitting types; ``most`` at most, further ones in later rounds."""

    name: str
    most: int = 8

    def propose(self, context: Context) -> list[FeatureSpec]:
        every = [s for s in getattr(self, f"_{self.name}")(context) if s.name not in context.negative and s.name not in context.positive]
        start = context.round_index * self.most
        chosen = every[start : start + self.most] or every[: self.most]
        return chosen

    def _make(self, op: str, *columns: str, kind: str = "numerical", **params: Any) -> FeatureSpec:
        tail = "_".join(str(v).replace(".", "p").replace("-", "m") for v in params.values())
        return FeatureSpec(name="_".join([op, *columns, *([tail] if tail else [])]), type=kind, transform=op, base_columns=columns, agent_name=self.name, params=params)

    def _unary(self, c: Context) -> list[FeatureSpec]:
        return [self._make(op, x) for op in ("log1p_clipped", "square", "sqrt_clipped", "signed_log", "absolute", "sigmoid") for x in c.of_type("numerical")]

    def _cross_compositional(self, c: Context) -> list[FeatureSpec]:
        found = pairs(c.of_type("numerical"))
        out = [self._make(op, a, b) for a, b in found for op in ("safe_ratio", "multiply", "subtract", "add")]
        return out + [self._make("combined", a, b, kind="categorical") for a, b in pairs(c.of_type("categorical"))]

    def _aggregation(self, c: Context) -> list[FeatureSpec]:
        out = [self._make("frequency", k) for k in c.of_type("categorical")]
        return out + [self._make(op, k, x) for k in c.of_type("categorical") for x in c.of_type("numerical") for op in ("group_mean", "group_std", "group_deviation", "group_ratio")]

    def _temporal(self, c: Context) -> list[FeatureSpec]:
        out = [self._make("date_part", t, part=p) for t in c.of_type("datetime") for p in ("month", "weekday", "quarter", "year")]
        return out + [self._make("is_weekend", t) for t in c.of_type("datetime")] + [self._make("days_since", t) for t in c.of_type("datetime")]

    def _local_transform(self, c: Context) -> list[FeatureSpec]:
        return [self._make(op, x) for x in c.of_type("numerical") for op in ("zscore", "percent_rank_average", "quantile_bin")]

    def _local_pattern(self, c: Context) -> list[FeatureSpec]:
        out = [self._make(op, x) for x in c.of_type("numerical") for op in ("iqr_outlier", "zscore_outlier")]
        return out + [self._make("rare_value", k) for k in c.of_type("categorical")]


@dataclass
class ClientProposer:
    """Asks a model client for specs of its family."""

    name: str
    client: Client

    def prompt(self, context: Context) -> list[dict[str, str]]:
        columns = "\n".join(f"- {c}: {d}" for c, d in context.description.items())
        say = f"Propose {self.name} features for a {context.task} table. Columns:\n{columns}\n{context.memory}\nAnswer with a JSON list of objects with base_columns and derived_features (name, type, transform, logic)."
        return [{"role": "system", "content": "You design features."}, {"role": "user", "content": say}]

    def propose(self, context: Context) -> list[FeatureSpec]:
        return parse_specs(self.client.complete(self.prompt(context)), self.name)


class ProposerRegistry:
    def __init__(self, entry_points: str | None = "tessera.proposers"):
        self._known: dict[str, Proposer] = {n: RuleProposer(n) for n in AGENTS}
        if entry_points:
            for point in importlib.metadata.entry_points(group=entry_points):
                try:
                    self.register(point.load()())
                except Exception as err:  # noqa: BLE001  a broken plugin must not stop the others
                    warnings.warn(f"proposer plugin {point.name} can't be loaded: {err}", stacklevel=2)

    def register(self, proposer: Proposer) -> None:
        if proposer.name in self._known:
            warnings.warn(f"proposer {proposer.name} is replaced", stacklevel=2)
        self._known[proposer.name] = proposer

    def get(self, name: str) -> Proposer:
        return self._known[name]

    def names(self) -> list[str]:
        return list(self._known)


def interaction_specs(names: list[str], most: int | None = None) -> list[FeatureSpec]:
    """All pairwise products."""
    return [FeatureSpec(name=f"{a}_x_{b}", transform="multiply", base_columns=(a, b), agent_name="interactions") for a, b in pairs(names, most)]


EXPAND_UNARY = ("frequency", "absolute", "safe_log", "sqrt_clipped", "square", "sigmoid", "rounded", "residual")
EXPAND_PAIRS = ("smaller", "larger", "add", "subtract", "multiply", "safe_ratio")
EXPAND_GROUPS = ("group_min", "group_max", "group_mean", "group_median", "group_std", "group_rank")


def expansion(numbers: list[str], categories: list[str]) -> list[FeatureSpec]:
    """First-order expansion: 23 operations over all fitting columns."""
    make = lambda op, *cols, kind="numerical": FeatureSpec(name="_".join([op, *cols]), type=kind, transform=op, base_columns=cols, agent_name="expansion")
    out = [make("frequency", c) for c in categories] + [make(op, c) for c in numbers for op in EXPAND_UNARY]
    ordered = {"subtract", "safe_ratio"}
    out += [make(op, a, b) for op in EXPAND_PAIRS for a, b in (permutations(numbers, 2) if op in ordered else pairs(numbers))]
    out += [make(op, k, x) for op in EXPAND_GROUPS for k in categories for x in numbers]
    for a, b in pairs(categories):
        both = make("combined", a, b, kind="categorical")
        out += [both, FeatureSpec(name=f"combined_frequency_{a}_{b}", transform="frequency", base_columns=(both.name,), agent_name="expansion")]
    return out + [make("group_nunique", a, b) for a, b in permutations(categories, 2)]
