"""Settings: constructor before environment (``TESSERA_*``, nested by ``__``) before a mapping read from a file."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from tessera.errors import ConfigurationError

# Names, default values and limits below are fixed values: users rely on them.
METRICS = ("auc", "acc", "f1", "rmse", "mae", "r2", "nrmse")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigurationError(what)


@dataclass(frozen=True)
class EvaluationSettings:
    cv_folds: int = 5
    test_size: float = 0.4
    timeout_s: float = 5.0
    memory_mb: int = 512
    max_candidate_features: int = 50
    max_cv_workers: int | None = None
    fail_on_agent_error: bool = False
    fail_on_feature_error: bool = False

    def __post_init__(self):
        _need(self.cv_folds >= 2, "cv_folds must be at least 2")
        _need(0 < self.test_size < 1, "test_size must be in (0, 1)")
        _need(self.timeout_s > 0, "timeout_s must be positive")
        _need(self.memory_mb >= 128, "memory_mb must be at least 128")
        _need(self.max_candidate_features >= 1, "max_candidate_features must be at least 1")


@dataclass(frozen=True)
class RouterSettings:
    strategy: str = "hybrid"
    max_agents: int | None = None
    min_agents: int = 1
    warmup_rounds: int = 1

    def __post_init__(self):
        _need(self.strategy in ("data_driven", "performance_driven", "hybrid", "llm"), "unknown router strategy")
        _need(self.min_agents >= 1, "min_agents must be at least 1")
        _need(self.max_agents is None or self.max_agents >= self.min_agents, "max_agents must not be below min_agents")
        _need(self.warmup_rounds >= 0, "warmup_rounds must not be negative")


@dataclass(frozen=True)
class RetrySettings:
    max_retries: int = 3
    base_delay_s: float = 1.0
    max_delay_s: float = 30.0
    exponent: float = 2.0


@dataclass(frozen=True)
class ClientSettings:
    provider: str = "scripted"
    model: str = "rules"
    temperature: float = 0.2
    max_tokens: int = 2048
    max_concurrent_calls: int = 3
    retry: RetrySettings = field(default_factory=RetrySettings)

    def __post_init__(self):
        _need(0 <= self.temperature <= 2, "temperature must be in [0, 2]")


@dataclass(frozen=True)
class Settings:
    task: str = "classification"
    metric: str = "auc"
    model: str = "random_forest"
    n_rounds: int = 4
    max_selected_per_round: int = 2
    random_state: int = 42
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)
    router: RouterSettings = field(default_factory=RouterSettings)
    client: ClientSettings = field(default_factory=ClientSettings)

    def __post_init__(self):
        _need(self.task in ("classification", "regression"), "task must be classification or regression")
        _need(self.metric in METRICS, f"metric must be one of {', '.join(METRICS)}")
        _need(self.n_rounds >= 1, "n_rounds must be at least 1")
        _need(self.max_selected_per_round >= 1, "max_selected_per_round must be at least 1")


def _typed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def _merge(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    unknown = set(values) - set(known)
    _need(not unknown, f"unknown settings: {', '.join(sorted(unknown))}")
    base = kind()
    return replace(base, **{k: _merge(type(getattr(base, k)), v) if is_dataclass(getattr(base, k)) and isinstance(v, dict) else v for k, v in values.items()})


def _nested(into: dict[str, Any], path: list[str], value: Any) -> None:
    for key in path[:-1]:
        into = into.setdefault(key, {})
    into[path[-1]] = value


def _update(into: dict[str, Any], other: dict[str, Any]) -> dict[str, Any]:
    for k, v in other.items():
        into[k] = _update(dict(into.get(k) or {}), v) if isinstance(v, dict) else v
    return into


def load_settings(path: str | None = None, environ: dict[str, str] | None = None, **overrides: Any) -> Settings:
    """Settings from a JSON file, then the environment, then ``overrides`` (nested mappings)."""
    values: dict[str, Any] = {}
    if path:
        with open(path, encoding="utf-8") as source:
            values = json.load(source)
    for key, text in sorted((os.environ if environ is None else environ).items()):
        if key.startswith("TESSERA_"):
            _nested(values, key[len("TESSERA_") :].lower().split("__"), _typed(text))
    return _merge(Settings, _update(values, overrides))
