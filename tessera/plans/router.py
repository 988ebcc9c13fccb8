"""Which proposers work in a round."""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field
from typing import Any

from tessera.plans.client import Client
from tessera.plans.proposers import AGENTS
from tessera.settings import RouterSettings

HISTORY = 10


@dataclass
class Router:
    settings: RouterSettings = field(default_factory=RouterSettings)
    agents: tuple[str, ...] = AGENTS
    client: Client | None = None
    history: dict[str, deque] = field(default_factory=dict)
    _types: dict[str, int] | None = None

    @property
    def _most(self) -> int:
        return self.settings.max_agents or len(self.agents)

    def update(self, agent: str, gain: float | None) -> None:
        if gain is not None:
            self.history.setdefault(agent, deque(maxlen=HISTORY)).append(gain)

    def mean(self, agent: str) -> float | None:
        own = self.history.get(agent)
        return sum(own) / len(own) if own else None

    def characteristics(self, description: dict[str, dict[str, Any]]) -> dict[str, int]:
        """How many columns of each kind; found once."""
        if self._types is None:
            kinds = Counter(d.get("type") for d in description.values())
            self._types = {k: kinds[k] for k in ("numerical", "categorical", "datetime")} | {"columns": len(description)}
        return self._types

    def _bounded(self, chosen: list[str]) -> list[str]:
        """Padded in the agents' order to the least number, cut to the largest."""
        padded = chosen + [a for a in self.agents if a not in chosen][: max(0, self.settings.min_agents - len(chosen))]
        return padded[: self._most]

    def data_driven(self, description: dict[str, dict[str, Any]], enriched: bool = False) -> list[str]:
        has = self.characteristics(description)
        fits = {"temporal": has["datetime"] > 0, "cross_compositional": has["columns"] > 2, "local_transform": has["numerical"] > 0, "aggregation": has["categorical"] > 0, "local_pattern": enriched}
        return self._bounded([a for a in self.agents if fits.get(a, True)])

    def performance_driven(self) -> list[str]:
        if not self.history:
            return list(self.agents[: self._most])
        ranked = sorted(self.agents, key=lambda a: -(self.mean(a) if self.mean(a) is not None else float("-inf")))
        chosen: list[str] = []
        for a in ranked:
            good = self.mean(a) is not None and self.mean(a) >= 0
            if len(chosen) < self._most and (good or len(chosen) < self.settings.min_agents):
                chosen.append(a)
        return chosen

    def hybrid(self, description: dict[str, dict[str, Any]], enriched: bool = False) -> list[str]:
        """Agents that both ways choose, then those of the data, then those of the gains; in the agents' order each."""
        data, gains = self.data_driven(description, enriched), self.performance_driven()
        groups = ([a for a in self.agents if a in data and a in gains], [a for a in self.agents if a in data and a not in gains], [a for a in self.agents if a in gains and a not in data])
        return self._bounded([a for g in groups for a in g])

    def asked(self, description: dict[str, dict[str, Any]], enriched: bool = False) -> list[str]:
        if self.client is None:
            return self.hybrid(description, enriched)
        try:
            answer = self.client.complete([{"role": "user", "content": f"Which of {', '.join(self.agents)} suit columns {description}? Name them."}])
        except Exception:  # noqa: BLE001  the rules stand in for a client that fails
            return self.hybrid(description, enriched)
        named = [a for a in self.agents if a in answer]
        return self._bounded(named) if named else self.hybrid(description, enriched)

    def select(self, round_index: int, description: dict[str, dict[str, Any]], enriched: bool = False) -> list[str]:
        if round_index < self.settings.warmup_rounds:
            return list(self.agents)
        way = self.settings.strategy
        if way == "data_driven":
            return self.data_driven(description, enriched)
        if way == "performance_driven":
            return self.performance_driven()
        return self.asked(description, enriched) if way == "llm" else self.hybrid(description, enriched)

    def summary(self) -> dict[str, Any]:
        return {a: {"calls": len(self.history.get(a, ())), "mean_gain": self.mean(a)} for a in self.agents}


@dataclass
class FixedRouter:
    """The same agents in every round."""

    agents: tuple[str, ...] = AGENTS

    def select(self, round_index: int, description: dict, enriched: bool = False) -> list[str]:
        return list(self.agents)

    def update(self, agent: str, gain: float | None) -> None:
        return None
