"""Prompts by name, with parameters that are checked before they are filled in."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from string import Template

from tessera.errors import ConfigurationError


@dataclass(frozen=True)
class Prompt:
    name: str
    system: str
    user: str = "$task"

    def __post_init__(self):
        if not self.system.strip():
            raise ConfigurationError(f"prompt {self.name} has no system text")

    def render(self, **params: object) -> list[dict[str, str]]:
        try:
            return [{"role": "system", "content": Template(self.system).substitute(params)}, {"role": "user", "content": Template(self.user).substitute(params)}]
        except KeyError as err:
            raise ConfigurationError(f"prompt {self.name} needs {err}") from err


@dataclass(frozen=True)
class IterationParams:
    """Which iteration of how many, for prompts of iterative methods."""

    iteration: int
    iterations: int
    feedback: str = ""

    def __post_init__(self):
        if not 1 <= self.iteration <= self.iterations:
            raise ConfigurationError("iteration must be between 1 and the number of iterations")


class PromptRegistry:
    """Prompts of a folder of JSON files (``system`` and ``user``), read once each, and those registered by hand."""

    def __init__(self, folder: str | None = None):
        self.folder, self._known = folder, {}

    def register(self, prompt: Prompt) -> None:
        self._known[prompt.name] = prompt

    def get(self, name: str) -> Prompt:
        if name not in self._known:
            path = os.path.join(self.folder, f"{name}.json") if self.folder else ""
            if not os.path.isfile(path):
                raise KeyError(name)
            with open(path, encoding="utf-8") as source:
                data = json.load(source)
            self._known[name] = Prompt(name, data.get("system", ""), data.get("user", "$task"))
        return self._known[name]
