"""Feature specifications: what is proposed, compiled and scored."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

from tessera.errors import ProposalError

SPEC_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("transform", T.StringType()),
        T.StructField("logic", T.StringType()),
        T.StructField("base_columns", T.ArrayType(T.StringType())),
        T.StructField("agent_name", T.StringType()),
    ]
)


@dataclass(frozen=True)
class FeatureSpec:
    """One derived column: an operation by name with parameters, or a SQL expression in ``logic``."""

    name: str
    type: str = "numerical"
    transform: str = ""
    logic: str = ""
    base_columns: tuple[str, ...] = ()
    agent_name: str = ""
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.name:
            raise ProposalError("a feature needs a name")
        if self.type not in ("numerical", "categorical"):
            raise ProposalError(f"{self.name}: type must be numerical or categorical")
        object.__setattr__(self, "base_columns", (self.base_columns,) if isinstance(self.base_columns, str) else tuple(self.base_columns))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> FeatureSpec:
        known = {k: data[k] for k in cls.__dataclass_fields__ if k in data and data[k] is not None}
        return cls(**known)

    @classmethod
    def from_json(cls, text: str) -> FeatureSpec:
        return cls.from_dict(json.loads(text))

    @property
    def digest(self) -> str:
        """Of what is computed, whatever it is called."""
        return hashlib.sha256(json.dumps([self.transform, self.logic, self.base_columns, self.params], sort_keys=True).encode()).hexdigest()


def strip_fences(text: str) -> str:
    found = re.search(r"```[A-Za-z]*\n(.*?)```", text, re.S)
    return found.group(1) if found else text


def parse_specs(answer: Any, agent_name: str = "") -> list[FeatureSpec]:
    """Specs of a proposer's answer: a mapping with ``features``, a list, or text that holds either.

    An entry names its ``base_columns`` (one or a list) and its ``derived_features``; a flat entry is one feature. Entries
    that aren't mappings are skipped.
    """
    if isinstance(answer, str):
        text = strip_fences(answer).strip()
        try:
            answer = json.loads(text)
        except ValueError:
            found = re.search(r"\[.*\]", text, re.S)
            if not found:
                raise ProposalError("no JSON in the answer") from None
            try:
                answer = json.loads(found.group(0))
            except ValueError as err:
                raise ProposalError(f"broken JSON in the answer: {err}") from err
    if isinstance(answer, dict):
        answer = answer.get("features", [])
    if not isinstance(answer, list):
        raise ProposalError("the answer holds no list of features")
    specs = []
    for entry in answer:
        if not isinstance(entry, dict):
            continue
        base = entry.get("base_columns", [])
        derived: Iterable[Any] = entry.get("derived_features", [entry])
        for one in derived:
            if isinstance(one, dict):
                fields = {"name": one.get("name") or "unknown", "type": one.get("type") if one.get("type") in ("numerical", "categorical") else "numerical"}
                fields |= {k: str(one.get(k) or "") for k in ("transform", "logic")}
                specs.append(FeatureSpec(**fields, base_columns=tuple([base] if isinstance(base, str) else base), agent_name=agent_name, params=one.get("params") or {}))
    return specs
