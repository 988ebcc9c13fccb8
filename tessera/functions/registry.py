"""Operations are declared once: a name, a family, how many columns they take, and how they become a ``Column``.

A ``row`` operation needs its row alone. A ``window`` operation needs rows of the same key and says so by a window. A
``state`` operation needs statistics, of the whole table or of groups; it names them, and the compiler computes all
statistics of one kind in one aggregate (see ``tessera.operators.compile``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column


@dataclass(frozen=True)
class Stat:
    """A statistic: ``fn`` of ``value`` within ``key`` (of the whole table, without one). ``arg`` parametrises ``fn``."""

    fn: str
    value: str
    key: tuple[str, ...] = ()
    arg: Any = None


@dataclass(frozen=True)
class Op:
    name: str
    family: str
    arity: int | None
    build: Callable[..., Column]
    stats: Callable[..., list[Stat]] | None = None


OPS: dict[str, Op] = {}


def op(family: str, arity: int | None, stats: Callable[..., list[Stat]] | None = None, name: str | None = None):
    """Declares an operation. ``build(*columns, **params)``; with ``stats``, ``build(found, *names, **params)``."""

    def declare(build):
        key = name or build.__name__
        OPS[key] = Op(key, family, arity, build, stats)
        return build

    return declare
