"""The vocabulary of feature operations, by name."""

from tessera.functions import cross, group, local, temporal, unary
from tessera.functions.registry import OPS, Op, op

__all__ = ["OPS", "Op", "cross", "group", "local", "op", "temporal", "unary"]
