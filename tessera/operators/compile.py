"""Specs become columns.

Row operations become expressions of one ``select``. Statistics that operations ask for are gathered first: those of the
whole table are one aggregate of one row, those of a key one aggregate by that key joined back, however many features use
them. Spark picks the join by the size that the aggregate turns out to have. Chains work in order: a feature may use
features compiled before it.

Two modes: stateless (statistics are those of the frame at hand) and fitted (``fit`` keeps the statistics of the training
frame as tables; rows of groups that weren't there get nulls).
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ExecutionError
from tessera.functions import OPS
from tessera.functions.registry import Stat
from tessera.functions.unary import number
from tessera.operators.exprsafe import safe_expr
from tessera.operators.ranks import average_ranks, quantiles
from tessera.spec import FeatureSpec


def _aggregate(stat: Stat) -> Column:
    value = F.col(stat.value)
    if stat.fn == "nunique":
        return F.count_distinct(value)
    if stat.fn == "rows":
        return F.count("*")
    if stat.fn in ("count", "values"):
        return F.count(value)
    if stat.fn in ("quantile", "median"):
        share = 0.5 if stat.fn == "median" else float(stat.arg)
        return F.percentile_approx(number(value), share, 10_000)
    return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[stat.fn](number(value))


@dataclass
class State:
    """Statistics of a frame: one row for the whole table, a table for each key."""

    whole: DataFrame | None = None
    keyed: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)
    names: dict[Stat, str] = field(default_factory=dict)


def gather(df: DataFrame, stats: list[Stat], approximate: bool = False) -> State:
    """The statistics of a frame. Quantiles are exact, by ranks of counted values; ``approximate`` ones join the other aggregates of their key."""
    state = State(names={s: f"__s{i}" for i, s in enumerate(dict.fromkeys(stats))})
    by_key: dict[tuple[str, ...], list[Stat]] = defaultdict(list)
    for s in state.names:
        by_key[s.key].append(s)
    for key, own in by_key.items():
        ranked = [s for s in own if s.fn == "rank"]
        exact = [s for s in own if s.fn in ("quantile", "median") and not approximate]
        plain = [s for s in own if s not in ranked and s not in exact]
        keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]
        names = [f"__k{i}" for i in range(len(key))]
        parts = []
        rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in key)) if key else df
        if plain or not key:
            parts.append(rows.groupBy(*keys).agg(*[_aggregate(s).alias(state.names[s]) for s in plain] or [F.count("*").alias("__rows")]))
        for value in dict.fromkeys(s.value for s in exact):
            shares = {state.names[s]: 0.5 if s.fn == "median" else float(s.arg) for s in exact if s.value == value}
            parts.append(quantiles(rows.select(*keys, number(F.col(value)).alias("__value")), "__value", shares, names))
        for s in ranked:  # the value itself is the last column of its key
            by = [f"__k{i}" for i in range(len(key) - 1)]
            ranks = average_ranks(rows.select(*keys[:-1], F.col(s.value).alias("__value")), "__value", by)
            parts.append(ranks.select(*by, F.col("value").alias(names[-1]), F.col("rank").alias(state.names[s])))
        table = parts[0]
        for other in parts[1:]:  # without a key there are one row and at most one row
            table = table.join(other, names, "full") if key else table.join(F.broadcast(other), F.lit(True), "left")
        if key:
            state.keyed[key] = table
        else:
            state.whole = table.drop("__rows")
    return state


def _attach(df: DataFrame, state: State) -> DataFrame:
    if state.whole is not None and state.whole.columns:
        df = df.crossJoin(F.broadcast(state.whole))  # one row
    for n, (key, table) in enumerate(state.keyed.items()):
        own = table.select(*[F.col(f"__k{i}").alias(f"__k{n}_{i}") for i in range(len(key))], *[c for c in table.columns if not c.startswith("__k")])
        on = [F.col(k) == F.col(f"__k{n}_{i}") for i, k in enumerate(key)]  # a null key has no group
        df = df.join(own, on, "left").drop(*[f"__k{n}_{i}" for i in range(len(key))])
    return df


def _wanted(spec: FeatureSpec) -> list[Stat]:
    op = OPS.get(spec.transform)
    return op.stats(*spec.base_columns, **spec.params) if op is not None and op.stats else []


def column_of(spec: FeatureSpec, known: dict[Stat, Column], columns: list[str]) -> Column:
    """The expression of a spec: its operation's, or its checked SQL expression."""
    missing = [c for c in spec.base_columns if c not in columns]
    if missing:
        raise ExecutionError(f"{spec.name}: no column {', '.join(missing)}")
    op = OPS.get(spec.transform)
    if op is None:
        if not spec.logic:
            raise ExecutionError(f"{spec.name}: unknown operation {spec.transform!r} and no expression")
        return safe_expr(spec.logic)
    if op.arity is not None and len(spec.base_columns) != op.arity:
        raise ExecutionError(f"{spec.name}: {op.name} takes {op.arity} columns")
    try:
        if op.stats:
            return op.build(known, *spec.base_columns, **spec.params)
        return op.build(*[F.col(c) for c in spec.base_columns], **spec.params)
    except (TypeError, KeyError, ValueError) as err:
        raise ExecutionError(f"{spec.name}: {err}") from err


@dataclass
class Compiled:
    """A frame with features appended, and what couldn't be compiled."""

    frame: DataFrame
    names: list[str]
    failures: dict[str, str]


def unique(specs: list[FeatureSpec]) -> list[FeatureSpec]:
    """First of each name, and first of specs that compute the same."""
    names, done, out = set(), set(), []
    for s in specs:
        if s.name not in names and s.digest not in done:
            names.add(s.name)
            done.add(s.digest)
            out.append(s)
    return out


class Compiler:
    def __init__(self, approximate: bool = False):
        self.approximate = approximate

    def fit(self, df: DataFrame, specs: list[FeatureSpec]) -> list[State]:
        """Statistics of this frame for each wave of specs, see ``waves``; for ``transform`` of others."""
        states = []
        for wave in self.waves(df, unique(specs)):
            states.append(gather(df, self.wanted(df, wave), self.approximate))
            df = self._apply(df, wave, states[-1]).frame
        return states

    def wanted(self, df: DataFrame, wave: list[FeatureSpec]) -> list[Stat]:
        return [s for spec in wave if all(c in df.columns for c in spec.base_columns) for s in _safe_wanted(spec)]

    def waves(self, df: DataFrame, specs: list[FeatureSpec]) -> list[list[FeatureSpec]]:
        """Specs in groups, each of which needs columns of the frame and of earlier groups alone."""
        have, rest, out = set(df.columns), [s for s in specs if s.name not in df.columns], []
        while rest:
            ready = [s for s in rest if all(c in have for c in s.base_columns)]
            if not ready:
                out.append(rest)  # what is missing stays missing; compiling says so
                break
            out.append(ready)
            have |= {s.name for s in ready}
            rest = [s for s in rest if s not in ready]
        return out

    def _apply(self, df: DataFrame, wave: list[FeatureSpec], state: State) -> Compiled:
        attached, made, failures = _attach(df, state), {}, {}
        known = {s: F.col(name) for s, name in state.names.items()}
        for spec in wave:
            try:
                made[spec.name] = column_of(spec, known, df.columns)
                attached.select(made[spec.name])  # analysis fails here, without a job
            except Exception as err:  # noqa: BLE001  one broken feature must not stop the others
                made.pop(spec.name, None)
                failures[spec.name] = str(err).splitlines()[0]
        return Compiled(attached.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in made.items()]), list(made), failures)

    def transform(self, df: DataFrame, specs: list[FeatureSpec], states: list[State] | None = None) -> Compiled:
        """``df`` with the features of ``specs``, in waves; existing columns win over features of their name.

        Statistics are those of ``states`` that have them, and of ``df`` otherwise.
        """
        names, failures = [], {}
        for wave in self.waves(df, unique(specs)):
            wanted = self.wanted(df, wave)
            fitted = next((s for s in states or [] if all(w in s.names for w in wanted)), None)
            state = fitted if fitted is not None and wanted else gather(df, wanted, self.approximate)
            done = self._apply(df, wave, state)
            df, names, failures = done.frame, names + done.names, failures | done.failures
        return Compiled(df, names, failures)


def _safe_wanted(spec: FeatureSpec) -> list[Stat]:
    try:
        return _wanted(spec)
    except TypeError:
        return []


def derive(df: DataFrame, *specs: FeatureSpec) -> DataFrame:
    """``df`` with features; raises where one can't be compiled."""
    done = Compiler().transform(df, list(specs))
    if done.failures:
        raise ExecutionError("; ".join(f"{k}: {v}" for k, v in done.failures.items()))
    return done.frame
