"""Relevance by a contingency aggregate, and breaks of curves, against brute force; methods that keep fitted statistics."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.relevance import relevance
from tessera.operators.segments import best_breaks, costs, segments
from tessera.operators.selection import quantiles_of
from tessera.plans.methods import ExpansionMethod
from tessera.sources.dataset import TableSpec


def test_quantiles_of_many_shares(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=500), 2)
    df = spark.createDataFrame([(float(v), None) for v in x], "x double, y double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = quantiles_of(df, {"x": F.col("x"), "y": F.col("y")}, shares)
    assert np.allclose([q for (q,) in got["x"]], np.quantile(x, shares)) and got["y"] == [[None]] * 6


def test_relevance_of_classes_and_odd_columns(spark):
    rows = [(i % 3, float(i % 3), 1.0, None if i % 2 else float(i), float(i * 7919 % 101), "t") for i in range(300)] + [(None, 9.0, 1.0, 1.0, 1.0, "t")]
    df = spark.createDataFrame(rows, "y int, same double, one double, half double, noise double, text string").repartition(5)
    got = {r.feature: r for r in relevance(df, "y", ["same", "one", "half", "noise", "text"], 3).collect()}
    assert abs(got["same"].information - math.log(3)) < 1e-9 and got["one"].information == 0.0 and got["same"].ratio is None
    assert got["noise"].information < 0.2 and "text" not in got
    number = {r.feature: r.ratio for r in relevance(df, "y", ["same", "one", "noise"]).collect()}
    assert abs(number["same"] - 1) < 1e-9 and number["one"] < 1e-9 and number["noise"] < 0.2
    assert [r.information for r in relevance(df.limit(0), "y", ["same"], 3).collect()] == [0.0]


@pytest.mark.parametrize("degree", [0, 1])
def test_breaks_equal_brute_force(degree):
    rng = np.random.default_rng(degree)
    for _ in range(20):
        y = rng.integers(0, 9, rng.integers(1, 13)).astype(float)
        for parts in (1, 2, 3, 4):
            first, error = best_breaks(y, parts, degree)
            fitted = lambda a, b: float(np.sum((y[a:b] - np.polyval(np.polyfit(np.arange(b - a), y[a:b], min(degree, b - a - 1)), np.arange(b - a))) ** 2))
            ways = [(0, *w) for w in itertools.combinations(range(1, len(y)), len(first) - 1)]
            every = [sum(fitted(a, b) for a, b in zip(w, [*w[1:], len(y)], strict=True)) for w in ways if all(b - a > degree for a, b in zip(w, [*w[1:], len(y)], strict=True))]
            assert abs(error - min(every, default=0.0)) < 1e-6 and abs(sum(costs(y, degree)[a, b] for a, b in zip(first, [*first[1:], len(y)], strict=True)) - error) < 1e-9 or len(y) <= degree


def test_segments_of_keys(spark):
    rows = [("hill", float(i)) for i in range(10) for _ in range(1 + min(i, 9 - i) * 5)] + [("flat", 1.0)] * 3 + [(None, float(i)) for i in range(4)] + [("none", None)]
    got = segments(spark.createDataFrame(rows, "k string, x double"), "x", ["k"], bins=10, parts=2).collect()
    hill = sorted((r.segment, r.first_bin, r.turns) for r in got if r.k == "hill")
    assert hill == [(0, 0, 0), (1, 5, 1)] and [(r.n, r.slope) for r in got if r.k == "flat"] == [(3, 0.0)]
    assert sum(r.n for r in got if r.k is None) == 4 and not [r for r in got if r.k == "none"]
    assert segments(spark.createDataFrame(rows, "k string, x double"), "x", parts=1).count() == 1


@pytest.mark.parametrize("task", ["regression", "classes"])
def test_expansion_of_any_target_keeps_its_training_statistics(spark, task):
    rng = np.random.default_rng(5)
    x, k = rng.uniform(1, 9, 240), rng.integers(0, 4, 240)
    y = np.log(x) * 10 if task == "regression" else np.digitize(x, [3, 6])
    df = spark.createDataFrame([(i, float(a), float(b), f"g{c}", float(v)) for i, (a, b, c, v) in enumerate(zip(x, rng.normal(size=240), k, y, strict=True))], "id int, x double, noise double, g string, y double")
    kind = "regression" if task == "regression" else "classification"
    method = ExpansionMethod(task=kind, n_features=3, screen_to=30).fit(df, TableSpec("id", "y"))
    assert any("x" in s.base_columns for s in method.specs[-3:])
    method._found(df, [s for s in method.candidates(df, TableSpec("id", "y")) if s.name in ("group_mean_g_x", "frequency_g")])
    one = method.transform(df.filter("id = 7")).first()
    assert one.asDict() == method.transform(df).filter("id = 7").first().asDict() and one["group_mean_g_x"] != one["x"]
