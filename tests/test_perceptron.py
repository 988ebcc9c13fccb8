"""The perceptron for regression: gradients, held-out rows, and weights under any partitioning."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera.errors import EvaluationError
from tessera.operators.perceptron import Perceptron, slopes
from tessera.plans.evaluate import Evaluator
from tessera.plans.models import ModelRegistry
from tessera.sources.dataset import TableSpec


def points(seed, n=600):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    return x, np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.05, n)


def frame(spark, x, y, parts=3):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double").repartition(parts)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(df)


def test_slopes_equal_differences():
    rng = np.random.default_rng(0)
    layers = [2, 4, 3, 1]
    theta, x, y, n = rng.normal(size=31), rng.normal(size=(9, 2)), rng.normal(size=9), rng.integers(1, 4, 9).astype(float)
    held = np.arange(9) % 4 == 0
    given = slopes(theta, layers, x, y, n, held)
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-6
        low, high = (slopes(theta + d, layers, x, y, n, held)[-2] for d in (-step, step))
        assert abs((high - low) / 2e-6 - given[k]) < 1e-5


def test_it_beats_the_line_and_stops_by_rows_held_out(spark):
    data = frame(spark, *points(1))
    model = ModelRegistry().get("mlp", "regression", width=2, maxIter=40, layers=(16, 8)).fit(data)
    error = lambda m: m.transform(data).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert error(model) < 0.2 * error(LinearRegression().fit(data))
    stopped = Perceptron(hidden=(16, 8), steps=40, patience=1, tolerance=0.5).fit(data)
    assert len(stopped.losses) < 40 and min(h for _, h in stopped.losses) < stopped.losses[0][1]


def test_weights_do_not_depend_on_partitioning(spark):
    x, y = points(2, 300)
    x, y = np.concatenate((x, x[:1].repeat(200, 0))), np.concatenate((y, y[:1].repeat(200)))  # and a hot row
    made = [Perceptron(hidden=(8,), steps=5).fit(frame(spark, *at)) for at in ((x, y, 1), (x[::-1], y[::-1], 7))]
    assert np.array_equal(made[0].theta, made[1].theta) and made[0].losses == made[1].losses


@pytest.mark.parametrize("rows", [1, 5])
def test_odd_inputs(spark, rows):
    data = frame(spark, np.full((rows, 2), np.nan), np.full(rows, 3.0))
    model = Perceptron(hidden=(4,), steps=30).fit(data)
    assert abs(model.predict(np.array([[np.nan, np.nan]]))[0] - 3.0) < 0.5
    with pytest.raises(EvaluationError):
        Perceptron().fit(data.limit(0))


def test_the_evaluator_takes_it(spark):
    df = frame(spark, *points(3, 200)).select("id", "a", "b", "label")
    score = Evaluator(task="regression", metric="r2", model="mlp", folds=2, model_params={"maxIter": 25, "layers": (8,)}).score(df, TableSpec("id", "label"), ["a", "b"])
    assert score > 0.5
