"""Boosting against a booster of one matrix in memory, and the same trees whatever the partitioning."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators.boosting import Booster, binned, gradients
from tessera.plans.models import ModelRegistry


def points(seed, n=900, classes=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[rng.random(n) < 0.05, 1] = np.nan
    wave = np.sin(2 * x[:, 0]) + np.where(np.isnan(x[:, 1]), 0.5, x[:, 1] > 0.3) * x[:, 2]
    if classes:
        return x, np.digitize(wave, np.quantile(wave, np.linspace(0, 1, classes + 1)[1:-1])).astype(float)
    return x, 100 + 20 * wave


def frame(spark, x, y, parts=3):
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, label double").repartition(parts).select(array_to_vector("x").alias("features"), "label")


def brute(x, y, cuts, rounds, rate, depth, l2, kind, middle=0.0, half=1.0):
    """Scores after each round of depth-wise trees, in floats, with every histogram counted anew."""
    bins, y = binned(x, cuts), (y - middle) / half
    scores, after = np.zeros((len(y), 1)), []
    for _ in range(rounds):
        g, h = (v[:, 0] / 2**30 for v in gradients(kind, scores, y))

        def grow(rows, level):
            best = (1e-9, None)
            for j in range(bins.shape[1]):
                for cut in range(255):
                    left = bins[rows, j] <= cut
                    a, b = rows[left], rows[~left]
                    if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= 1:
                        gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + l2) for r, s in ((a, 1), (b, 1), (rows, -1)))
                        if gain > best[0] + 1e-12:
                            best = (gain, (a, b))
            if level == depth or best[1] is None:
                scores[rows, 0] += -rate * g[rows].sum() / (h[rows].sum() + l2)
            else:
                for part in best[1]:
                    grow(part, level + 1)

        grow(np.arange(len(y)), 0)
        after.append(scores.copy())
    return after


@pytest.mark.parametrize("kind", ["regression", "binary"])
def test_losses_fall_as_those_of_one_matrix(spark, kind):
    x, y = points(1, 240, 2 if kind == "binary" else 0)
    model = Booster(kind=kind, rounds=3, rate=0.5, depth=2).fit(frame(spark, x, y))
    want = brute(x, y, model.cuts, 3, 0.5, 2, 1.0, kind, model.middle, model.half)
    for r in range(3):
        part = type(model)(model.kind, 1, model.cuts, model.middle, model.half, model.trees[: r + 1])
        assert np.abs(part.scores(x) - want[r]).max() < 1e-6


@pytest.mark.parametrize("name", ["xgboost", "lightgbm", "catboost"])
def test_trees_do_not_depend_on_partitioning(spark, name):
    x, y = points(2, 900, 3)
    build = lambda: ModelRegistry().get(name, "classification", classes=3, width=3, maxIter=3, stepSize=0.3)
    one, other = build().fit(frame(spark, x, y, 1)), build().fit(frame(spark, x[::-1], y[::-1], 7))
    assert one.trees == other.trees and len(one.trees) == 3 and len(one.trees[0]) == 3
    leaves = max(sum(f < 0 for f in t.feature) for r in one.trees for t in r)
    assert 4 <= leaves <= (31 if name == "lightgbm" else 64)
    if name == "catboost":
        levels = {(t.feature[0], t.bin[0]) for r in one.trees for t in r}
        assert levels and all(len({(t.feature[n], t.bin[n]) for n in (t.left[0], t.right[0]) if t.feature[n] >= 0}) <= 1 for r in one.trees for t in r)


def test_predictions_and_scores_beside_blocks(spark, monkeypatch):
    from tessera.operators import boosting

    x, y = points(3, 600, 3)
    data = frame(spark, x, y)
    plain = Booster(kind="softmax", outputs=3, rounds=5, rate=0.4, depth=3).fit(data)
    monkeypatch.setattr(boosting, "RENEWED", 2)
    assert Booster(kind="softmax", outputs=3, rounds=5, rate=0.4, depth=3).fit(data).trees == plain.trees
    out = plain.transform(data).withColumn("right", (F.col("prediction") == F.col("label")).cast("int"))
    assert out.agg(F.avg("right")).first()[0] > 0.85
    x, y = points(4)
    data = frame(spark, x, y)
    fitted = Booster(kind="regression", rounds=20, rate=0.3, depth=4).fit(data).transform(data)
    error, spread = fitted.agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)), F.var_pop("label")).first()
    assert error < 0.15 * spread


def test_odd_inputs(spark):
    flat = Booster(kind="regression", rounds=2).fit(frame(spark, np.ones((5, 2)), np.full(5, 3.0)))
    assert flat.trees == [] and flat.predict(np.ones((1, 2))).tolist() == [[3.0]]
    empty = frame(spark, np.ones((2, 2)), np.ones(2)).limit(0)
    assert Booster(rounds=2).fit(empty).trees == []
