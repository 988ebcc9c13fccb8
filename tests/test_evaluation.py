"""Profiles, screens, folds, metrics and scores."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.errors import EvaluationError
from tessera.operators import folds, metrics, profile, ranks, screen
from tessera.operators.univariate import top_features, univariate_gains
from tessera.plans.evaluate import Evaluator, select_top
from tessera.plans.models import ModelRegistry
from tessera.sources.dataset import TableSpec


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip([float(v) for v in y], [float(v) for v in p], strict=True)), "y double, p double")


def test_metric_vectors(spark):
    m = metrics.MetricRegistry()
    assert m.get("auc").value(pairs(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), "y", "p") == 1.0
    assert m.get("acc").value(pairs(spark, [0, 1, 1, 0], [0, 1, 0, 0]), "y", "p") == 0.75
    assert math.isclose(m.get("mae").value(pairs(spark, [1, 2, 3], [1, 2, 4]), "y", "p"), 1 / 3)
    assert math.isclose(m.get("nrmse").value(pairs(spark, [0, 10], [1, 9]), "y", "p"), 0.1)
    assert m.get("nrmse").value(pairs(spark, [5, 5], [1, 9]), "y", "p") == 0.0
    assert m.get("r2").value(pairs(spark, [5, 5], [1, 9]), "y", "p") == 0.0
    assert m.get("auc").value(pairs(spark, [1, 1], [0, 1]), "y", "p") is None
    assert m.get("rmse").gain(0.8, 1.0) > 0 and m.get("acc").gain(0.8, 1.0) < 0
    with pytest.raises(EvaluationError):
        m.get("nope")
    with pytest.warns(UserWarning):
        m.register(metrics.Metric("acc", metrics.acc))


def test_metrics_agree_with_plain_formulas(spark):
    rng = np.random.default_rng(42)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = pairs(spark, y, p)
    wins = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert math.isclose(metrics.auc(df, "y", "p").first()[0], wins, abs_tol=1e-12)
    guess = (p > 0.5).astype(int)
    f1 = np.mean([2 * ((guess == c) & (y == c)).sum() / ((guess == c).sum() + (y == c).sum()) for c in (0, 1)])
    assert math.isclose(metrics.f1_macro(pairs(spark, y, guess), "y", "p").first()[0], f1)


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x"), (float("nan"), None)], "a double, c string")
    d = profile.describe(df)
    assert d["a"] == {"type": "numerical", "mean": 2.0, "std": round(math.sqrt(2), 4), "min": 1.0, "max": 3.0, "missing": 2}
    assert d["c"] == {"type": "categorical", "unique": 2, "top": "x", "missing": 1}
    empty = spark.createDataFrame([(None,)], "c string")
    assert profile.describe(empty)["c"]["top"] == ""
    assert [r.nullable for r in profile.schema_summary(df).collect()] == [True, True]
    assert profile.null_for_nan(df).filter("isnan(a)").count() == 0


def test_fingerprint_ignores_order(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"), spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    assert profile.content_key(a) == profile.content_key(b) != profile.content_key(a.withColumnRenamed("i", "j"))


def test_prefilter(spark):
    df = spark.createDataFrame([(1, float(i), None, "t" if i else "u", i * 1000) for i in range(4)], "const int, varying double, const_nan double, text string, high int")
    assert screen.prefilter(df, ["const", "varying", "const_nan", "text", "high"]) == ["varying", "text", "high"]
    assert screen.prefilter(df, ["varying", "text", "high"], 2) == ["high", "varying"]
    assert screen.prefilter(df, []) == []
    half = spark.createDataFrame([(1,), (None,)], "a int")
    assert screen.prefilter(half, ["a"]) == ["a"]


def test_folds_are_even_and_stable(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(61)], "id int, y int")
    a = folds.stratified_folds(df, "y", "id", 5).toPandas()
    b = folds.stratified_folds(df.repartition(7), "y", "id", 5).toPandas()
    assert a.sort_values("id").fold.tolist() == b.sort_values("id").fold.tolist()
    counts = a.groupby(["y", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1
    train, test = folds.train_test_split(df, "id", 0.3, "y")
    assert train.count() + test.count() == 61 and 12 <= test.count() <= 24


def test_preprocessing_learns_from_training_rows_only(spark):
    df = spark.createDataFrame([(10.0, "a", 0), (20.0, "b", 0), (30.0, "c", 0), (1.0, "a", 1), (None, "d", 1)], "v double, c string, fold int")
    state = folds.learn(df, ["v", "c"], 2)
    held = state.apply(df, ["v", "c"], 1).filter("fold = 1").toPandas().sort_values("v")
    assert held.v.tolist() == [1.0, 20.0] and held.c.tolist() == [0.0, -1.0]
    medians = folds.fold_medians(df, ["v"], 2).toPandas().set_index("train_fold").v
    assert medians[1] == 20.0 and medians[0] == 1.0


def test_codes_of_many_categories_are_a_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"c{i * 7 % 31}" if i % 9 else None, i % 3) for i in range(200)], "i int, c string, fold int")
    kept = folds.learn(df, ["c"], 3)
    monkeypatch.setattr(folds, "MAX_CATEGORIES", 3)
    state = folds.learn(df, ["c"], 3)
    assert state.codes and not kept.codes
    for f in range(3):
        assert sorted(state.apply(df, ["c"], f).collect()) == sorted(kept.apply(df, ["c"], f).collect())


def test_medians_of_training_folds_are_exact(spark, monkeypatch):
    import numpy as np

    from tessera.operators import selection

    rng = np.random.default_rng(7)
    x = np.where(rng.random(3000) < 0.1, np.nan, np.round(rng.normal(size=3000) * 10.0 ** rng.integers(-3, 4, 3000), 3))
    y = rng.integers(-3, 3, 3000).astype(float)
    fold = rng.integers(0, 4, 3000)
    df = spark.createDataFrame([(float(a), float(b), None, int(f)) for a, b, f in zip(x, y, fold, strict=True)], "x double, y double, z double, fold int").repartition(5)
    for few in (1 << 14, 1):
        monkeypatch.setattr(selection, "FEW", few)
        got = folds.fold_medians(df, ["x", "y", "z"], 4).toPandas().set_index("train_fold")
        for f in range(4):
            assert got.x[f] == np.nanmedian(x[fold != f]) and got.y[f] == np.median(y[fold != f])
        assert got.z.isna().all()
    assert selection.training_quantiles(df, {"x": folds.value_of("x")}, 0.25, 4)["x"][1] == pytest.approx(np.nanquantile(x[fold != 1], 0.25), rel=1e-12)


def test_closed_scores_equal_those_of_fitted_models(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b, c = rng.normal(), rng.normal() * 5 + 100, rng.random()
        rows.append((i, a if rng.random() > 0.1 else None, b, 2.0, c if rng.random() > 0.2 else None, 2 * b, float(a + 0.1 * b + 3 * c + rng.normal() / 5)))
    df = spark.createDataFrame(rows, "i int, a double, b double, one double, c double, twice double, y double")
    for metric in ("rmse", "r2", "nrmse"):
        closed = Evaluator(task="regression", metric=metric, model="linear", folds=3)
        fitted = Evaluator(task="regression", metric=metric, model="linear", folds=3, model_params={"fitIntercept": True})
        (x, p), (y, q) = (e.gains(df, TableSpec("i", "y"), ["a", "b", "one"], ["c", "twice", "none"]) for e in (closed, fitted))
        assert x == pytest.approx(y, rel=1e-6)
        for g, h in zip(p, q, strict=True):
            assert g["feature"] == h["feature"] and (g["gain"] == pytest.approx(h["gain"], abs=1e-3) if h["gain"] is not None else g["gain"] is None and g["error"])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 301), "v": np.round(rng.normal(size=301), 1)})
    df = spark.createDataFrame(pdf)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    whole = ranks.quantiles(df, "v", shares).first()
    assert np.allclose(list(whole), np.quantile(pdf.v, list(shares.values())), atol=1e-12)
    for r in ranks.quantiles(df, "v", shares, ["g"]).collect():
        assert np.allclose(list(r)[1:], np.quantile(pdf.v[pdf.g == r.g], list(shares.values())), atol=1e-12)
    assert ranks.quantiles(df.limit(0), "v", shares).count() == 0


def test_multiclass_auc_in_the_evaluator(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 150)
    df = spark.createDataFrame(pd.DataFrame({"id": range(150), "x": y + rng.normal(size=150) / 3, "noise": rng.normal(size=150), "y": y}))
    e = Evaluator(model="linear", folds=2)
    base, gains = e.gains(df, TableSpec("id", "y"), ["noise"], ["x"])
    assert 0.3 < base < 0.7 and gains[0]["gain"] > 0.2
    scores = spark.createDataFrame([(0, 0.0, [0.8, 0.1, 0.1]), (0, 1.0, [0.2, 0.7, 0.1]), (0, 2.0, [0.3, 0.3, 0.4]), (0, 0.0, [0.1, 0.8, 0.1])], "fold int, label double, scores array<double>")
    want = np.mean([np.mean([[0.5 * (a == b) + (a > b) for b in neg] for a in pos]) for pos, neg in (([0.8, 0.1], [0.2, 0.3]), ([0.7], [0.1, 0.3, 0.8]), ([0.4], [0.1, 0.1, 0.1]))])
    assert math.isclose(metrics.auc_of_classes(scores, "label", "scores", 3, ["fold"]).first().auc, want)


def test_univariate_gains(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2), 0.0) for i in range(10)], "y int, good double, flat double")
    top = top_features(univariate_gains(df, "y", ["good", "flat"]), 5).collect()
    assert [(r.feature, r.gain, r["rank"]) for r in top] == [("good", 0.5, 1)]


def test_cross_validated_gain(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=120)
    pdf = pd.DataFrame({"id": range(120), "noise": rng.normal(size=120), "signal": x, "word": np.where(x > 0, "up", "down"), "y": (x > 0).astype(int)})
    df = spark.createDataFrame(pdf)
    e = Evaluator(model="linear", folds=2)
    base, gains = e.gains(df, TableSpec("id", "y"), ["noise"], ["signal", "word", "missing"])
    by = {g["feature"]: g for g in gains}
    assert by["signal"]["gain"] > 0.2 and by["word"]["gain"] > 0.2 and by["missing"]["gain"] is None and by["missing"]["error"]
    assert select_top(gains, 1) in (["signal"], ["word"])
    assert len(e._baselines) == 1 and 0 <= base <= 1


def test_selection_is_strict_and_stable():
    rows = [{"feature": f, "gain": g, "error": None} for f, g in (("zero", 0.0), ("a", 0.1), ("b", 0.1), ("low", -1.0), ("none", None))]
    assert select_top(rows, 2) == ["a", "b"] and select_top(rows, 9) == ["a", "b"]


def test_models():
    m = ModelRegistry()
    assert {"random_forest", "xgboost", "lightgbm", "catboost", "mlp"} <= set(m.names())
    with pytest.raises(EvaluationError):
        m.get("nope")
    with pytest.raises(EvaluationError):
        m.get("mlp", "regression")
