"""Windows over the order of a whole table against pandas."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators.ordered import loans, over_order, trailing


def test_short_ranges_are_helped_out_by_earlier_ones():
    assert loans([5, 1, 0, 2], 3) == [(0, 1, 3), (1, 2, 1), (0, 2, 2), (1, 3, 1), (0, 3, 2)]
    assert loans([4], 2) == [] == loans([], 2)


@pytest.mark.parametrize("per_range", [7, 60, 10_000])
def test_trailing_equals_pandas(spark, per_range):
    rng = np.random.default_rng(2)
    t = np.concatenate((rng.integers(0, 40, 150), np.full(120, 17), rng.integers(0, 10**6, 130))).astype(float)  # ties, and a hot moment
    value = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.normal(size=len(t)))]
    rows = [(i, None if i % 50 == 7 else float(x), v) for i, (x, v) in enumerate(zip(t, value, strict=True))]
    df = spark.createDataFrame(rows, "id int, t double, v double").repartition(4)
    got = trailing(df, "v", ["t", "id"], 5, per_range).toPandas().set_index("id").sort_index()
    pdf = pd.DataFrame(rows, columns=["id", "t", "v"]).sort_values(["t", "id"], na_position="first").set_index("id")
    want = pd.DataFrame({"v_lag": pdf.v.shift(), "v_diff": pdf.v.diff(), "v_sum": pdf.v.rolling(5, min_periods=1).sum().where(np.arange(len(pdf)) >= 4)}).sort_index()
    for c in want:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    assert len(got) == len(rows)


def test_plan_has_no_window_of_one_partition(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).selectExpr("id", "hash(id) AS t")
    out = over_order(df, ["t", "id"], 1, lambda w: {"before": F.lag("id").over(w)}, 500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and out.filter("before is null").count() == 1
    assert trailing(df.limit(0), "t", ["t", "id"], 3).count() == 0
