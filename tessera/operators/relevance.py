"""How much columns tell about a target of any kind, without a model: one contingency aggregate for all columns.

Each number falls into a bin between exact quantiles of its column (``tessera.operators.selection``), missing ones into a bin of
their own; so does a numeric target. Tasks count (column, bin, target's bin) and add up the target's values, in state bounded by
columns, bins and classes; Spark adds up the tasks' counts. From the table follow

* ``information``: mutual information of the bins, in nats, for any target;
* ``ratio``: the correlation ratio of a numeric target, the share of its variance between the column's bins (null for classes).

Rows without a target take no part. A constant column tells nothing: 0 for both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import is_number
from tessera.operators.selection import quantiles_of
from tessera.session import lasting


def cuts_of(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Rising cuts between bins of about as many rows: a value belongs to the bin of the cuts below it."""
    known = quantiles_of(df, {c: F.col(f"`{c}`").cast("double") for c in columns}, [i / bins for i in range(1, bins)])
    return {c: sorted({q for (q,) in found if q is not None}) for c, found in known.items()}


def _counted(width: int, cuts: list[list[float]], bins: int, classes: int, target_cuts: list[float] | None):
    def run(batches):
        n, total = np.zeros((width, bins + 1, classes), np.int64), np.zeros((width, bins + 1))
        for batch in batches:
            y = np.asarray(batch.column(0))
            group = np.searchsorted(target_cuts, y, "left") if target_cuts is not None else y.astype(np.int64)
            for c in range(width):
                x = np.asarray(batch.column(c + 1).fill_null(np.nan))
                at = np.where(np.isnan(x), bins, np.searchsorted(cuts[c], x, "left"))
                n[c] += np.bincount(at * classes + group, minlength=(bins + 1) * classes).reshape(bins + 1, classes)
                total[c] += np.bincount(at, y, bins + 1)
        c, b, k = np.nonzero(n)
        first = np.concatenate(([True], (np.diff(c) != 0) | (np.diff(b) != 0))) if len(c) else np.zeros(0, bool)
        yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(n[c, b, k]), pa.array(np.where(first, total[c, b], 0.0))], ["c", "b", "k", "n", "total"])

    return run


def relevance(df: DataFrame, target: str, columns: list[str], classes: int = 0, bins: int = 16, cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """``feature``, ``information``, ``ratio``; ``target`` is a number (``classes`` 0) or a class from 0 to ``classes`` - 1."""
    spark, columns = df.sparkSession, [c for c in columns if is_number(df.schema[c].dataType)]
    known = df.select(F.col(f"`{target}`").cast("double").alias("__target"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).filter("__target is not null and not isnan(__target)")
    cuts = cuts or cuts_of(known, [*columns, *([] if classes else ["__target"])], bins)
    own = None if classes else cuts.get("__target") or cuts.get(target) or []
    made = known.mapInArrow(_counted(len(columns), [cuts[c] for c in columns], bins, classes or bins, own), "c int, b int, k int, n long, total double")
    # counted once, and bounded from here on: columns, bins and classes
    cells = lasting(made.groupBy("c", "b", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "relevance")
    by_bin = cells.groupBy("c", "b").agg(F.sum("n").alias("of_bin"), F.sum("total").alias("total"))
    by_class = cells.groupBy("c", "k").agg(F.sum("n").alias("of_class"))
    whole = cells.groupBy("c").agg(F.sum("n").alias("rows"), F.sum("total").alias("sum"))
    n, rows = F.col("n"), F.col("rows")
    information = cells.drop("total").join(by_bin.drop("total"), ["c", "b"]).join(by_class, ["c", "k"]).join(whole, "c").groupBy("c").agg(F.greatest(F.sum(n / rows * F.log(n * rows / (F.col("of_bin") * F.col("of_class")))), F.lit(0.0)).alias("information"))
    mean = F.col("sum") / rows
    between = by_bin.join(whole, "c").groupBy("c").agg(F.sum(F.col("of_bin") * F.pow(F.col("total") / F.col("of_bin") - mean, 2)).alias("between"), F.first("rows").alias("rows"))
    names = spark.createDataFrame(list(enumerate(columns)), "c int, feature string")
    spread = known.agg(F.var_pop("__target").alias("spread"))  # one row
    ratio = F.when(F.lit(bool(classes)), F.lit(None).cast("double")).otherwise(F.when(F.col("spread") > 0, F.col("between") / F.col("rows") / F.col("spread")).otherwise(0.0))
    out = names.join(information, "c", "left").join(between, "c", "left").crossJoin(F.broadcast(spread))
    return out.select("feature", F.coalesce("information", F.lit(0.0)).alias("information"), (ratio if classes else F.coalesce(ratio, F.lit(0.0))).alias("ratio"))
