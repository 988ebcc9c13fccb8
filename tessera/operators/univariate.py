"""Gain of single columns without a model: the area under the curve of each column as a score, in one pass for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import auc


def univariate_gains(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """``feature``, ``auc``, ``gain`` (how far from 0.5, either way)."""
    rows = df.select(F.col(target).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("y", "f.feature", "f.x")
    return auc(rows, "y", "x", ["feature"]).select("feature", "auc", (F.greatest(F.col("auc"), 1 - F.col("auc")) - 0.5).alias("gain"))


def top_features(gains: DataFrame, k: int, minimum: float = 0.0) -> DataFrame:
    """Features whose gain is above ``minimum``, the ``k`` best, with ``rank``; the name breaks ties."""
    from pyspark.sql.window import Window

    best = gains.filter(F.col("gain") > minimum).orderBy(F.desc("gain"), "feature").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("gain"), "feature")))
