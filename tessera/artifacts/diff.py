"""How methods' features differ. Input rows are (method, feature, gain, ord)."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.artifacts.bundle import ArtifactBundle


def feature_rows(spark: SparkSession, bundles: dict[str, ArtifactBundle]) -> DataFrame:
    rows = [(m, name, gain, i) for m, b in bundles.items() for i, (name, gain) in enumerate(b.gains())]
    return spark.createDataFrame(rows, "method string, feature string, gain double, ord long")


def overlap(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Feature by method, 0 or 1."""
    return rows.groupBy("feature").pivot("method", methods).agg(F.lit(1)).fillna(0, methods)


def gain_matrix(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Feature by method; the last of repeated features counts."""
    return rows.groupBy("feature").pivot("method", methods).agg(F.max_by("gain", "ord"))


def shared_by_all(rows: DataFrame, methods: list[str]) -> DataFrame:
    return rows.groupBy("feature").agg(F.count_distinct("method").alias("n")).filter(F.col("n") == len(methods)).select("feature")


def unique_to_one(rows: DataFrame) -> DataFrame:
    """``method``, ``feature`` of what no other method has."""
    return rows.groupBy("feature").agg(F.count_distinct("method").alias("n"), F.min("method").alias("method")).filter("n = 1").select("method", "feature")


def flat(rows: DataFrame, methods: list[str]) -> DataFrame:
    """``feature``, ``methods``, ``num_methods``, ``shared_all`` and a gain of each method."""
    named = rows.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods"), F.count_distinct("method").alias("num_methods"))
    gains = gain_matrix(rows, methods).select("feature", *[F.col(m).alias(f"{m}_gain") for m in methods])
    return named.withColumn("shared_all", F.col("num_methods") == len(methods)).join(gains, "feature")


def summary(rows: DataFrame) -> DataFrame:
    """``method``, ``total``, ``unique``, ``mean_gain``, ``max_gain``."""
    owners = rows.groupBy("feature").agg(F.count_distinct("method").alias("owners"))
    latest = rows.groupBy("method", "feature").agg(F.max_by("gain", "ord").alias("gain"))
    return latest.join(owners, "feature").groupBy("method").agg(F.count("*").alias("total"), F.count_if(F.col("owners") == 1).alias("unique"), F.avg("gain").alias("mean_gain"), F.max("gain").alias("max_gain"))


def dashboard(rows: DataFrame, methods: list[str], title: str = "Methods") -> str:
    """One HTML page: the summary, and the features of each method."""

    def table(df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect()) + "</table>"

    parts = [f"<h2>{html.escape(t)}</h2>{table(d)}" for t, d in (("Summary", summary(rows).orderBy("method")), ("Features", flat(rows, methods).orderBy("feature")))]
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(parts)}"


def distinct_scripts(scripts: DataFrame, code: str = "code", order: str = "ord") -> DataFrame:
    """The first of scripts that are equal by SHA-256: ``sha256``, ``ord``."""
    return scripts.groupBy(F.sha2(F.col(code), 256).alias("sha256")).agg(F.min(order).alias("ord"))
