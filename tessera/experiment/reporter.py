"""Reports over experiment rows: means, the best of each group, a summary, and tables for people."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

KEYS = ("dataset", "method", "model")
CONFIG = ("seed", "n_rounds", "run_id")


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def report_mean(results: DataFrame, parity: bool = False) -> DataFrame:
    """Means by dataset, method and model, of the metrics (with ``parity`` of every number, seeds too)."""
    keys = [k for k in KEYS if k in results.columns]
    values = [c for c in _numbers(results) if parity or c not in CONFIG]
    return results.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values])


def report_best(results: DataFrame, metric: str, group_by: str = "dataset", order: str = "run_id") -> DataFrame:
    """The best row of each group; the earliest of equal ones, rows without the metric last."""
    w = Window.partitionBy(group_by).orderBy(F.desc_nulls_last(metric), order)
    return results.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def report_summary(results: DataFrame) -> DataFrame:
    """``total_runs``, ``successful_runs``, ``failed_runs`` and the mean of each metric."""
    ok = F.col("error").isNull() if "error" in results.columns else F.lit(True)
    values = [c for c in _numbers(results) if c not in CONFIG]
    return results.agg(F.count("*").alias("total_runs"), F.count_if(ok).alias("successful_runs"), F.count_if(~ok).alias("failed_runs"), *[F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in values])


def to_markdown(df: DataFrame, digits: int = 4) -> str:
    rows = df.collect()
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def to_html(df: DataFrame, title: str = "Report") -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def to_json(df: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str, indent=1)
