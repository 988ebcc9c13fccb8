"""Pruning of candidate columns in one pass: constants go, and of the rest those with the largest variance stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import _long, is_number, missing


def screen_table(df: DataFrame, candidates: list[str]) -> DataFrame:
    """``column``, ``constant`` (one value or none, missing being a value) and population ``variance`` (0 for texts)."""

    def of(name: str):
        gone, c = missing(df, name), F.col(f"`{name}`")
        value = F.when(~gone, c)
        one = F.coalesce(F.min(value) == F.max(value), F.lit(True))
        constant = one & ((F.count_if(gone) == 0) | (F.count(value) == 0))
        number = is_number(df.schema[name].dataType)
        return {"constant": constant, "variance": F.coalesce(F.var_pop(value.cast("double")), F.lit(0.0)) if number else F.lit(0.0)}

    return _long(df, {n: of(n) for n in candidates}, ["constant", "variance"])


def prefilter(df: DataFrame, candidates: list[str], most: int = 50) -> list[str]:
    """Names that stay: in their order if they aren't too many, else by falling variance."""
    if not candidates:
        return []
    found = {r["column"]: r for r in screen_table(df, candidates).collect()}
    varying = [c for c in candidates if not found[c]["constant"]]
    return varying if len(varying) <= most else sorted(varying, key=lambda c: -found[c]["variance"])[:most]
