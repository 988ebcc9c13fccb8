"""Column profiles, schema summaries and fingerprints, each in one pass over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_text(kind: T.DataType) -> bool:
    return not is_number(kind) and not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return (c.isNull() | F.isnan(c)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def null_for_nan(df: DataFrame) -> DataFrame:
    """Missing numbers as null: for the boundary of sources that write NaN."""
    return df.withColumns({f.name: F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))} or {df.columns[0]: F.col(f"`{df.columns[0]}`")})


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]], order: list[str]) -> DataFrame:
    """One aggregate over the table, turned to a row for each column."""
    row = df.agg(*[c.alias(f"{name}\u0001{k}") for name, own in aggregates.items() for k, c in own.items()])
    structs = [F.struct(F.lit(name).alias("column"), *[F.col(f"`{name}\u0001{k}`").alias(k) for k in order]) for name in aggregates]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def profile_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """``column``, ``mean``, ``std``, ``min``, ``max`` (rounded half to even), ``missing``."""
    columns = columns or [f.name for f in df.schema if is_number(f.dataType)]

    def of(name: str) -> dict[str, Column]:
        x = F.when(~missing(df, name), F.col(f"`{name}`").cast("double"))
        return {k: F.bround(fn(x), digits) for k, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))} | {"missing": F.count_if(missing(df, name))}

    return _long(df, {n: of(n) for n in columns}, ["mean", "std", "min", "max", "missing"])


def profile_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``unique``, ``top`` (smallest of the most frequent, empty if all are missing), ``missing``."""
    columns = columns or [f.name for f in df.schema if is_text(f.dataType)]
    of = lambda n: {"unique": F.count_distinct(F.col(f"`{n}`")), "top": F.coalesce(F.mode(F.col(f"`{n}`").cast("string"), True), F.lit("")), "missing": F.count_if(missing(df, n))}
    return _long(df, {n: of(n) for n in columns}, ["unique", "top", "missing"])


def describe(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """By column: ``type`` and its profile; small, on the driver."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    numbers, texts = [f.name for f in fields if is_number(f.dataType)], [f.name for f in fields if is_text(f.dataType)]
    found: dict[str, dict] = {}
    for names, fn, kind in ((numbers, profile_numeric, "numerical"), (texts, profile_categorical, "categorical")):
        if names:
            for r in fn(df, names).collect():
                d = r.asDict()
                name = d.pop("column")
                time = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
                found[name] = {"type": "datetime" if time else kind} | d
    return {f.name: found[f.name] for f in fields if f.name in found}


def schema_summary(df: DataFrame) -> DataFrame:
    """``column``, ``dtype``, ``nullable`` (whether it holds a missing value), ``rows``, ``missing_percent``."""
    rows = F.count("*")
    of = lambda n: {"dtype": F.lit(df.schema[n].dataType.simpleString()), "nullable": F.coalesce(F.max(missing(df, n)), F.lit(False)), "rows": rows, "missing_percent": F.coalesce(F.avg(missing(df, n).cast("int")) * 100, F.lit(0.0))}
    return _long(df, {n: of(n) for n in df.columns}, ["dtype", "nullable", "rows", "missing_percent"])


def fingerprint(df: DataFrame, by_md5: bool = False) -> DataFrame:
    """Of the content whatever its order: ``rows``, and sums over hashes of rows."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns]
    if by_md5:
        code = F.conv(F.substring(F.md5(F.concat_ws("\u0001", *texts)), 1, 8), 16, 10).cast("long")
    else:
        code = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) % (1 << 31)
    return df.select(code.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


def head(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The ``n`` rows of the smallest ids: the same ones every time."""
    return df.orderBy(row_id).limit(n)


def sample_fingerprint(df: DataFrame, row_id: str, n: int = 256) -> DataFrame:
    return fingerprint(head(df, row_id, n))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin``, ``n`` and ``is_mode`` (more rows than in the bins beside it) of equally wide bins between the extremes."""
    x = F.col(column).cast("double")
    edges = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))  # one row
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((x - F.col("__lo")) / width))).otherwise(0).cast("int")
    counted = df.filter(x.isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("bin")  # one row for each bin
    near = lambda fn: F.coalesce(fn("n").over(w), F.lit(0))
    return counted.withColumn("is_mode", ((F.col("n") > near(F.lag)) & (F.col("n") > near(F.lead))).cast("int"))


def content_key(df: DataFrame) -> str:
    """A key for caches: columns, types and content."""
    r = fingerprint(df).first()
    return f"{df.schema.simpleString()}:{r['rows']}:{r['hash_sum']}:{r['hash_xor']}"


def is_classification(df: DataFrame, target: str, most: int = 10) -> bool:
    return df.select(target).dropna().distinct().limit(most + 1).count() <= most


def any_null(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (c.isNull() for c in columns))
