"""Folds, splits, and the state that preprocessing learns on each fold's training rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.profile import is_number
from tessera.operators.ranks import value_ranks
from tessera.operators.selection import training_quantiles
from tessera.session import lasting


def order_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def stratified_folds(df: DataFrame, target: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: each class is dealt out in the order of a hash, so folds differ by one row of it at most.

    Rows of a class are numbered within ranges of the hash, and ranges are counted, so no task orders a whole class.
    """
    h = order_key(row_id, seed)
    keyed = df.withColumns({"__h": h, "__range": F.substring(h, 1, 3)})
    starts = keyed.groupBy(target, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(target).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col(target).alias("__t"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(target, "__range").orderBy("__h", row_id)) - 1
    numbered = keyed.withColumn("__i", inside)
    joined = numbered.join(starts, F.col(target).eqNullSafe(F.col("__t")) & (F.col("__range") == F.col("__r")))
    return joined.select(*df.columns, F.pmod(F.col("__start") + F.col("__i"), F.lit(k)).cast("int").alias("fold"))


def kfold(df: DataFrame, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` from a hash of the row's id: no shuffle, folds of about equal size."""
    code = F.conv(F.substring(order_key(row_id, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(code, F.lit(k)).cast("int"))


def train_test_split(df: DataFrame, row_id: str, test_share: float = 0.3, target: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two frames, in tenths; stratified by ``target``, if given."""
    parts, cut = 10, round(test_share * 10)
    dealt = stratified_folds(df, target, row_id, parts, seed) if target else kfold(df, row_id, parts, seed)
    return dealt.filter(F.col("fold") >= cut).drop("fold"), dealt.filter(F.col("fold") < cut).drop("fold")


def per_training_fold(df: DataFrame, k: int) -> DataFrame:
    """Each row once for each fold that it helps to train, as ``train_fold``."""
    folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return df.withColumn("train_fold", F.explode(folds))


def fold_medians(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Exact medians of each fold's training rows: ``train_fold`` and a column for each."""
    found = training_quantiles(df, {c: value_of(c) for c in columns}, 0.5, k)
    return df.sparkSession.createDataFrame([(f, *[found[c][f] for c in columns]) for f in range(k)], ", ".join(["train_fold int", *[f"`{c}` double" for c in columns]]))


def fold_codes(df: DataFrame, column: str, k: int) -> DataFrame:
    """(``train_fold``, ``value``, ``code``): the places of a fold's training values among them, sorted, from 0; for any number of values.

    Values are counted by fold once; a value is absent from a fold's training rows if that fold has all of its rows. What is
    left is numbered in ranges, whose counts are added up.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"), *[F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(k)])
    present = F.array_compact(F.array(*[F.when(F.col("n") > F.col(f"n{f}"), F.lit(f)) for f in range(k)]))
    trained = counts.select("value", F.explode(present).alias("train_fold"))
    return value_ranks(trained, "value", ["train_fold"]).select("train_fold", "value", F.col("below").alias("code"))


def fold_categories(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Sorted categories of each fold's training rows."""
    return per_training_fold(df, k).groupBy("train_fold").agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns])


def value_of(column: str) -> Column:
    """A number, null where it is missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


#: Different texts of a column whose codes are kept in the driver; those of wider columns are a table.
MAX_CATEGORIES = 10_000


@dataclass(frozen=True)
class FoldState:
    """What preprocessing learned from the training rows of each of ``k`` folds."""

    medians: dict[str, list[float | None]]
    categories: dict[str, list[list[str]]]
    codes: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, df: DataFrame, columns: list[str], fold: int) -> DataFrame:
        """``df`` with ``columns`` as numbers: medians for missing ones, codes for texts, -1 for what training hadn't."""
        out = {}
        for i, c in enumerate(columns):
            if c in self.medians:
                median = self.medians[c][fold]
                out[c] = F.coalesce(value_of(c), F.lit(0.0 if median is None else float(median)))
                continue
            if c in self.codes:
                table = self.codes[c].filter(F.col("train_fold") == fold).select(F.col("value").alias(f"__v{i}"), F.col("code").cast("double").alias(f"__n{i}"))
                df = df.join(table, F.col(c).cast("string") == F.col(f"__v{i}"), "left")
                out[c] = F.coalesce(F.col(f"__n{i}"), F.lit(-1.0))
                continue
            table = df.sparkSession.createDataFrame([(v, float(n)) for n, v in enumerate(self.categories[c][fold])], f"__v{i} string, __n{i} double")
            df = df.join(F.broadcast(table), F.col(c).cast("string") == F.col(f"__v{i}"), "left")  # MAX_CATEGORIES rows at most
            out[c] = F.coalesce(F.col(f"__n{i}"), F.lit(-1.0))
        return df.select(*[c for c in df.columns if c not in columns and not c.startswith(("__v", "__n"))], *[e.alias(c) for c, e in out.items()])


def learn(df: DataFrame, columns: list[str], k: int, lower: bool = False) -> FoldState:
    """The state of all folds and columns of ``df`` (with ``fold``): exact medians of numbers (with ``lower``, the lower of two), and the categories of texts."""
    numbers = [c for c in columns if is_number(df.schema[c].dataType)]
    texts = [c for c in columns if c not in numbers]
    medians = training_quantiles(df, {c: value_of(c) for c in numbers}, 0.5, k, lower) if numbers else {}
    many = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in texts]).first() if texts else {}
    wide = [c for c in texts if many[c] > MAX_CATEGORIES]
    narrow = [c for c in texts if c not in wide]
    asked = [F.array_sort(F.collect_set(F.when(F.col("fold") != f, F.col(c).cast("string")))) for c in narrow for f in range(k)]
    found = list(df.agg(*[a.alias(f"s{i}") for i, a in enumerate(asked)]).first()) if asked else []
    return FoldState(medians, {c: found[i * k : (i + 1) * k] for i, c in enumerate(narrow)}, {c: lasting(fold_codes(df, c, k), "codes") for c in wide})


def category_code(value: Column, categories: Column) -> Column:
    """Place among sorted categories, from 0; -1 for null and for what training hadn't."""
    return F.coalesce(F.array_position(categories, value.cast("string")) - 1, F.lit(-1)).cast("int")
