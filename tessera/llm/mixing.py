"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, ``epochs * rows * weight / (sum of weights * rows of the source)``. A document's
number of copies inverts the Poisson distribution of that mean at a uniform number seeded by a hash of the document's id,
so a rerun, a retry or another partitioning draws the same copies. Each document is exploded by its count and the copies
are dealt over all partitions, and sorted inside them, by a hash of id and copy: a global shuffle. Rows with equal hashes are
dealt by where they were read, so that no group of copies is one task.

Only counts by source meet in an aggregate; texts move once, by the uniform hash, whatever the size of one source.

Defined results: a null source is a source of its own; a null id draws by its text; rows that repeat an id draw alike;
null and empty texts are copied as any other; a source without a weight in a given mapping has weight 0; no rows give no
rows. Columns of the input named ``copy``, ``n_copies`` or ``mix_key`` are replaced by the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, unused, without

#: The rates of up to this many sources (tens of bytes and a table of probabilities each) are broadcast.
BROADCAST_SOURCES = 2000
#: Salts at least, and rows that a salt is for where there are more.
SALTS, ROWS_PER_SALT = 64, 1 << 20


def uniform(seed: int, key: Column) -> Column:
    """52 bits of a hash of seed and key, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """``first`` and ``cdf``: the distribution from ``first`` on, as far as its tails hold anything in double precision."""
    spread = F.sqrt(rate) * 10
    first = F.greatest(F.lit(0), F.floor(rate - spread - 10)).cast("long")
    last = F.ceil(rate + spread + 20).cast("long")
    log_fact = F.when(first > 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(first, F.lit(1).cast("long"))), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double")))).otherwise(F.lit(0.0))
    start = F.struct((first * F.ln(rate) - rate - log_fact).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        now = F.when(k == first, acc["p"]).otherwise(acc["p"] + F.ln(rate) - F.ln(k.cast("double")))
        total = acc["sum"] + F.exp(now)
        return F.struct(now.alias("p"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    cdf = F.when(rate > 0, F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))
    return F.struct(F.when(rate > 0, first).otherwise(F.lit(0).cast("long")).alias("first"), cdf.alias("cdf"))


def mix_sources(
    spark: SparkSession, docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 20, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns of ``docs``, with ``copy`` (from 0), ``n_copies`` and ``mix_key`` (the shuffled order), one row per copy.

    ``weights`` are target shares by source; without them a source of ``n`` rows weighs ``n ** alpha``.
    """
    if weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    scratch = Scratch(spark, "mixing")
    docs = without(docs, "copy", "n_copies", "mix_key")
    source, table, key, u, salt, mine = unused(docs, "mix_source", "mix_table", "mix_id", "mix_draw", "mix_salt", "mix_part")
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = scratch.table(counts.withColumn("w", weight), "weights")
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("sources")).first()
    share = F.lit(float(epochs) * (total["n"] or 0) / (total["w"] or 1.0))
    rates = weighed.select(F.col("source").alias(source), poisson_table(share * F.col("w") / F.col("n")).alias(table))
    same = F.col(source_col).eqNullSafe(F.col(source))
    if total["sources"] <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(rates), same)
    else:  # one source may hold a third of the rows: its rows are dealt over salts, more of them for more rows
        salts = max(SALTS, (total["n"] or 0) // ROWS_PER_SALT)
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = docs.withColumn(mine, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(salts)).cast("int"))
        rated = dealt.join(salted, same & (F.col(mine) == F.col(salt))).drop(mine, salt)
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    drawn = F.col(f"{table}.first") + F.size(F.filter(f"{table}.cdf", lambda c: c <= F.col(u)))
    copies = rated.withColumn(key, named).withColumn(u, uniform(seed, F.col(key))).withColumn("n_copies", drawn.cast("long")).filter("n_copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key), F.lit(":"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    copies = copies.withColumn("mix_key", order).drop(source, table, key, u)
    # rows that repeat an id, or a text without one, share their keys: where they are read deals them over partitions
    return copies.repartition("mix_key", F.spark_partition_id()).sortWithinPartitions("mix_key", id_col)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) / (SELECT sum(w) FROM n) * w / n AS rate FROM n),
p AS (SELECT source, rate, unnest(range(greatest(0, floor(rate - sqrt(rate) * 10 - 10))::BIGINT, ceil(rate + sqrt(rate) * 10 + 20)::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, min(k) AS first, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT d.*, ('0x' || substr(md5('20:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d),
m AS (SELECT d.*, first + len(list_filter(l.cdf, lambda x: x <= d.u)) AS n_copies FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, text, lang, source, n_chars, n_copies, unnest(range(n_copies)) AS copy FROM m)
SELECT doc_id, text, lang, source, n_chars, n_copies::BIGINT AS n_copies, copy::BIGINT AS copy, ('0x' || substr(md5('20:' || doc_id || ':' || copy), 1, 15))::BIGINT AS mix_key FROM e
"""
