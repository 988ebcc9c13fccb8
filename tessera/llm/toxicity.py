"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (of 3 to 5 code points, A-Z read as a-z) that a text holds, hashed. Over the training
rows each feature gets the log ratio of its smoothed document frequencies among toxic and other texts; features whose
frequencies differ most significantly are kept, a text's present features are scaled by their ratios, and a logistic
regression is fitted on the scaled features. Whole texts are read, in training and in scoring; scoring needs the fixed
table of weights only, so texts never move.

The classifier is fitted on labelled rows, ``max_train_rows`` of them at most (those whose hashed ids are smallest).

Defined results: null and empty texts have no features and the score of the intercept; rows with a null label don't
train; of several labels of one id the largest counts, of several texts the smallest trains; every row is scored; without labelled
rows of both kinds every score is the smoothed share of toxic labels (0.5 without labels). Columns of the input named as
the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FOLDED_HASH, Scratch, mix64, powers, row_slices, text_bytes, without

ORDERS = (3, 4, 5)
HASH_BITS = 20
BLOCK_BITS = 14


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature
    intercept: float


def grams(buf: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed n-grams of texts, each feature of a row once; of ``wanted`` features only, if given."""
    rows, features = [], []
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(FOLDED_HASH[buf] * up[: len(buf)], out=total[1:])
    edge = np.append(lead, len(buf))
    first = np.searchsorted(lead, off)  # first character of each row
    for n in ORDERS:
        if len(lead) < n:
            continue
        start, end = lead[: len(lead) - n + 1], edge[n : len(lead) + 1]
        h = (total[end] - total[start]) * down[start]
        at = (mix64(h + np.uint64(n)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        inside = np.ones(len(at), bool)
        for f in first[1:-1]:
            inside[max(0, f - n + 1) : f] = False  # it would run into the next row
        if wanted is not None:
            inside &= wanted[at]
        here = np.flatnonzero(inside)
        rows.append(np.searchsorted(first, here, "right") - 1)
        features.append(at[here])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(rows) << HASH_BITS) | np.concatenate(features))
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


def _document_counts(batches):
    """Documents that hold each feature, by label, as blocks of counters."""
    counts = np.zeros((2, 1 << HASH_BITS), np.int32)
    for batch in batches:
        toxic = np.asarray(batch.column(0)).astype(np.int64)
        buf, off = text_bytes(batch.column(1))
        for i, j in row_slices(off):
            row, feature = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            label = toxic[i:j][row]
            for k in (0, 1):
                counts[k] += np.bincount(feature[label == k], minlength=1 << HASH_BITS).astype(np.int32)
    blocks = [(b, counts[:, b << BLOCK_BITS : (b + 1) << BLOCK_BITS]) for b in range(1 << (HASH_BITS - BLOCK_BITS))]
    blocks = [(b, x) for b, x in blocks if x.any()]
    if blocks:
        yield pa.record_batch([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x.astype(np.int64).tobytes() for _, x in blocks], pa.binary())], ["block", "counts"])


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.int64)
            total[b] = total[b] + x if b in total else x
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _presence(kept):
    """Kept features of each training row, by their places among the kept (65,536 at most)."""

    def run(batches):
        wanted = np.unpackbits(np.frombuffer(kept.value, np.uint8)).view(bool)
        place = (np.cumsum(wanted) - 1).astype(np.uint16)
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            held = []
            for i, j in row_slices(off):
                row, feature = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], wanted)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                held += [place[feature[ends[r] : ends[r + 1]]].tobytes() for r in range(j - i)]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.binary())], ["toxic", "features"])

    return run


def log_ratios(counts: np.ndarray, totals: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature: the log ratio of its smoothed document frequencies among toxic and other texts, and by how many standard errors they differ."""
    share = (counts + 1) / (np.array([[totals[0]], [totals[1]]]) + 2)
    pooled = (counts.sum(0) + 2) / (totals[0] + totals[1] + 4)
    return np.log(share[1] / share[0]), np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / (totals[0] + 2) + 1 / (totals[1] + 2)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column | None = None, max_train_rows: int = 20_000, max_features: int = 4096, l2: float = 1e-6, steps: int = 300, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the ``labels`` (``doc_id``, ``toxic``) that the predicate ``train`` admits."""
    scratch = Scratch(spark, "toxicity")
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    if train is not None:
        chosen = chosen.filter(train)
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_train_rows)
    chosen = F.broadcast(chosen)  # 16 bytes for each of max_train_rows rows
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    # one row for each label, however often its id is repeated: read once here, and then from a small table
    rows = scratch.table(held.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "training")
    totals = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Model(np.zeros(1 << HASH_BITS), float(np.log((totals[1] + 1) / (totals[0] + 1))))
    if not totals[0] or not totals[1]:
        return empty
    summed = rows.mapInArrow(_document_counts, "block int, counts binary").repartition("block").mapInArrow(_summed, "block int, counts binary").toArrow()
    counts = np.zeros((2, 1 << HASH_BITS), np.int32)
    for b, x in zip(summed["block"].to_pylist(), summed["counts"], strict=True):
        counts[:, b << BLOCK_BITS : (b + 1) << BLOCK_BITS] = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
    del summed
    often = np.flatnonzero(counts.sum(0) >= 3)  # what fewer rows hold can't be significant
    ratio, significance = log_ratios(counts[:, often], totals)
    best = np.lexsort((often, -significance))[: min(max_features, 1 << 16)]
    best = np.sort(best[significance[best] > 4])
    if not len(best):
        return empty
    order, scale = often[best], ratio[best]
    del counts, ratio, significance
    wanted = np.zeros(1 << HASH_BITS, bool)
    wanted[order] = True
    held = rows.mapInArrow(_presence(spark.sparkContext.broadcast(np.packbits(wanted).tobytes())), "toxic int, features binary").toArrow()
    toxic = np.asarray(held["toxic"]).astype(float)
    length = np.array([len(x.as_buffer()) // 2 for x in held["features"]])
    places = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in held["features"]])
    del held
    starts = np.concatenate(([0], np.cumsum(length)))
    n, chunk = len(toxic), 1000  # rows that are widened at a time

    def pieces():
        for lo in range(0, n, chunk):
            hi = min(lo + chunk, n)
            at = places[starts[lo] : starts[hi]].astype(np.int64)
            yield lo, hi, at, np.repeat(np.arange(hi - lo), length[lo:hi]), scale[at]

    # accelerated gradient steps, of a length from the largest curvature (found by power iteration)
    v, curve = np.ones(len(order)), 1.0
    for _ in range(15):
        new = np.zeros(len(order))
        for lo, hi, at, row, value in pieces():
            new += np.bincount(at, np.bincount(row, v[at] * value, hi - lo)[row] * value, len(order))
        curve = max(float(np.linalg.norm(new)), 1e-9)
        v = new / curve
    step = 4.0 / (curve / n + 1)
    w, b, fast_w, fast_b, t = np.zeros(len(order)), empty.intercept, np.zeros(len(order)), empty.intercept, 1.0
    for _ in range(steps):
        slope, lean = l2 * fast_w, 0.0
        for lo, hi, at, row, value in pieces():
            p = 1 / (1 + np.exp(-(np.bincount(row, fast_w[at] * value, hi - lo) + fast_b)))
            err = (p - toxic[lo:hi]) / n
            slope = slope + np.bincount(at, err[row] * value, len(order))
            lean += err.sum()
        new_w, new_b = fast_w - step * slope, fast_b - step * lean
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        fast_w, fast_b = new_w + (t - 1) / nxt * (new_w - w), new_b + (t - 1) / nxt * (new_b - b)
        w, b, t = new_w, new_b, nxt
    weights = np.zeros(1 << HASH_BITS)
    weights[order] = w * scale
    return Model(weights, float(b))


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    docs = without(docs, "score", "predicted")
    used = np.flatnonzero(model.weights)
    table = spark.sparkContext.broadcast((used.astype(np.int32).tobytes(), model.weights[used].tobytes()))
    intercept = model.intercept

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = (np.frombuffer(x, kind) for x, kind in zip(table.value, (np.int32, np.float64), strict=True))
        weights, wanted = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS, bool)
        weights[at], wanted[at] = w, True
        for texts in batches:
            buf, off = text_bytes(pa.array(texts, pa.large_string(), from_pandas=True))
            out = np.full(len(texts), intercept)
            for i, j in row_slices(off):
                row, feature = grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], wanted)
                out[i:j] += np.bincount(row, weights[feature], j - i)
            yield pd.Series(1 / (1 + np.exp(-out)))

    return docs.withColumn("score", scored(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("id")))
    return score(spark, docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
