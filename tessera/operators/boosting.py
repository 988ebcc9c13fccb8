"""Gradient boosting over histograms, with second-order gains, for regression, two classes and several (softmax).

Values become bins of eight bits: at most 254 cuts for a feature, quantiles of all rows or of the ``CUT_ROWS`` ones with the smallest hash, so that they don't
depend on partitioning; missing values are a bin of their own. The binned matrix is written once, in blocks of rows, and stays where it is: a job
for each level of a round's trees (one tree, or one for each class) adds up gradients and hessians by node, feature and bin within
each task, and Spark adds up tasks' sums. Of two siblings only the smaller one is counted; the other is the parent less it.

Gradients and hessians are rounded to multiples of 2^-30 and added as integers, so that sums, and with them trees, are the same
under any partitioning (up to 2^32 rows). Rows' scores so far are kept beside the blocks and renewed every ``RENEWED`` rounds.

Growth is by level (``"depth"``), by gain up to a number of leaves (``"leaves"``), or by one split for a whole level (``"symmetric"``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import lasting

CUT_ROWS, BLOCK_ROWS, RENEWED, BINS = 1 << 16, 1 << 14, 16, 256
UNIT = float(1 << 30)


@dataclass
class Tree:
    """Nodes by number: feature (-1 for leaves), last bin that goes left, children, and a leaf's value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for _ in range(2):
            for values, new in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                values.append(new)
        return at, at + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of ``bins`` (rows x features) ends."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[feature[node[rows]] >= 0]):
            here = node[rows]
            node[rows] = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])
        return node

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of values (rows x features): 0 for missing ones, else one more than the cuts below."""
    out = np.zeros(values.shape, np.uint8)
    for j, c in enumerate(cuts):
        known = ~np.isnan(values[:, j])
        out[known, j] = 1 + np.searchsorted(c, values[known, j], "left")
    return out


def gradients(kind: str, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each score (rows x outputs), in whole units."""
    if kind == "regression":
        g, h = scores - y[:, None], np.ones_like(scores)
    elif kind == "binary":
        p = 1 / (1 + np.exp(-scores))
        g, h = p - y[:, None], p * (1 - p)
    else:
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g, h = p - (y[:, None] == np.arange(scores.shape[1])), 2 * p * (1 - p)
    return np.rint(g * UNIT), np.rint(h * UNIT)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().fill_null(np.nan), np.float64)
    return flat.reshape(len(column), -1)


@dataclass
class Booster:
    """``fit`` takes a vector column ``features`` and a numeric ``label``."""

    kind: str = "binary"
    outputs: int = 1
    growth: str = "depth"
    rounds: int = 500
    rate: float = 0.02
    depth: int = 6
    leaves: int = 31
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    min_gain: float = 1e-9

    def fit(self, df: DataFrame) -> BoosterModel:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).filter("y is not null")
        sample = rows.orderBy(F.xxhash64("x", "y"), "y").limit(CUT_ROWS).toArrow()
        values = _matrix(sample.column("x").combine_chunks()) if len(sample) else np.zeros((0, 1))
        cuts = [self._cuts(values[:, j]) for j in range(values.shape[1])]
        ends = rows.agg(F.min("y"), F.max("y"), F.count("*")).first()
        low, high = (float(ends[0]), float(ends[1])) if ends[2] else (0.0, 1.0)
        middle, half = ((low + high) / 2, (high - low) / 2 or 1.0) if self.kind == "regression" else (0.0, 1.0)
        blocks = lasting(rows.mapInArrow(_blocks(cuts, middle, half, self.outputs), "bins binary, y binary, scores binary"), "boosting")
        model = BoosterModel(self.kind, self.outputs, cuts, middle, half, [])
        fresh: list[list[Tree]] = []
        for _ in range(self.rounds if ends[2] else 0):
            trees = self._round(blocks, len(cuts), fresh)
            if all(len(t.feature) == 1 and t.value[0] == 0.0 for t in trees):
                break
            model.trees.append(trees)
            fresh.append(trees)
            if len(fresh) == RENEWED:
                blocks, fresh = lasting(blocks.mapInArrow(_renewed(fresh, len(cuts), self.outputs), blocks.schema), "boosting"), []
        return model

    @staticmethod
    def _cuts(values: np.ndarray) -> np.ndarray:
        different = np.unique(values[~np.isnan(values)])
        if len(different) <= BINS - 2:
            return (different[1:] + different[:-1]) / 2
        ordered = np.sort(values[~np.isnan(values)])
        return np.unique(ordered[(np.arange(1, BINS - 1) * len(ordered)) // (BINS - 1)])

    def _round(self, blocks: DataFrame, width: int, fresh: list[list[Tree]]) -> list[Tree]:
        trees = [Tree() for _ in range(self.outputs)]
        asked = [(k, 0) for k in range(self.outputs)]
        counted = self._sums(blocks, width, fresh, trees, asked)
        open_nodes, count = dict(counted), [1] * self.outputs
        for (k, n), sums in open_nodes.items():
            trees[k].value[n] = self._value(sums)
        most = 1 << self.depth if self.growth != "leaves" else self.leaves
        for _ in range(self.depth if self.growth != "leaves" else self.leaves):
            splits = self._splits(open_nodes)
            asked, parents = [], {}
            for gain, k, n, j, cut in sorted(splits, key=lambda s: (-s[0], *s[1:])):
                if gain <= self.min_gain or count[k] >= most:
                    continue
                count[k] += 1
                left, right = trees[k].split(n, j, cut)
                small = open_nodes[k, n][2, j, : cut + 1].sum() * 2 <= open_nodes[k, n][2, j].sum()
                asked.append((k, left if small else right))
                parents[asked[-1]] = (open_nodes[k, n], (k, right if small else left))
            if not asked:
                break
            counted = self._sums(blocks, width, fresh, trees, asked)
            open_nodes = {}
            for node, sums in counted.items():
                parent, sibling = parents[node]
                open_nodes[node], open_nodes[sibling] = sums, parent - sums
            for (k, n), sums in open_nodes.items():
                trees[k].value[n] = self._value(sums)
        return trees

    def _value(self, sums: np.ndarray) -> float:
        g, h = sums[0, 0].sum() / UNIT, sums[1, 0].sum() / UNIT
        return float(-self.rate * g / (h + self.l2)) if h + self.l2 > 0 else 0.0

    def _gains(self, sums: np.ndarray) -> np.ndarray:
        """What each cut (features x bins) gains; minus infinity where a side is too small."""
        g, h, n = sums[0] / UNIT, sums[1] / UNIT, sums[2]
        left, right = [x.cumsum(1) for x in (g, h, n)], []
        right = [x.sum(1, keepdims=True) - c for x, c in zip((g, h, n), left, strict=True)]
        part = lambda g, h: np.where(h + self.l2 > 0, g * g / np.maximum(h + self.l2, 1e-12), 0.0)
        gain = part(left[0], left[1]) + part(right[0], right[1]) - part(g.sum(1, keepdims=True), h.sum(1, keepdims=True))
        good = (left[1] >= self.min_hessian) & (right[1] >= self.min_hessian) & (left[2] >= self.min_rows) & (right[2] >= self.min_rows)
        return np.where(good, gain, -np.inf)

    def _splits(self, nodes: dict[tuple[int, int], np.ndarray]) -> list[tuple[float, int, int, int, int]]:
        """(gain, tree, node, feature, bin) of each node's best cut, the first of equal ones; for symmetric trees that of the level."""
        gains = {at: self._gains(sums) for at, sums in nodes.items()}
        if self.growth == "symmetric":
            for k in {k for k, _ in gains}:
                level = [at for at in gains if at[0] == k]
                together = sum(np.where(np.isfinite(gains[at]), gains[at], 0.0) for at in level)
                best = np.unravel_index(int(together.argmax()), together.shape)
                for at in level:
                    keep = np.full_like(gains[at], -np.inf)
                    keep[best] = together[best] if np.isfinite(gains[at][best]) else -np.inf
                    gains[at] = keep
        out = []
        for (k, n), gain in gains.items():
            j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            out.append((float(gain[j, cut]), k, n, int(j), int(cut)))
        return out

    def _sums(self, blocks: DataFrame, width: int, fresh: list[list[Tree]], trees: list[Tree], asked: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Sums of gradients, hessians and rows (3 x features x bins) of nodes: no more rows come back than nodes have bins."""
        found = blocks.mapInArrow(_histograms(self.kind, width, self.outputs, fresh, trees, asked), "slot long, g long, h long, n long")
        total = found.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        sums = np.zeros((3, len(asked) * width * BINS), np.int64)
        for k, name in enumerate("ghn"):
            sums[k, np.asarray(total["slot"])] = np.asarray(total[name])
        return {at: sums.reshape(3, len(asked), width, BINS)[:, i] for i, at in enumerate(asked)}


def _blocks(cuts: list[np.ndarray], middle: float, half: float, outputs: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                y = (np.asarray(part.column(1)) - middle) / half
                made = [binned(_matrix(part.column(0)), cuts).tobytes(), y.tobytes(), np.zeros((len(y), outputs)).tobytes()]
                yield pa.record_batch([pa.array([m], pa.binary()) for m in made], ["bins", "y", "scores"])

    return run


def _read(row: dict, width: int, outputs: int, fresh: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins, y = np.frombuffer(row["bins"], np.uint8).reshape(-1, width), np.frombuffer(row["y"])
    scores = np.frombuffer(row["scores"]).reshape(-1, outputs).copy()
    for trees in fresh:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.score(bins)
    return bins, y, scores


def _renewed(fresh: list[list[Tree]], width: int, outputs: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                scores = _read(row, width, outputs, fresh)[2]
                yield pa.record_batch([pa.array([v], pa.binary()) for v in (row["bins"], row["y"], scores.tobytes())], ["bins", "y", "scores"])

    return run


def _histograms(kind: str, width: int, outputs: int, fresh: list[list[Tree]], trees: list[Tree], asked: list[tuple[int, int]]):
    def run(batches):
        total = np.zeros((3, len(asked) * width * BINS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, scores = _read(row, width, outputs, fresh)
                g, h = gradients(kind, scores, y)
                where = [tree.leaves(bins) for tree in trees]
                for i, (k, n) in enumerate(asked):
                    rows = np.flatnonzero(where[k] == n)
                    slot = (bins[rows].astype(np.int64) + np.arange(width) * BINS).ravel()
                    inside = slice(i * width * BINS, (i + 1) * width * BINS)
                    for c, w in enumerate((g[rows, k], h[rows, k], np.ones(len(rows)))):
                        total[c, inside] += np.bincount(slot, np.repeat(w, width), width * BINS).astype(np.int64)  # whole numbers below 2^53
        slot = np.flatnonzero(total[2])
        yield pa.record_batch([pa.array(slot), *(pa.array(total[c, slot]) for c in range(3))], ["slot", "g", "h", "n"])

    return run


@dataclass
class BoosterModel:
    kind: str
    outputs: int
    cuts: list[np.ndarray]
    middle: float
    half: float
    trees: list[list[Tree]]

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins, out = binned(values, self.cuts), np.zeros((len(values), self.outputs))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += tree.score(bins)
        return out

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Predictions, or the probabilities of classes."""
        scores = self.scores(values)
        if self.kind == "regression":
            return scores * self.half + self.middle
        if self.kind == "binary":
            p = 1 / (1 + np.exp(-scores[:, 0]))
            return np.stack([1 - p, p], 1)
        p = np.exp(scores - scores.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, and ``probability`` of classes."""
        model = df.sparkSession.sparkContext.broadcast(self)  # trees of a bounded number of nodes

        @F.pandas_udf("array<double>")
        def given(x):
            import pandas as pd

            return pd.Series(list(model.value.predict(np.array(x.tolist(), np.float64).reshape(len(x), -1)))) if len(x) else pd.Series([], dtype=object)

        out = df.withColumn("__given", given(vector_to_array("features")))
        if self.kind == "regression":
            return out.withColumn("prediction", F.col("__given")[0]).drop("__given")
        best = F.array_position("__given", F.array_max("__given")) - 1
        return out.withColumns({"probability": array_to_vector("__given"), "prediction": best.cast("double")}).drop("__given")
