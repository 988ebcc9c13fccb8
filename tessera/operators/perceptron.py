"""A perceptron for regression that stops when rows held out stop gaining.

Equal rows become one with a weight, rows are dealt into blocks by hash, and each block is sorted: blocks don't depend on
partitioning, and no value is too frequent for one. Columns and target are scaled by exact quantiles. Each step is one job over the blocks,
which are written once: tasks add up their blocks' gradients, groups of ``FAN_IN`` tasks add up theirs (so that the driver gets few
arrays, of the network's size), and L-BFGS moves the weights. Gradients are means, in whole multiples of 2^-40 and added as
integers, so weights are the same under any partitioning. A tenth of the different rows, by hash, is held out; the weights with the least loss
on them are kept, and ``patience`` steps without a better one are the last. Missing values are their column's median.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import EvaluationError
from tessera.operators.selection import quantiles_of
from tessera.session import lasting

BLOCK_ROWS, FAN_IN, MEMORY, HELD_OUT = 1 << 12, 32, 10, 10
UNIT = float(1 << 40)
#: Means of gradients beyond this are no step to take.
LARGEST = float(1 << 22)
_SHARES = [0.0, 0.05, 0.5, 0.95, 1.0]


def scale_of(q: list[float | None]) -> tuple[float, float]:
    """Middle and spread by quantiles: half of what the middle nine tenths span, else half of what all span."""
    if q[2] is None:
        return 0.0, 1.0
    return q[2], (q[3] - q[1]) / 2 or (q[4] - q[0]) / 2 or 1.0


def unflatten(theta: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(net: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    values = [x]
    for k, (w, b) in enumerate(net):
        z = values[-1] @ w + b
        values.append(np.tanh(z) if k + 1 < len(net) else z)
    return values


def slopes(theta: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums over rows: the gradient of half the squared error, that error of the others, and of the rows held out."""
    net = unflatten(theta, layers)
    values = forward(net, x)
    off = values[-1][:, 0] - y
    parts, back = [], (off * weight * ~held)[:, None]
    for k in range(len(net) - 1, -1, -1):
        parts.append(np.concatenate(((values[k].T @ back).ravel(), back.sum(0))))
        if k:
            back = (back @ net[k][0].T) * (1 - values[k] ** 2)
    error = off * off * weight / 2
    return np.concatenate((*reversed(parts), [error[~held].sum(), error[held].sum()]))


def _block(scales: list[tuple[float, float]]):
    middle, spread = np.array([s[0] for s in scales]), np.array([s[1] for s in scales])

    def run(table: pa.Table) -> pa.Table:
        y, n, held = (np.asarray(table[c].combine_chunks()) for c in ("y", "n", "held"))
        x = np.asarray(table["x"].combine_chunks().flatten().fill_null(np.nan), np.float64).reshape(len(y), -1)
        order = np.lexsort((*x.T[::-1], y))
        x = np.nan_to_num((x[order] - middle[:-1]) / spread[:-1], nan=0.0)
        made = [x, (y[order] - middle[-1]) / spread[-1], n[order].astype(np.float64), held[order].astype(np.float64)]
        return pa.table({c: pa.array([m.tobytes()], pa.binary()) for c, m in zip(("x", "y", "n", "held"), made, strict=True)})

    return run


def _step(theta, layers: list[int], rows: tuple[float, float]):
    def run(batches):
        from pyspark import TaskContext

        total = None
        by = np.append(np.full(len(theta.value) + 1, rows[0]), rows[1])
        for batch in batches:
            for row in batch.to_pylist():
                y, n, held = (np.frombuffer(row[c]) for c in ("y", "n", "held"))
                sums = slopes(theta.value, layers, np.frombuffer(row["x"]).reshape(len(y), -1), y, n, held > 0) / by
                whole = np.rint(np.nan_to_num(np.clip(sums, -LARGEST, LARGEST), nan=LARGEST) * UNIT).astype(np.int64)
                total = whole if total is None else total + whole
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() // FAN_IN]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    return run


def _together(table: pa.Table) -> pa.Table:
    return pa.table({"sums": pa.array([sum(np.frombuffer(s, np.int64) for s in table["sums"].to_pylist()).tobytes()], pa.binary())})


@dataclass
class Perceptron:
    """``fit`` takes a vector column ``features`` and a numeric ``label``."""

    hidden: tuple[int, ...] = (128, 64)
    steps: int = 500
    patience: int = 10
    tolerance: float = 1e-4
    l2: float = 1e-4
    seed: int = 42
    early_stopping: bool = True

    def fit(self, df: DataFrame) -> PerceptronModel:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).filter("y is not null and not isnan(y)")
        ends = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
        if not ends["n"]:
            raise EvaluationError("no rows to learn from")
        width = ends["width"]
        found = quantiles_of(rows, {**{f"x{j}": F.get("x", F.lit(j)) for j in range(width)}, "y": F.col("y")}, _SHARES)
        scales = [scale_of([q[0] for q in v]) for v in found.values()]
        layers = [width, *self.hidden, 1]
        rng = np.random.RandomState(self.seed)
        theta = np.concatenate([np.append(rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(layers[:-1], layers[1:], strict=True)])
        model = PerceptronModel(layers, scales, theta)
        held = (F.pmod(F.xxhash64(F.lit(self.seed), "x", "y"), F.lit(HELD_OUT)) == 0) & F.lit(self.early_stopping)
        whole = rows.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("held", held)
        many = -(-ends["n"] // BLOCK_ROWS)
        blocks = lasting(whole.groupBy(F.pmod(F.xxhash64("x", "y"), F.lit(many)).alias("block")).applyInArrow(_block(scales), "x binary, y binary, n binary, held binary"), "perceptron")
        counts = whole.groupBy("held").agg(F.sum("n").alias("n")).collect()
        sizes = {r["held"]: float(r["n"]) for r in counts}
        if False not in sizes:  # so few rows that all are held out
            return replace(self, early_stopping=False).fit(df)
        self._descend(blocks, model, (sizes[False], sizes.get(True, 1.0)), True in sizes)
        return model

    def _descend(self, blocks: DataFrame, model: PerceptronModel, rows: tuple[float, float], judged: bool) -> None:
        def at(theta: np.ndarray) -> tuple[float, np.ndarray, float]:
            sums = self._sums(blocks, theta, model.layers, rows)
            loss = float(sums[-2] + self.l2 * (theta @ theta) / 2)
            return loss, sums[:-2] + self.l2 * theta, float(sums[-1]) if judged else loss

        theta = model.theta
        loss, slope, held = at(theta)
        best, waited, pairs = held, 0, []
        model.losses.append((loss, held))
        for _ in range(self.steps):
            way = _direction(slope, pairs)
            step, down = (1.0 if pairs else min(1.0, 1 / max(np.abs(slope).sum(), 1e-12))), float(way @ slope)
            for _ in range(20):
                tried = theta + step * way
                now = at(tried)
                if now[0] <= loss + 1e-4 * step * down:
                    break
                step /= 2
            else:
                break
            s, y = tried - theta, now[1] - slope
            if s @ y > 1e-12:
                pairs = [*pairs, (s, y)][-MEMORY:]
            theta, (loss, slope, held) = tried, now
            model.losses.append((loss, held))
            waited = 0 if held < best * (1 - self.tolerance) else waited + 1
            if held < best:
                best, model.theta = held, theta
            if waited >= self.patience:
                break

    @staticmethod
    def _sums(blocks: DataFrame, theta: np.ndarray, layers: list[int], rows: tuple[float, float]) -> np.ndarray:
        sent = blocks.sparkSession.sparkContext.broadcast(theta)  # of the network's size
        try:
            added = blocks.mapInArrow(_step(sent, layers, rows), "part long, sums binary").groupBy("part").applyInArrow(_together, "sums binary").toArrow()
        finally:
            sent.unpersist()
        return sum(np.frombuffer(s, np.int64) for s in added["sums"].to_pylist()) / UNIT


def _direction(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill, by what the last steps tell of the curvature (two loops of L-BFGS)."""
    q, kept = slope.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(kept), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


@dataclass
class PerceptronModel:
    layers: list[int]
    scales: list[tuple[float, float]]
    theta: np.ndarray
    #: Loss of the rows that are learned from, and of those held out, after each step.
    losses: list[tuple[float, float]] = field(default_factory=list)

    def predict(self, values: np.ndarray) -> np.ndarray:
        middle, spread = np.array([s[0] for s in self.scales]), np.array([s[1] for s in self.scales])
        x = np.nan_to_num((values - middle[:-1]) / spread[:-1], nan=0.0)
        return forward(unflatten(self.theta, self.layers), x)[-1][:, 0] * spread[-1] + middle[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def given(x):
            import pandas as pd

            return pd.Series(model.value.predict(np.array(x.tolist(), np.float64).reshape(len(x), -1)) if len(x) else [], dtype=float)

        return df.withColumn("prediction", given(vector_to_array("features")))
