"""Helpers that the operators of this subpackage share: durable intermediate tables and vectorised text hashing."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine, where it is unset, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path.rstrip("/")


#: Records in an Arrow batch while tables are written: texts can be long, and a batch is in memory several times over.
BATCH_RECORDS = 400


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds Arrow batches while a job of ours runs; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before) if int(before) > 0 else BATCH_RECORDS, BATCH_RECORDS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written once to the shared folder and read back: lineage is cut and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.base}/{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        """Removes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for tag in tags:
            target = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more, now instead of when the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator's own output columns would clash with (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of a plan's own that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


# --- hashing of whole Arrow batches -------------------------------------------------------------------------------

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x + _C1
    x ^= x >> _S30
    x *= _C2
    x ^= x >> _S27
    x *= _C3
    x ^= x >> _S31
    return x


_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of the rolling base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 19)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


BYTE_HASH = mix64(np.arange(256, dtype=np.uint64))
_fold = np.arange(256)
_fold[65:91] += 32
#: Hash of a byte with A-Z read as a-z.
FOLDED_HASH = BYTE_HASH[_fold]
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, of one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bytes of letters, digits and all that isn't ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(buf: np.ndarray, off: np.ndarray, table: np.ndarray = FOLDED_HASH, within: np.ndarray = IN_WORD, unspaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes ``within``, by default all but ASCII white space) of rows: their hashes, starts, ends and rows.

    With ``unspaced``, each character from U+3000 to U+9FFF (kana, Han) is a word of its own.
    """
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = within[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    if unspaced:
        lone = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9))
        before[lone] = False
        before[lone[lone + 3 < n] + 3] = False
    begins = inside & ~before
    start = np.flatnonzero(begins)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    after[:-1] &= ~begins[1:]
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[buf] * up[:n], out=total[1:])
    return mix64((total[end] - total[start]) * down[start]), start, end, np.searchsorted(off, start, "right") - 1


def pack(values: np.ndarray) -> bytes:
    """Zstandard over byte planes: high bytes that hardly change take no room."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
