"""The process in which feature programs run: a child of a Python worker that speaks Arrow over its own pipes.

The child opens what it needs, then gives up what a program could misuse: no file grows (``RLIMIT_FSIZE``), no descriptor is
opened any more, so no file and no socket (``RLIMIT_NOFILE``), no core is dumped, no process is started, and memory is bounded. Its environment is
empty, and it is killed at its deadline, whatever it does.
"""

from __future__ import annotations

import builtins
import os
import resource
import signal
import struct
import subprocess
import sys
import threading
from collections.abc import Callable
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa

#: Seconds that a child may take to start and to load pandas, besides the program's own time.
LOAD_S = 30.0


def send(out: BinaryIO, payload: bytes) -> None:
    out.write(struct.pack("<q", len(payload)))
    out.write(payload)
    out.flush()


def receive(source: BinaryIO) -> bytes | None:
    head = source.read(8)
    if len(head) < 8:
        return None
    (size,) = struct.unpack("<q", head)
    payload = source.read(size)
    return payload if len(payload) == size else None


def packed(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(payload).read_all().to_pandas()


def _warm() -> None:
    """Uses what programs use, so that pandas opens none of its modules later."""
    pa.set_cpu_count(1)  # no threads later
    f = pd.DataFrame({"k": ["a", "b", None], "x": [1.0, 2.0, np.nan], "t": pd.to_datetime(["2020-01-01", "2021-02-03", None])})
    g = f.groupby("k")
    g["x"].agg(["mean", "std", "median", "count", "nunique"]), g["x"].rank(), g["x"].transform("mean"), g["x"].cumsum(), g["x"].shift(), g.ngroup()
    f.merge(f, on="k"), f.pivot_table(index="k", values="x"), pd.get_dummies(f["k"]), pd.cut(f["x"], 2), pd.qcut(f["x"], 2, duplicates="drop")
    f["k"].str.upper().str.extract("(A)"), f["t"].dt.isocalendar(), f["t"].dt.month, f["x"].rolling(2).mean(), f["x"].expanding().sum(), f["x"].ewm(1).mean()
    f["x"].quantile(0.5), f["x"].skew(), f.corr(numeric_only=True), pd.to_numeric(f["k"], errors="coerce"), pd.to_timedelta(["1D"]), f.describe(), f.melt(), f.astype({"k": "category"})["k"].cat.codes
    f.sort_values("x").drop_duplicates().value_counts(), pd.concat([f, f], axis=1), pd.date_range("2020-01-01", periods=2), np.linalg.norm(np.ones(2)), np.nanmedian([1.0]), np.percentile([1.0], 50)
    unpacked(packed(f.assign(b=True, n=1, o=["1", None, "x"]))), f[[]].assign(x=1).map(_plain)
    try:
        f["x"].map({1: "a"}).astype(float), f["k"].astype(float)
    except ValueError as err:
        repr(err)


def _close_doors(memory_mb: int) -> None:
    resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
    signal.signal(signal.SIGXFSZ, signal.SIG_IGN)
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    if memory_mb:
        with open("/proc/self/statm", encoding="ascii") as source:
            most = int(source.read().split()[0]) * resource.getpagesize() + (memory_mb << 20)
        hard = resource.getrlimit(resource.RLIMIT_AS)[1]
        most = most if hard == resource.RLIM_INFINITY else min(most, hard)
        resource.setrlimit(resource.RLIMIT_AS, (most, most))
    for fd in range(3, 256):  # whatever came along
        try:
            os.close(fd)
        except OSError:
            continue
    resource.setrlimit(resource.RLIMIT_NOFILE, (0, 0))
    resource.setrlimit(resource.RLIMIT_NPROC, (0, 0))


def importer(modules: tuple[str, ...]) -> Callable[..., Any]:
    """An ``__import__`` of the listed modules alone."""

    def load(name: str, space: Any = None, inside: Any = None, names: tuple = (), level: int = 0) -> Any:
        if level or name not in modules:
            raise ImportError(f"{name} can't be imported")
        return __import__(name, None, None, list(names or ()), 0)

    return load


def serve(code: str, allowed: list[str], modules: tuple[str, ...], memory_mb: int) -> None:
    """Answers each frame on standard input with what ``generate_features`` makes of it, or with an error's text."""
    import warnings

    warnings.simplefilter("ignore")
    source, out = sys.stdin.buffer, sys.stdout.buffer
    sys.stdout = sys.stderr
    _warm()
    for name in modules:
        __import__(name)
    send(out, b"ready")
    _close_doors(memory_mb)
    space: dict = {"__builtins__": {n: getattr(builtins, n) for n in allowed} | {"__import__": importer(modules)}}
    while (payload := receive(source)) is not None:
        try:
            if "generate_features" not in space:
                exec(compile(code, "<features>", "exec"), space)  # noqa: S102  checked by the parent
            frame = unpacked(payload)
            made = space["generate_features"](frame.copy())
            if not isinstance(made, pd.DataFrame) or len(made) != len(frame):
                raise ValueError("generate_features must return a frame with a row for each row")
            answer = b"+" + packed(made.reset_index(drop=True).map(_plain) if any(made.dtypes == object) else made.reset_index(drop=True))
        except BaseException as err:  # noqa: BLE001  told to the parent
            answer = b"-" + f"{type(err).__name__}: {err}".encode()
        send(out, answer)


def _plain(value: Any) -> Any:
    """Objects as texts, so that columns of mixed kinds can be sent; missing ones stay missing."""
    return None if value is None or value is pd.NaT or isinstance(value, float) and value != value else str(value)


class Child:
    """A child that holds one program; ``close`` ends it."""

    def __init__(self, code: str, allowed: list[str], modules: tuple[str, ...], timeout_s: float | None, memory_mb: int | None):
        self.timeout_s = timeout_s
        start = f"import sys; sys.path[:] = {sys.path!r}; from tessera.operators.child import serve; serve({code!r}, {allowed!r}, {modules!r}, {memory_mb or 0})"
        threads = {f"{lib}_NUM_THREADS": "1" for lib in ("OMP", "OPENBLAS", "MKL")}
        self.process = subprocess.Popen([sys.executable, "-c", start], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=threads, close_fds=True, start_new_session=True)  # noqa: S603
        self._within(LOAD_S, lambda: receive(self.process.stdout))

    def _within(self, seconds: float | None, step: Callable[[], bytes | None]) -> bytes:
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.process.kill()

        timer = threading.Timer(seconds, stop) if seconds is not None else None
        if timer:
            timer.start()
        try:
            answer = step()
        except BrokenPipeError:
            answer = None
        finally:
            if timer:
                timer.cancel()
        if late.is_set():
            raise TimeoutError(f"no result after {seconds} s")
        if answer is None:
            raise RuntimeError(f"the program's process ended with {self.process.wait(10)}")
        return answer

    def run(self, frame: pd.DataFrame) -> pd.DataFrame:
        def step() -> bytes | None:
            send(self.process.stdin, packed(frame))
            return receive(self.process.stdout)

        answer = self._within(self.timeout_s, step)
        if answer[:1] == b"-":
            raise RuntimeError(answer[1:].decode())
        return unpacked(answer[1:])

    def close(self) -> None:
        self.process.kill()
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            try:
                pipe.close()
            except BrokenPipeError:
                continue

    def __enter__(self) -> Child:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()
