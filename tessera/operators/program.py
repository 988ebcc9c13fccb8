"""Whole-table feature programs: ``generate_features(df) -> DataFrame`` in pandas, for what expressions can't say.

A program sees all rows at once, so it runs in one task; ``rows_limit`` refuses tables that one task can't hold. Where the
program is row-local, ``row_local=True`` runs it batch by batch on all partitions.

A program may only use what is listed here: modules, attributes, and built-in functions. It is checked before it runs, and runs
with no other built-in functions in a process of its own beside the Python worker (``tessera.operators.child``): one for each
task, without files, sockets and children, whose address space may grow by ``memory_mb`` and which is killed after ``timeout_s``.
"""

from __future__ import annotations

import ast
import threading
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.errors import ExecutionError, ExecutionTimeout, UnsafeExpressionError
from tessera.operators.child import Child
from tessera.session import lasting

#: What a program can import.
MODULES = ("math", "numpy", "pandas")
#: Built-in functions and types of a program.
BUILTINS = """abs all any bool dict divmod enumerate filter float frozenset int isinstance len list map max min pow range reversed
round set slice sorted str sum tuple zip True False None ArithmeticError Exception IndexError KeyError TypeError ValueError
ZeroDivisionError""".split()
#: Attributes of frames, columns, groups, texts, dates and the modules: arithmetic, statistics and shapes, and nothing that reads,
#: writes, evaluates text or leads to another module.
ATTRIBUTES = frozenset(
    """DataFrame Series Categorical Timedelta Timestamp NaT NA abs add agg aggregate all any arange arctan2 argmax argmin argsort
    array asarray assign astype bfill between bool_ cat ceil clip codes columns concat contains copy corr cos count cumcount cummax
    cummin cumprod cumsum cut date date_range day dayofweek dayofyear days diff digitize div dot drop drop_duplicates dropna dt
    dtype dtypes duplicated endswith e empty eq exp expanding expm1 extract factorize ffill fillna finite first float64 floor
    floordiv from_dict full ge get get_dummies groupby gt head hour hypot idxmax idxmin iloc index inf int64 isfinite isin isinf isna
    isnan isnull items join kurt last le len linspace loc log log10 log1p log2 logical_and logical_not logical_or lower lstrip lt
    mask max mean median melt merge min minute mod mode month mul nan nan_to_num nanmax nanmean nanmedian nanmin nanstd nansum ndim
    ne ngroup normalize notna notnull nunique ones ones_like percentile pct_change pi pow prod qcut quantile quarter
    rank ravel reindex rename repeat replace reset_index reshape roll rolling round rpow rsub rstrip second select select_dtypes
    sem set_index shape shift sign sin size skew sort_index sort_values sqrt square startswith std str strip sub subtract sum
    tail tan tanh tile time to_datetime to_frame to_numeric to_timedelta total_seconds transform truncate unique upper value_counts
    values var where year zeros zeros_like""".split()
)

#: Attributes that call others by name.
BY_NAME = ("agg", "aggregate", "transform")
#: Seconds that Spark may take besides the program, before its jobs are cancelled.
START_S = 30.0


def check_program(code: str, function: str = "generate_features", columns: Iterable[str] = ()) -> ast.Module:
    """The parsed program, if it defines the function and uses only what is allowed; ``columns`` may be named as attributes too."""
    try:
        tree = ast.parse(code)
    except SyntaxError as err:
        raise UnsafeExpressionError(f"syntax: {err}") from err
    if not any(isinstance(n, ast.FunctionDef) and n.name == function for n in tree.body):
        raise UnsafeExpressionError(f"no function {function}")
    own = {c for c in columns if not hasattr(pd.DataFrame, c) and not c.startswith("_")}
    made = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    made |= {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)} | {(a.asname or a.name) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for node in ast.walk(tree):
        bad: list[str] = []
        if isinstance(node, ast.Attribute) and node.attr in BY_NAME and id(node) not in called:
            bad = [f"{node.attr} without a call"]  # under another name its texts couldn't be read here
        elif isinstance(node, ast.Import):
            bad = [a.name for a in node.names if a.name not in MODULES]
        elif isinstance(node, ast.ImportFrom):
            bad = [f"{node.module}.{a.name}" for a in node.names if node.level or node.module not in MODULES or a.name not in ATTRIBUTES]
        elif isinstance(node, ast.Name):
            bad = [node.id] if node.id.startswith("__") or node.id not in made and node.id not in BUILTINS else []
        elif isinstance(node, ast.Attribute):
            bad = [node.attr] if node.attr not in ATTRIBUTES | own else []
        elif isinstance(node, (ast.Global, ast.Nonlocal, ast.ClassDef, ast.AsyncFunctionDef, ast.Await)):
            bad = [type(node).__name__.lower()]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in BY_NAME:
            # these call what a text names, so texts must stand there plainly, and name what is allowed
            parts = [x for a in [*node.args, *[k.value for k in node.keywords]] for x in ([a] if isinstance(a, ast.Lambda) else ast.walk(a))]
            bad = [type(x).__name__ for x in parts if not isinstance(x, (ast.Lambda, ast.Constant, ast.Dict, ast.List, ast.Tuple, ast.Load))]
            bad += [x.value for x in parts if isinstance(x, ast.Constant) and isinstance(x.value, str) and x.value not in ATTRIBUTES and (hasattr(pd.DataFrame, x.value) or hasattr(pd.Series, x.value))]
        if bad:
            raise UnsafeExpressionError(f"not allowed: {', '.join(bad)}")
    return tree


def declared(frame: pd.DataFrame, fields: list[T.StructField]) -> pd.DataFrame:
    """The columns that ``fields`` declare: texts as texts, all others as Arrow converts them; a column that is missing is an error."""
    lost = [f.name for f in fields if f.name not in frame.columns]
    if lost:
        raise ValueError(f"generate_features made no column {', '.join(lost)}")
    out = {f.name: frame[f.name] for f in fields}
    for f in fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = out[f.name].astype(object).where(frame[f.name].notna(), None).map(str, na_action="ignore")
        elif isinstance(f.dataType, T.NumericType) and not pd.api.types.is_numeric_dtype(out[f.name]):
            out[f.name] = pd.to_numeric(out[f.name].astype(object), errors="coerce")  # as try_cast
    return pd.DataFrame(out, index=frame.index)


def run_program(
    spark: SparkSession, df: DataFrame, code: str, schema: T.StructType | str, row_id: str, row_local: bool = False, rows_limit: int = 5_000_000, timeout_s: float | None = None, memory_mb: int | None = None
) -> DataFrame:
    """``row_id`` and the columns of ``schema`` that the program makes.

    With ``timeout_s`` the program runs at once, its jobs are cancelled after that time, and the result is read from where it
    was written; without, the result is lazy.
    """
    check_program(code, columns=df.columns)
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    whole = T.StructType([df.schema[row_id], *[f for f in fields if f.name != row_id]])

    def finished(made: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        made = declared(made, [f for f in fields if f.name != row_id])
        made.insert(0, row_id, pdf[row_id].values)
        return made

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Child(code, BUILTINS, MODULES, timeout_s, memory_mb) as child:
            for pdf in parts:
                yield finished(child.run(pdf), pdf)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(batches(iter([pdf])))

    if row_local:
        out = df.mapInPandas(batches, whole)
    else:
        if df.limit(rows_limit + 1).count() > rows_limit:
            raise ExecutionError(f"more than {rows_limit} rows for a whole-table program")
        out = df.groupBy().applyInPandas(call, whole)
    if timeout_s is None:
        return out
    group = f"tessera-program-{threading.get_ident()}"
    done: dict = {}

    def work():
        spark.sparkContext.setJobGroup(group, "feature program", True)
        try:
            done["frame"] = lasting(out, "program")
        except Exception as err:  # noqa: BLE001  told to the caller below
            done["error"] = err

    thread = InheritableThread(target=work)
    thread.start()
    thread.join(timeout_s + START_S)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join(30)
        raise ExecutionTimeout(f"no result after {timeout_s} s")
    if "error" in done:
        kind = ExecutionTimeout if "TimeoutError: no result after" in str(done["error"]) else ExecutionError
        raise kind(str(done["error"]).splitlines()[0]) from done["error"]
    return done["frame"]
