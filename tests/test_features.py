"""Specs, expressions and the compiler."""

import math
import os

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.errors import ExecutionError, ExecutionTimeout, ProposalError, UnsafeExpressionError
from tessera.operators import child, program
from tessera.operators.compile import Compiler, derive, unique
from tessera.operators.exprsafe import check, check_parsed
from tessera.operators.program import check_program, run_program
from tessera.spec import FeatureSpec, parse_specs


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1.0, "x", 1), (4.0, "x", 2), (None, "y", 3), (-2.0, None, 4), (0.0, "y", 2147483647)], "a double, k string, n int")


def values(df, *names):
    return [tuple(r) for r in df.orderBy("n").select(*names).collect()]


def test_group_statistics_skip_null_keys(frame):
    out = derive(frame, FeatureSpec("m", transform="group_mean", base_columns=("k", "a")), FeatureSpec("f", transform="frequency", base_columns=("k",)))
    assert values(out, "m", "f") == [(2.5, 2), (2.5, 2), (0.0, 2), (None, None), (0.0, 2)]


def test_unary_guards(frame):
    out = derive(frame, *[FeatureSpec(op, transform=op, base_columns=("a",)) for op in ("log1p_clipped", "safe_log", "sqrt_clipped", "square")], FeatureSpec("big", transform="scaled", base_columns=("n",), params={"by": 4}))
    rows = values(out, "log1p_clipped", "safe_log", "sqrt_clipped", "square", "big")
    assert rows[2][:4] == (None, None, None, None)
    assert rows[3][0] == 0 and rows[3][2] == 0 and rows[4][1] is None
    assert math.isclose(rows[4][4], 4.0 * 2147483647)


def test_ratio_of_zero(frame):
    out = derive(frame, FeatureSpec("r", transform="safe_ratio", base_columns=("n", "a")))
    assert values(out, "r") == [(1.0,), (0.5,), (None,), (-2.0,), (0.0,)]


def test_flags_bins_and_maps(frame):
    out = derive(
        frame,
        FeatureSpec("b", transform="digitized", base_columns=("a",), params={"bins": [0, 1, 4]}),
        FeatureSpec("p", transform="flag", base_columns=("a",), params={"above": 0.5}),
        FeatureSpec("m", transform="mapped", base_columns=("k",), params={"mapping": {"x": 7}}),
    )
    assert values(out, "b", "p", "m") == [(2, 1, 7), (3, 1, 7), (None, 0, -1), (0, 0, -1), (1, 0, -1)]


def test_existing_columns_and_first_names_win(frame):
    done = Compiler().transform(frame, [FeatureSpec("a", transform="square", base_columns=("n",)), FeatureSpec("z", transform="square", base_columns=("a",)), FeatureSpec("z", transform="absolute", base_columns=("a",)), FeatureSpec("gone", transform="square", base_columns=("nowhere",))])
    assert done.frame.columns == ["a", "k", "n", "z"]
    assert set(done.failures) == {"gone"}
    assert values(done.frame, "z")[1] == (16.0,)


def test_equal_features_are_computed_once():
    a, b = FeatureSpec("a", transform="square", base_columns=("x",)), FeatureSpec("b", transform="square", base_columns=("x",))
    assert unique([a, b]) == [a]


def test_chains_and_fitted_state(spark, frame):
    specs = [FeatureSpec("c", transform="combined", base_columns=("k", "k")), FeatureSpec("f", transform="frequency", base_columns=("c",)), FeatureSpec("z", transform="zscore", base_columns=("a",))]
    states = Compiler().fit(frame, specs)
    new = spark.createDataFrame([(1.0, "x", 1), (2.0, "q", 2)], "a double, k string, n int")
    out = Compiler().transform(new, specs, states).frame
    assert [r.f for r in out.orderBy("n").collect()] == [2, None]
    mean, std = 0.75, 2.5
    assert math.isclose(out.orderBy("n").first().z, (1 - mean) / (std + 1e-8))


def test_ranks_equal_a_plain_window(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(40)], "i int, v double")
    out = derive(df, FeatureSpec("r", transform="percent_rank_average", base_columns=("v",))).toPandas()
    assert (out.r - out.v.rank(pct=True)).abs().max() < 1e-12


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=12))
def test_rows_and_columns_are_kept(spark, numbers):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double")
    out = derive(df, FeatureSpec("q", transform="quantile_bin", base_columns=("v",)), FeatureSpec("s", transform="signed_log", base_columns=("v",)))
    assert out.count() == len(numbers) and out.columns == ["i", "v", "q", "s"]


def test_parsing_answers():
    listed = '[{"base_columns": "a", "derived_features": [{"name": "x", "transform": "log"}, 3]}, 5]'
    for text in (listed, f"```json\n{listed}\n```", f"Sure: {listed} ok", '{"features": ' + listed + "}"):
        (only,) = parse_specs(text, "unary")
        assert (only.name, only.base_columns, only.agent_name, only.type) == ("x", ("a",), "unary", "numerical")
    for bad in ("nothing", "[1, 2", '{"features": 3}'):
        with pytest.raises(ProposalError):
            parse_specs(bad)
    spec = FeatureSpec("x", transform="clip", base_columns=("a",), params={"low": 0})
    assert FeatureSpec.from_json(spec.to_json()) == spec


@pytest.mark.parametrize("text", ["a + b * 2", "CASE WHEN a > 1 THEN 'x(' ELSE `odd name` END", "avg(a) OVER (PARTITION BY k)", "try_cast(k AS DOUBLE)"])
def test_allowed_expressions(text):
    assert check(text) == text


@pytest.mark.parametrize("text", ["reflect('java.lang.System', 'exit')", "java_method('a', 'b')", "(SELECT 1)", "rand()", "uuid()", "current_date", "explode(a)", "a; b", "input_file_name()", "", "x.y.f(1)", "`java_method`('java.lang.Math', 'abs', -3)", "`a`.`b`(1)", "a.`reflect`(1)", "`rand` ()"])
def test_refused_expressions(text):
    with pytest.raises(UnsafeExpressionError):
        check(text)


@pytest.mark.parametrize("text", ["java_method/**/('java.lang.Math', 'abs', -3)", "x.y.f(1)", "`java_method`('a', 'b', 1)", "`reflect` ('a', 'b')", "a IN (SELECT 1)", "EXISTS (SELECT 1)", "(SELECT 1)", "transform(a, x -> x)", "sum(a) OVER named", "a AS b", "*", "count(a) FILTER (WHERE uuid() > 'a')", "system.builtin.abs(a)"])
def test_parsed_trees_refuse_whatever_is_written(spark, text):
    with pytest.raises(UnsafeExpressionError):
        check_parsed(spark, text)


@pytest.mark.parametrize("text", ["-a + b % 2 <=> 3.5", "CASE a WHEN 1 THEN 'x' ELSE `odd name` END", "k LIKE 'a%' AND NOT a BETWEEN 1 AND 2 OR k IN ('a', 'b')", "avg(a) OVER (PARTITION BY k ORDER BY b DESC ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "try_cast(k AS DOUBLE) IS NOT NULL", "k || 'x'", "d - INTERVAL 3 DAYS", "x[0] + s.f", "a IS TRUE", "count(*) OVER (PARTITION BY k)", "count(DISTINCT a)"])
def test_parsed_trees_of_allowed_expressions(spark, text):
    assert check_parsed(spark, text) == text


@pytest.mark.parametrize("body", ["import os", "from sys import path", "open('x')", "df.to_csv('x')", "pd.read_csv('x')", "().__class__", "eval('1')", "pd.io.common.os.system('id')", "df.eval('a')", "df.query('a > 1')", "df.to_pickle('x')", "pd.DataFrame.from_records([])", "import pandas.io", "from pandas import io", "f = getattr", "df.apply(print)", "print(1)", "df.pipe(len)", "df.agg('to_csv')", "f = 'to_csv'; df.agg(f)", "df.agg('to_' + 'csv')", "class A: pass", "breakpoint()", "pd.core", "df._mgr", "global x"])
def test_refused_programs(body):
    with pytest.raises(UnsafeExpressionError):
        check_program(f"import pandas as pd\ndef generate_features(df):\n    {body}\n    return df\n")
    with pytest.raises(UnsafeExpressionError):
        check_program("x = 1")


def test_program_sees_the_whole_table(spark, frame):
    code = "def generate_features(df):\n    return df[['n']].assign(total=df['a'].sum())[['total']]\n"
    out = run_program(spark, frame, code, "total double", "n")
    assert {r.total for r in out.collect()} == {3.0} and out.count() == 5
    with pytest.raises(ExecutionError):
        run_program(spark, frame, code, "total double", "n", rows_limit=2)
    with pytest.raises(ExecutionError):
        run_program(spark, frame, "def generate_features(df):\n    return df.head(1)\n", "total double", "n", timeout_s=60)


def test_allowed_programs():
    code = "import numpy as np\nfrom math import sqrt\ndef generate_features(df):\n    g = df.groupby('k')['a'].transform('mean')\n    return df.assign(x=np.log1p(df.price.clip(lower=0)) + g, y=[sqrt(abs(v)) for v in df['a']])[['x', 'y']]\n"
    check_program(code, columns=["k", "a", "price"])
    with pytest.raises(UnsafeExpressionError):
        check_program(code)


def test_programs_are_bounded(spark, frame):
    head = "import numpy as np\ndef generate_features(df):\n"
    slow = head + "    n = 0\n    while True:\n        n = n + 1\n    return df\n"
    with pytest.raises(ExecutionTimeout):
        run_program(spark, frame, slow, "x double", "n", timeout_s=1)
    large = head + "    big = np.ones(400000000)\n    return df.assign(x=big[0])[['x']]\n"
    with pytest.raises(ExecutionError):
        run_program(spark, frame, large, "x double", "n", timeout_s=20, memory_mb=256)
    small = head + "    return df.assign(x=np.ones(5))[['x']]\n"
    assert run_program(spark, frame, small, "x double", "n", timeout_s=20, memory_mb=256).count() == 5
    hidden = "def generate_features(df):\n    import os\n    return df\n"
    with pytest.raises(UnsafeExpressionError):
        run_program(spark, frame, hidden, "x double", "n")
    with pytest.raises(ImportError):
        child.importer(program.MODULES)("os")


def probe(body, monkeypatch, tmp_path):
    """Runs an unchecked program with all built-in functions in a child."""
    import builtins

    monkeypatch.chdir(tmp_path)
    code = "def generate_features(df):\n" + "".join(f"    {line}\n" for line in body.splitlines()) + "    return df\n"
    with child.Child(code, dir(builtins), ("math", "socket", "os", "subprocess"), 5, 512) as held:
        return held.run(pd.DataFrame({"n": [1, 2]}))


@pytest.mark.parametrize("body", ["df.to_csv('x.csv')", "open('y', 'w')", "open('/etc/passwd')", "import socket\nsocket.socket()", "import os\nos.fork()", "import subprocess\nsubprocess.run(['id'])", "import os\nos.mkfifo('z')\nopen('z')", "import os\nos._exit(3)", "x = bytearray(1 << 31)"])
def test_children_have_no_files_sockets_or_children(body, monkeypatch, tmp_path):
    """What no check has seen still does nothing outside its process; privileged users may fork, the child of which can open nothing."""
    if "fork" in body and os.geteuid() == 0:
        pytest.skip("limits on processes don't bind the superuser")
    with pytest.raises(RuntimeError):
        probe(body, monkeypatch, tmp_path)
    assert not [p for p in tmp_path.iterdir() if p.is_file()]


def test_children_are_killed_and_see_no_environment(monkeypatch, tmp_path):
    monkeypatch.setenv("SECRET_OF_PARENT", "1")
    with pytest.raises(RuntimeError, match="KeyError"):
        probe("import os\nos.environ['SECRET_OF_PARENT']", monkeypatch, tmp_path)
    with pytest.raises(TimeoutError):
        probe("while True:\n    try:\n        while True: pass\n    except BaseException: pass", monkeypatch, tmp_path)
    assert len(probe("pass", monkeypatch, tmp_path)) == 2


def test_one_child_serves_the_batches_of_a_task(spark, frame):
    code = "def generate_features(df):\n    return df.assign(x=df['n'] * 2.0)[['x']]\n"
    assert [r.x for r in run_program(spark, frame, code, "x double", "n", row_local=True).orderBy("n").collect()] == [2.0 * r.n for r in frame.orderBy("n").collect()]


def test_outputs_have_the_declared_types(spark, frame):
    code = "def generate_features(df):\n    return df.assign(o=['1', 'x', None, '2.5', '7'], t=[1, None, 'b', 2, 3], b=[True] * 5, spare=0)\n"
    rows = run_program(spark, frame, code, "o double, t string, b boolean", "n").orderBy("n").collect()
    assert [r.o for r in rows] == [1.0, None, None, 2.5, 7.0] or [r.o != r.o or r.o is None for r in rows] == [False, True, True, False, False]
    assert [r.t is None for r in rows] == [False, True, False, False, False] and all(r.b for r in rows) and "spare" not in rows[0]
    with pytest.raises(ExecutionError):
        run_program(spark, frame, code, "missing double", "n", timeout_s=60)


@pytest.mark.parametrize("body", ["f = df.agg; f('to_csv', 0, 'x')", "list(map(df.agg, ['to_dict']))", "f = [df.transform][0]"])
def test_calls_by_name_have_no_other_name(body):
    with pytest.raises(UnsafeExpressionError):
        check_program(f"def generate_features(df):\n    {body}\n    return df\n")


@pytest.mark.parametrize("text", ["java_method/**/('java.lang.Math','abs',-3)", "a /* x */ + 1", "a --b", "1 -- x"])
def test_expressions_have_no_comments(text):
    with pytest.raises(UnsafeExpressionError):
        check(text)
    assert check("a / b * -c - (-d)") and check("concat(a, '/* -- */')")
