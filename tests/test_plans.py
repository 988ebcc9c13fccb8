"""Settings, clients, routers, memory, engine, methods."""

import json

import numpy as np
import pandas as pd
import pytest

from tessera.errors import ClientError, ConfigurationError, ExecutionError, PlanError
from tessera.operators.compile import Compiler
from tessera.plans.client import CachedClient, ScriptedClient, with_retries
from tessera.plans.engine import Engine
from tessera.plans.estimator import FeatureEngineer, FeatureModel
from tessera.plans.evaluate import Evaluator
from tessera.plans.memory import Memory
from tessera.plans.methods import ClientMethod, ExpansionMethod, MethodRegistry
from tessera.plans.proposers import AGENTS, Context, ProposerRegistry, RuleProposer, expansion
from tessera.plans.router import Router
from tessera.settings import ClientSettings, EvaluationSettings, RetrySettings, RouterSettings, load_settings
from tessera.sources.dataset import TableSpec
from tessera.spec import FeatureSpec

TABLE = TableSpec("id", "y")
DESCRIPTION = {"a": {"type": "numerical"}, "b": {"type": "numerical"}, "k": {"type": "categorical"}, "t": {"type": "datetime"}}


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=100), rng.normal(size=100)
    return spark.createDataFrame(pd.DataFrame({"id": range(100), "a": a, "b": b, "k": np.where(a > 0, "p", "q"), "y": (np.abs(a) > 0.7).astype(int)})).cache()


def engine(**kw):
    return Engine(load_settings(environ={}, model="linear", n_rounds=1, evaluation={"cv_folds": 2, "max_candidate_features": 4}), **kw)


def test_settings_order(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"metric": "acc", "n_rounds": 2, "router": {"min_agents": 2}}))
    s = load_settings(str(path), {"TESSERA_N_ROUNDS": "3", "TESSERA_ROUTER__STRATEGY": "data_driven"}, metric="f1")
    assert (s.metric, s.n_rounds, s.router.min_agents, s.router.strategy) == ("f1", 3, 2, "data_driven")
    for bad in ({"metric": "x"}, {"n_rounds": 0}, {"evaluation": {"cv_folds": 1}}, {"client": {"temperature": 3}}, {"nope": 1}, {"evaluation": {"test_size": 1.0}}):
        with pytest.raises(ConfigurationError):
            load_settings(environ={}, **bad)


def test_clients():
    inner, waits = ScriptedClient(["{}", "[1]"]), []
    c = CachedClient(inner)
    assert c.complete([{"role": "user", "content": "x"}]) == "{}" == c.complete([{"role": "user", "content": "x"}])
    assert len(inner.asked) == 1 and c.complete_json([{"role": "user", "content": "y"}]) == [1]

    def broken():
        raise OSError("down")

    with pytest.raises(ClientError):
        with_retries(broken, RetrySettings(max_retries=3, base_delay_s=1, max_delay_s=3), waits.append)
    assert waits == [1, 2, 3]


def test_prompts(tmp_path):
    from tessera.plans.prompts import IterationParams, PromptRegistry

    (tmp_path / "p.json").write_text('{"system": "You do $task.", "user": "$what"}')
    (tmp_path / "empty.json").write_text('{"system": " "}')
    r = PromptRegistry(str(tmp_path))
    assert r.get("p").render(task="x", what="y")[1]["content"] == "y" and r.get("p") is r.get("p")
    with pytest.raises(ConfigurationError):
        r.get("p").render(task="x")
    with pytest.raises(ConfigurationError):
        r.get("empty")
    with pytest.raises(KeyError):
        r.get("nope")
    with pytest.raises(ConfigurationError):
        IterationParams(3, 2)


def test_traced_calls_return_and_raise(spark):
    from tessera.observability import configure_logging, traced

    configure_logging("WARNING")
    assert traced("tool")(lambda x: x + 1)(1) == 2
    with pytest.raises(ZeroDivisionError):
        traced("agent", "broken")(lambda: 1 / 0)()


def test_router():
    r = Router(RouterSettings(strategy="data_driven", warmup_rounds=1))
    assert r.select(0, {}) == list(AGENTS)
    assert r.select(1, DESCRIPTION) == ["unary", "cross_compositional", "aggregation", "temporal", "local_transform"]
    p = Router(RouterSettings(strategy="performance_driven", warmup_rounds=0, min_agents=1, max_agents=2))
    assert p.select(0, DESCRIPTION) == ["unary", "cross_compositional"]
    p.update("temporal", 0.5)
    p.update("unary", -0.5)
    assert p.select(1, DESCRIPTION) == ["temporal"]
    for _ in range(20):
        p.update("unary", 1.0)
    assert len(p.history["unary"]) == 10
    h = Router(RouterSettings(strategy="hybrid", warmup_rounds=0))
    assert h.select(0, DESCRIPTION) == ["unary", "cross_compositional", "aggregation", "temporal", "local_transform", "local_pattern"]
    a = Router(RouterSettings(strategy="llm", warmup_rounds=0, max_agents=1), client=ScriptedClient(["temporal and unary"]))
    assert a.select(0, DESCRIPTION) == ["unary"]


def test_memory(tmp_path, spark):
    m = Memory()
    good, bad = FeatureSpec("g", transform="log", base_columns=("b", "a")), FeatureSpec("n", transform="log", base_columns=("a",))
    m.record(good, 0.5, "auc", "unary")
    m.record(good, 0.9, "auc", "unary")
    m.record(bad, 0.0, "auc", "unary")
    assert m.positive() == ["g"] and m.negative("unary") == ["n"] and m.top() == ["g → auc: 0.5000 (rank 1)"]
    assert m.stats() == {"transforms": {"log": 1}, "fields": {"a-b": 1}, "types": {"numerical": 1}} and m.stats(2)["types"] == {}
    for i in range(30):
        m.summarise_round(str(i))
    m.summarise("unary")
    m.save(str(tmp_path / "m.json"))
    again = Memory.load(str(tmp_path / "m.json"))
    assert again.feedback == m.feedback and len(again.summaries) == 20 and Memory.load(str(tmp_path / "none.json")).feedback == {}
    assert m.to_frame(spark).count() == 2


def test_rules_propose_fitting_specs():
    for name in AGENTS:
        specs = RuleProposer(name).propose(Context(DESCRIPTION))
        assert specs and all(s.agent_name == name and set(s.base_columns) <= set(DESCRIPTION) for s in specs)
    assert RuleProposer("temporal").propose(Context({"a": {"type": "numerical"}})) == []
    assert len({s.transform for s in expansion(["a", "b"], ["k", "j"])}) == 8 + 6 + 6 + 1 + 1


def test_engine_finds_the_signal(frame):
    done = engine(mode="single_agent").run(frame, TABLE)
    assert done.selected and any(g["gain"] for r in done.rounds for g in r.gains)
    assert done.rounds[0].summary()["num_features_selected"] == len(done.rounds[0].selected)


def test_engine_survives_broken_agents(frame):
    class Broken:
        name = "unary"

        def propose(self, context):
            raise RuntimeError("no")

    registry = ProposerRegistry()
    with pytest.warns(UserWarning):
        registry.register(Broken())
    done = engine(mode="single_agent", proposers=registry).run(frame, TABLE)
    assert done.selected == [] and done.rounds[0].failures == {"unary": "no"} and done.rounds[0].baseline == 0.0


def test_estimator_round_trip(frame, tmp_path):
    stage = FeatureEngineer(row_id="id", target="y")
    stage.engine = engine(mode="single_agent")
    model = stage.fit(frame)
    out = model.transform(frame)
    assert out.columns == model.get_feature_names_out(frame.columns)
    model.write().overwrite().save(str(tmp_path / "model"))
    assert FeatureModel.load(str(tmp_path / "model")).transform(frame).columns == out.columns
    with pytest.raises(ConfigurationError):
        FeatureEngineer().fit(frame)


def test_expression_method_keeps_what_gains(frame):
    client = ScriptedClient(['[{"name": "abs_a", "code": "abs(a)"}, {"name": "bad", "code": "reflect(a)"}]', "no json"])
    method = ClientMethod(client=client, evaluator=Evaluator(model="linear", folds=2), max_iterations=2)
    with pytest.raises(PlanError):
        method.transform(frame)
    method.fit(frame, TABLE)
    assert [s.name for s in method.specs] == ["abs_a"] and method.new_columns(frame).columns == ["abs_a"]
    assert "abs_a" in client.asked[1][1]["content"] and method.iterations[1]["error"]


def test_expansion_method(frame):
    method = ExpansionMethod(n_features=2, screen_to=10).fit(frame, TABLE)
    assert set(method.importances) and {"absolute_a", "square_a"} & {s.name for s in method.specs}
    assert MethodRegistry(None).names() == ["evolving", "expansion", "expressions", "feedback", "rounds"]


def test_fitted_statistics(spark, tmp_path):
    specs = [FeatureSpec("z", transform="zscore", base_columns=("a",)), FeatureSpec("m", transform="group_mean", base_columns=("k", "a")), FeatureSpec("q", transform="above_quantile", base_columns=("a",)), FeatureSpec("zm", transform="zscore", base_columns=("m",))]
    train = spark.createDataFrame([(float(i), "xy"[i % 2]) for i in range(10)], "a double, k string")
    whole = {r.a: r for r in Compiler().transform(train, specs).frame.collect()}
    model = FeatureModel(specs, Compiler().fit(train, specs))
    model.write().overwrite().save(str(tmp_path / "model"))
    for own in (model, FeatureModel.load(str(tmp_path / "model"))):
        (row,) = own.transform(train.filter("a = 7")).collect()
        assert row == whole[7.0]
        (new,) = own.transform(spark.createDataFrame([(7.0, "new")], "a double, k string")).collect()
        assert new.z == row.z and new.q == row.q and new.m is None and own.failures == {}
    (alone,) = FeatureModel(specs).transform(train.filter("a = 7")).collect()
    assert alone.m == 7.0 != row.m


def test_programs_are_asked_for_again(spark):
    from tessera.plans.programs import ProgramWriter

    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id int, a double")
    specs = [FeatureSpec("double_a", transform="custom", base_columns=("a",))]
    bad = "import os\ndef generate_features(df):\n    return df\n"
    good = "```python\nimport pandas as pd\ndef generate_features(df):\n    return df.assign(double_a=df['a'] * 2)[['double_a']]\n```"
    client = ScriptedClient([bad, good])
    writer = ProgramWriter(client, EvaluationSettings(timeout_s=30, memory_mb=512))
    code = writer.write(df, specs, "id")
    assert "os" in writer.failures[0] and "refused" in client.asked[1][-1]["content"]
    assert {(r.id, r.double_a) for r in writer.run(df, code, specs, "id").collect()} == {(i, 2.0 * i) for i in range(9)}
    with pytest.raises(ExecutionError):
        ProgramWriter(ScriptedClient([bad])).write(df, specs, "id")


def test_services_over_http():
    import http.server
    import threading

    from tessera.plans import providers

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            answer = {"content": [{"text": "hello"}]} if self.path == "/content" else {"choices": [{"message": {"content": "hi"}}]}
            self.send_response(500 if self.path == "/broken" else 200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    asked = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "x"}]
    try:
        of = lambda path, way: providers.HttpClient(ClientSettings(model="any/m1"), providers.Service(f"{at}/{path}", "NO_SUCH_KEY", way), "secret")
        assert of("choices", "choices").complete(asked) == "hi" and of("content", "content").complete(asked) == "hello"
        assert seen[0][2]["messages"] == asked and seen[0][1]["Authorization"] == "Bearer secret" and seen[0][2]["model"] == "m1"
        assert seen[1][2]["system"] == "be brief" and [m["role"] for m in seen[1][2]["messages"]] == ["user"]
        with pytest.raises(ClientError):
            of("broken", "choices").complete(asked)
        assert providers.wait_for(providers.complete_all(of("choices", "choices"), [asked] * 4, 2)) == ["hi"] * 4
    finally:
        server.shutdown()
    assert [providers.provider_of(m) for m in ("gpt-x", "deepseek/chat", "claude-x")] == ["openai", "deepseek", "anthropic"]
    for bad in (lambda: providers.provider_of("other"), lambda: providers.HttpClient(ClientSettings(model="gpt-x"), providers.Service(at, "NO_SUCH_KEY")).complete(asked)):
        with pytest.raises(ConfigurationError):
            bad()


def test_waiting_inside_a_running_loop():
    import asyncio

    from tessera.plans.providers import wait_for

    async def three():
        return 3

    async def outer():
        return wait_for(three())

    assert asyncio.run(outer()) == 3


def test_second_order_takes_the_best_of_the_first(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "a": a, "b": b, "y": (a * b > 0).astype(int)}))
    method = ExpansionMethod(n_features=3, order=2, paired=6).fit(df, TABLE)
    made = Compiler().transform(df, method.specs)
    assert not made.failures and any(s.transform == "multiply" for s in method.specs) and len(method.importances) >= 3
