"""Datasets, experiments, reports, artifacts, streams."""

import json

import pytest

from tessera.artifacts import diff
from tessera.artifacts.bundle import ArtifactBundle, FrameStore, compare_methods
from tessera.errors import ConfigurationError, DatasetError
from tessera.experiment.matrix import ExperimentMatrix
from tessera.experiment.reporter import report_best, report_mean, report_summary, to_html, to_json, to_markdown
from tessera.experiment.runner import Platform, Runner
from tessera.experiment.tracker import Track, calling_sink, lines_sink, read_events, table_sink
from tessera.plans.methods import BaseMethod, MethodRegistry
from tessera.settings import load_settings
from tessera.sources.dataset import DatasetRegistry, TableSpec, load_fetched
from tessera.spec import FeatureSpec
from tessera.streaming.rollup import windowed_rollup


class Squares(BaseMethod):
    def fit(self, df, table):
        self.specs, self.fitted, self.scripts = [FeatureSpec("a2", transform="square", base_columns=("a",))], True, ["a2", "a2"]
        self.gains = {"a2": 0.1}
        return self


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "toy"
    at.mkdir()
    (at / "train.csv").write_text("id,a,target\n" + "\n".join(f"{i},{(i % 5) - 2},{int(abs((i % 5) - 2) > 1)}" for i in range(40)))
    (at / "metadata.json").write_text(json.dumps({"target": "target", "row_id": "id"}))
    return tmp_path


def test_registry(spark, folder):
    r = DatasetRegistry(str(folder), None)
    data = r.load(spark, "toy")
    assert data.train.count() == 40 and data.table == TableSpec("id", "target") and r.info("toy")["source"] == "local"
    with pytest.raises(KeyError):
        r.load(spark, "nope")
    (folder / "bad").mkdir()
    (folder / "bad" / "metadata.json").write_text("{}")
    with pytest.raises(DatasetError):
        DatasetRegistry(str(folder), None)

    class Local:
        def fetch(self, slug):
            return [str(folder / "toy" / "train.csv")]

    assert load_fetched(spark, Local(), "x/y", "target").metadata["rows"] == 40


def test_platform(spark, folder):
    methods = MethodRegistry(None)
    methods.register("squares", lambda: Squares("squares"))
    p = Platform(spark, load_settings(environ={}, model="linear", evaluation={"cv_folds": 2}), DatasetRegistry(str(folder), None), methods)
    out = p.run(["toy"], ["squares", "nope"]).toPandas().set_index("method")
    assert out.gain["squares"] > 0.1 and "nope" in out.error["nope"]
    assert p.summary().first().failed_runs == 1 and p.report_best().first().method == "squares"


def test_matrix(spark):
    m = ExperimentMatrix().datasets("a", "b").methods("x", y=[{"n": 1}, {"n": 2}]).seeds(1, 2)
    rows = m.generate()
    assert len(rows) == len(m) == m.to_frame(spark).count() == 12
    assert rows[1]["method_config"] == {} and {r["method"] for r in rows} == {"x", "y"} and ExperimentMatrix().generate() == []


def test_partitions_of_a_matrix_are_those_of_one_axis(spark):
    df = ExperimentMatrix().datasets("a", "b").methods("x").models("m").seeds(1, 2, 3).to_frame(spark)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and df.distinct().count() == 6


def test_runner_keeps_failures_and_order(tmp_path):
    def fn(config):
        if config["i"] == 1:
            raise ValueError("no")
        return {"score": config["i"] / 2}

    rows = Runner(Track(lines_sink(str(tmp_path / "log.jsonl")))).run([{"i": i} for i in range(3)], fn, workers=2)
    assert [r.get("score") for r in rows] == [0.0, None, 1.0] and rows[1]["error"] == "no"
    told = [json.loads(x) for x in (tmp_path / "log.jsonl").read_text().splitlines()]
    assert {(e["run"], e["name"]) for e in told} >= {("run-0", "score"), ("run-1", "error"), ("run-2", "i")} and len(told) == 9


def test_events_in_a_table(spark, tmp_path):
    track = Track(table_sink(spark, str(tmp_path / "events")))
    with track.run("a", {"depth": 3, "name": "x"}) as log:
        log.put("metric", {"auc": 0.5}, step=1)
        log.put("artifact", {"code": "a\nb", "rows": spark.range(3), "none": None, "flag": True})
    with pytest.raises(ValueError), track.run("b"):
        raise ValueError
    rows = {(r.run, r.name): (r.kind, r.number, r.text, r.step) for r in read_events(spark, str(tmp_path / "events")).collect()}
    assert rows["a", "depth"] == ("config", 3.0, None, None) and rows["a", "auc"] == ("metric", 0.5, None, 1)
    assert rows["a", "rows"][2] == '[{"id": 0}, {"id": 1}, {"id": 2}]' and rows["a", "flag"][2] == "true" and ("b", "seconds") in rows
    with Track().run("c") as log:
        log.put("metric", {"n": 1})
    seen = []
    with Track(calling_sink(lambda *x: seen.append(x), lambda *x: seen.append(x))).run("d", {"name": "x"}) as log:
        log.put("metric", {"auc": 0.5}, step=3)
    assert seen[:2] == [("name", "x"), ("auc", 0.5, 3)]


def test_reports(spark):
    df = spark.createDataFrame([(0, "a", "m", 1, 1.0, None), (1, "a", "m", 2, 3.0, None), (2, "b", "m", 1, None, "x")], "run_id long, dataset string, method string, seed long, score double, error string")
    assert {r.dataset: r.score for r in report_mean(df).collect()} == {"a": 2.0, "b": None}
    assert "seed" in report_mean(df, parity=True).columns and report_best(df, "score").filter("dataset = 'a'").first().run_id == 1
    s = report_summary(df.drop("error")).first()
    assert (s.total_runs, s.successful_runs, s.failed_runs) == (3, 3, 0)
    assert "| dataset |" in to_markdown(df.select("dataset")) and "<td>a</td>" in to_html(df) and json.loads(to_json(df))[0]["score"] == 1.0


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 1)], "id int, a double, y int")
    methods = MethodRegistry(None)
    methods.register("one", lambda: Squares("one"))
    methods.register("two", lambda: Squares("two"))
    bundles = compare_methods(methods, ["one", "two", "nope"], df, TableSpec("id", "y"))
    assert bundles["nope"].error and len(bundles["one"].scripts) == 1
    rows = diff.feature_rows(spark, bundles)
    assert [tuple(r) for r in diff.overlap(rows, ["one", "two"]).collect()] == [("a2", 1, 1)]
    assert diff.unique_to_one(rows).count() == 0 and diff.shared_by_all(rows, ["one", "two"]).count() == 1
    assert "a2" in diff.dashboard(rows, ["one", "two"])
    bundles["one"].save(spark, str(tmp_path / "b"), {"x": df})
    again, frames = ArtifactBundle.load(spark, str(tmp_path / "b"))
    assert again == bundles["one"] and frames["x"].count() == 2 and again.provenance_frame(spark).first().script_sha256


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    for mode in ("memory", "disk", "hybrid"):
        for fmt in ("parquet", "csv"):
            store = FrameStore(spark, str(tmp_path / mode / fmt), mode, fmt)
            store.store("k", df)
            assert [tuple(r) for r in store.load("k").collect()] == [(1, "x")] and store.keys() == ["k"]
    with pytest.raises(ConfigurationError):
        FrameStore(spark, "x", fmt="feather")
    with pytest.raises(KeyError):
        store.load("none")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(id * 20000) AS ts, 'e' AS event_type, CAST(id AS DOUBLE) AS value FROM range(20)")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed_rollup(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, windowed_rollup(df).collect()))


def test_runs_that_end_together_lose_no_event(spark, tmp_path):
    at = str(tmp_path / "together")
    found = Runner(Track(table_sink(spark, at))).run([{"i": i} for i in range(20)], lambda config: {"score": float(config["i"])}, workers=4)
    assert found is not None
    scores = [r.number for r in read_events(spark, at).filter("name = 'score'").collect()]
    assert sorted(scores) == [float(i) for i in range(20)]


def test_methods_compute_their_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, float(i % 17), float(i * i % 29), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int").mapInArrow(counted, "id int, a double, b double, y int")
    bundles = compare_methods(MethodRegistry(None), ["expansion"], df, TableSpec("id", "y"), {"expansion": {"n_features": 3, "screen_to": 8}})
    assert bundles["expansion"].error is None and read.value == 60
    kept = df.storageLevel
    assert not (kept.useMemory or kept.useDisk)
