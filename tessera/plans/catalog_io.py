"""More of the catalogue: sources, sinks, screens, evaluation parts and the records of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.artifacts.bundle import ArtifactBundle, FrameStore
from tessera.experiment.runner import Runner
from tessera.experiment.tracker import Track, read_events, table_sink
from tessera.operators import folds, metrics, profile, screen
from tessera.operators.compile import Compiler
from tessera.plans.catalog import Tables, query, r, spec
from tessera.plans.memory import Memory, feedback_top
from tessera.plans.router import Router
from tessera.session import shared_folder
from tessera.settings import load_settings
from tessera.sources.dataset import Dataset, DatasetRegistry, read_table
from tessera.spec import FeatureSpec, parse_specs


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------------------------------------------


@query(f"SELECT kind, s_suppkey, s_name, s_nationkey, {r('s_acctbal', 's_acctbal')} FROM supplier, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS v(kind)")
def source_formats(t: Tables) -> DataFrame:
    """One table through each format that is read and written."""
    own, at = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), _folder(t, "formats")
    out = None
    for kind in ("csv", "json", "orc", "parquet"):
        own.write.option("header", True).format(kind).save(f"{at}/suppliers.{kind}")
        back = read_table(t.spark, f"{at}/suppliers.{kind}", own.schema).select(F.lit(kind).alias("kind"), *own.columns)
        out = back if out is None else out.union(back)
    return out


@query("SELECT 'customers' AS name, 'c_mktsegment' AS target, 2::BIGINT AS columns, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'orders', 'o_orderstatus', 2, (SELECT count(*) FROM orders)")
def dataset_registry(t: Tables) -> DataFrame:
    known = DatasetRegistry(entry_points=None)
    known.register("orders", lambda spark: Dataset("orders", t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus"))
    known.register("customers", lambda spark: Dataset("customers", t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment"), {"source": "memory"})
    loaded = [known.load(t.spark, n) for n in known.names()]
    parts = [d.train.agg(F.count("*").alias("n")).select(F.lit(d.name).alias("name"), F.lit(d.target).alias("target"), F.lit(len(d.train.columns)).cast("long").alias("columns"), "n") for d in loaded]
    return parts[0].union(parts[1])


@query(f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 'total')} FROM orders GROUP BY ALL")
def stored_frame(t: Tables) -> DataFrame:
    """A frame that is written and read lazily."""
    store = FrameStore(t.spark, _folder(t, "store"), mode="disk")
    store.store("totals", t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))
    return store.load("totals")


@query(f"SELECT 'squares' AS method, 'a, b' AS features, n_nationkey, n_name, {r('n_nationkey * n_nationkey', 'square')} FROM nation")
def saved_bundle(t: Tables) -> DataFrame:
    at = _folder(t, "bundle")
    frame = t.nation.select("n_nationkey", "n_name", (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("square"))
    ArtifactBundle("squares", [{"name": "a"}, {"name": "b"}], {"x": "code"}).save(t.spark, at, {"made": frame})
    back, frames = ArtifactBundle.load(t.spark, at)
    return frames["made"].select(F.lit(back.method).alias("method"), F.lit(", ".join(f["name"] for f in back.features)).alias("features"), "n_nationkey", "n_name", "square")


_GAINS = [("log_a", "unary", 0.03), ("a_x_b", "cross", 0.07), ("mean_k", "aggregation", -0.02), ("log_a", "unary", 0.5), ("lag_a", "temporal", 0.05)]


def _memory(path: str) -> Memory:
    kept = Memory()
    for name, agent, gain in _GAINS:
        kept.record(FeatureSpec(name, transform=agent, base_columns=("a",)), gain, "auc", agent)
    kept.save(path)
    return Memory.load(path)


@query("SELECT * FROM (VALUES ('log_a', 'unary', 0.03::DOUBLE, true), ('a_x_b', 'cross', 0.07, true), ('mean_k', 'aggregation', -0.02, false), ('lag_a', 'temporal', 0.05, true)) AS v(feature_name, agent, value, effective)")
def memory_of_a_file(t: Tables) -> DataFrame:
    """Records that were saved and loaded; the first of a name stays."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the driver's own state, which no executor reads
        return _memory(f"{folder}/memory.json").to_frame(t.spark).select("feature_name", "agent", "value", "effective")


@query("SELECT * FROM (VALUES (1, 'a_x_b → auc: 0.0700 (rank 1)'), (2, 'lag_a → auc: 0.0500 (rank 2)')) AS v(rank, line)")
def memory_top(t: Tables) -> DataFrame:
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        return feedback_top(_memory(f"{folder}/memory.json").to_frame(t.spark), 2).select("rank", "line")


@query("SELECT run, kind, name, number, text FROM (VALUES ('run-0', 'config', 'i', 0::DOUBLE, NULL), ('run-0', 'result', 'score', 0, NULL), ('run-1', 'config', 'i', 1, NULL), ('run-1', 'result', 'error', NULL, 'no'), ('run-2', 'config', 'i', 2, NULL), ('run-2', 'result', 'score', 1, NULL)) AS v(run, kind, name, number, text)")
def event_table(t: Tables) -> DataFrame:
    """What runs, one of which fails, told a table."""
    at = _folder(t, "events")

    def run(config: dict) -> dict:
        if config["i"] == 1:
            raise ValueError("no")
        return {"score": config["i"] / 2}

    Runner(Track(table_sink(t.spark, at))).run([{"i": i} for i in range(3)], run, workers=2)
    return read_events(t.spark, at).filter("kind <> 'end'").select("run", "kind", "name", "number", "text")


# --- candidates and evaluation ------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS x FROM lineitem), v AS (SELECT unnest([('q', var_pop(q)), ('p', var_pop(p)), ('d', var_pop(d)), ('x', var_pop(x))]) AS e FROM c)
    SELECT row_number() OVER (ORDER BY e[2] DESC)::INT AS place, e[1] AS "column" FROM v QUALIFY place <= 2"""
)
def candidate_cap(t: Tables) -> DataFrame:
    """Of four columns the two of the largest variance."""
    made = t.lineitem.select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"))
    return t.spark.createDataFrame(list(enumerate(screen.prefilter(made, ["q", "p", "d", "x"], 2), 1)), "place int, column string")


@query("SELECT 'l_returnflag' AS target, count(DISTINCT l_returnflag) <= 10 AS classes FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) <= 10 FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) <= 10 FROM lineitem")
def target_kinds(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(c, profile.is_classification(t.lineitem, c)) for c in ("l_returnflag", "l_quantity", "l_discount")], "target string, classes boolean")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def head_rows(t: Tables) -> DataFrame:
    return profile.head(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 5)


_FOLDED = "f AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS x, c_mktsegment AS s, (('0x' || substr(md5(c_custkey || ':42'), 1, 8))::BIGINT % 3)::INT AS fold FROM customer)"


@query(
    f"""WITH {_FOLDED}, m AS (SELECT quantile_disc(x, 0.5) AS m FROM f WHERE fold <> 1), c AS (SELECT list_sort(list(DISTINCT s)) AS cats FROM f WHERE fold <> 1)
    SELECT c_custkey, fold, {r('coalesce(x, m)', 'x')}, {r('coalesce(list_position(cats, s), 0) - 1', 's')} FROM f, m, c"""
)
def imputed_fold(t: Tables) -> DataFrame:
    """Numbers as a model of fold 1 gets them: medians and codes of its training rows."""
    made = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("x"), F.col("c_mktsegment").alias("s"))
    made = folds.kfold(made, "c_custkey", 3)
    return folds.learn(made, ["x", "s"], 3, lower=True).apply(made, ["x", "s"], 1)


@query(
    f"""WITH s AS (SELECT c_mktsegment AS y, (('0x' || substr(md5(c_custkey || ':' || k), 1, 4))::BIGINT % 500)::DOUBLE AS s, k FROM customer, (SELECT DISTINCT c_mktsegment AS k FROM customer)),
    c AS (SELECT k, s, count(*) AS n, count(*) FILTER (y = k) AS p FROM s GROUP BY ALL),
    a AS (SELECT k, n, p, sum(n) OVER (PARTITION BY k ORDER BY s) - n + (n + 1) / 2 AS rank FROM c),
    e AS (SELECT k, (sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))) AS auc FROM a GROUP BY k) SELECT {r('avg(auc)', 'auc')} FROM e"""
)
def metric_auc_ovr(t: Tables) -> DataFrame:
    """Mean of the classes against the rest, of scores that are hashes."""
    classes = [x[0] for x in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(100).collect()]
    score = lambda k: F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(f":{k}"))), 1, 4), 16, 10).cast("long"), F.lit(500)).cast("double")
    label = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col("c_mktsegment")) - 1
    made = t.customer.select(F.lit(0).alias("fold"), label.alias("label"), F.array(*[score(k) for k in classes]).alias("scores"))
    return metrics.auc_of_classes(made, "label", "scores", len(classes), ["fold"]).select("auc")


@query(f"WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS k, o_totalprice AS v FROM orders) SELECT o_orderkey, CASE WHEN k IS NOT NULL THEN {r('avg(v) OVER (PARTITION BY k)')} END AS mean, CASE WHEN k IS NOT NULL THEN count(v) OVER (PARTITION BY k) END AS n FROM o")
def null_group_keys(t: Tables) -> DataFrame:
    """Rows without a key are in no group."""
    made = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("k"), F.col("o_totalprice").alias("v"))
    return Compiler().transform(made, [spec("mean", "group_mean", "k", "v"), spec("n", "group_count", "k", "v")]).frame.select("o_orderkey", "mean", "n")


@query("SELECT * FROM (VALUES (1, 'double'), (2, 'ratio')) AS v(place, name)")
def new_columns(t: Tables) -> DataFrame:
    """Features whose names are free: an existing column wins over a feature of its name."""
    specs = [spec("o_totalprice", "square", "o_custkey"), spec("double", "square", "o_totalprice"), spec("double", "absolute", "o_custkey"), spec("ratio", "safe_ratio", "o_totalprice", "double")]
    return t.spark.createDataFrame(list(enumerate(Compiler().transform(t.orders, specs).names, 1)), "place int, name string")


# --- agents, answers, settings ------------------------------------------------------------------------------------


@query(
    f"""WITH g(agent, i, gain) AS (SELECT 'unary', i, (i % 4) / 10.0 - 0.1 FROM range(13) AS x(i) UNION ALL SELECT 'temporal', i, 0.2 / (i + 1) FROM range(3) AS x(i)),
    l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY agent ORDER BY i DESC) <= 10)
    SELECT row_number() OVER (ORDER BY avg(gain) DESC)::INT AS place, agent, count(*) AS calls, {r('avg(gain)', 'mean_gain')} FROM l GROUP BY agent"""
)
def agents_by_gain(t: Tables) -> DataFrame:
    """The mean of each agent's last ten gains, best first."""
    router = Router(agents=("unary", "temporal"))
    for i in range(13):
        router.update("unary", (i % 4) / 10 - 0.1)
    for i in range(3):
        router.update("temporal", 0.2 / (i + 1))
    rows = [(n, a, len(router.history[a]), router.mean(a)) for n, a in enumerate(router.performance_driven(), 1)]
    return t.spark.createDataFrame(rows, "place int, agent string, calls long, mean_gain double")


@query("SELECT * FROM (VALUES (1, 'log_p', 'safe_log', 'p'), (2, 'p_by_q', 'safe_ratio', 'p,q')) AS v(place, name, transform, base)")
def parsed_answer(t: Tables) -> DataFrame:
    answer = 'Here:\n```json\n[{"base_columns": "p", "derived_features": [{"name": "log_p", "transform": "safe_log"}]}, {"name": "p_by_q", "transform": "safe_ratio", "base_columns": ["p", "q"]}]\n```'
    return t.spark.createDataFrame([(i, s.name, s.transform, ",".join(s.base_columns)) for i, s in enumerate(parse_specs(answer, "cross"), 1)], "place int, name string, transform string, base string")


@query("SELECT * FROM (VALUES ('cv_folds', '3'), ('metric', 'f1'), ('n_rounds', '2'), ('timeout_s', '9')) AS v(name, value)")
def merged_settings(t: Tables) -> DataFrame:
    """Arguments win over the environment."""
    s = load_settings(environ={"TESSERA_METRIC": "acc", "TESSERA_N_ROUNDS": "2", "TESSERA_EVALUATION__CV_FOLDS": "3", "TESSERA_EVALUATION__TIMEOUT_S": "7"}, metric="f1", evaluation={"timeout_s": 9})
    return t.spark.createDataFrame([("cv_folds", str(s.evaluation.cv_folds)), ("metric", s.metric), ("n_rounds", str(s.n_rounds)), ("timeout_s", str(s.evaluation.timeout_s))], "name string, value string")
