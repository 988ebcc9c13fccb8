"""Every query of the catalogue that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from tessera.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    a = sorted(tuple(plain(v) for v in r) for r in ours.select(*[f"`{n}`" for n in names]).collect())
    b = sorted(tuple(plain(v) for v in r) for r in theirs.fetchall())
    assert a == b


def test_every_query_of_the_entry_is_named_once():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["expand_order1", "expand_order2"])
def test_expansions_of_zeros_and_nulls(spark, tmp_path, name):
    import duckdb

    customer = [(1, 0.0, 3, "A"), (2, 5.25, 4, "A"), (3, -2.5, 5, "B"), (4, 7.5, 6, None), (5, 9.0, 7, None), (6, None, 8, "B"), (7, 1.5, 9, "=null")]
    spark.createDataFrame(customer, "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 0.0, "F", "1"), (2, 5.0, "F", "1"), (3, 3.0, "O", "2")], "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    theirs = con.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    ours = QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(tuple(plain(v) for v in r) for r in ours) == sorted(tuple(plain(v) for v in r) for r in theirs.fetchall())


def test_digits_are_counted_by_runs(spark, tmp_path):
    from tessera.plans.catalog import Tables, text_features

    texts = ["", "a1b22 c", "123", "no digits\nhere", "１2é３4", None]
    spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made = text_features(Tables(spark, str(tmp_path)))
    want = [None if x is None else sum(c in "0123456789" for c in x) / max(len(x), 1) for x in texts]
    assert [r.digits for r in made.orderBy("doc_id").collect()] == want
    assert "[^0-9]+" in made._jdf.queryExecution().optimizedPlan().toString()
