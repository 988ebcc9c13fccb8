"""Queries that SQL can express, against DuckDB on the smallest tables; and the columns that all of them return."""

import os

import pytest

from tessera.llm.registry import ORACLES, QUERIES

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "op2": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op5": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op11": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op13": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    theirs = con.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    ours = QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, ours.select(*names).collect()))) == sorted(map(repr, map(tuple, theirs.fetchall())))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, name):
    found = dict(QUERIES[name](spark, DATA).dtypes)
    want = COLUMNS.get(name.split("_")[0], {})
    assert {k: found.get(k) for k in want} == want
