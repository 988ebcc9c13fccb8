"""Stages against what their operators say, on rows small enough to check by eye."""

import random

import pytest

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(9), str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(rng.choice(["ka", "so", "mi", "ter", "lun", "ex"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n=60: [word() for _ in range(n)]
    item = text(30)
    docs = []
    for i in range(300):
        w = text(rng.randrange(40, 90))
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "vileword")
        docs.append((i, " ".join(w), "en", "ab"[i % 2], 1))
    docs += [(1000, docs[1][1], "en", "a", 1), (1001, docs[1][1] + " tail", "en", "a", 1), (1002, docs[2][1].upper(), "en", "b", 1)]
    docs += [(1100, " ".join(text(20) + item + text(20)), "en", "a", 1), (1101, None, None, None, None), (1102, "", "en", "a", 0), (None, "words without a number", "en", "a", 1)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [r.doc_id for r in docs.collect()]
    ids = lambda name: {i for i in kept[name]}
    assert ids("toxicity") == {i for i in range(300) if i % 6} | {1000, 1001, 1002, 1100, 1101, 1102, None}
    assert ids("ngram_jaccard") == ids("toxicity") - {1000, 1001, 1002} and len(kept["ngram_jaccard"]) == len(ids("ngram_jaccard"))
    assert ids("decontamination") == ids("ngram_jaccard") - {1100}
    assert ids("mixing") <= ids("decontamination") and len(kept["mixing"]) > 100
    placed = cp.STAGES[-1][1](spark, docs, folder).collect()
    assert len(placed) == len(kept["mixing"]) and {r.shard for r in placed} <= set(range(24))


def test_run_is_all_stages(spark, folder):
    assert cp.run(spark, folder).count() > 100 and [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs, folder):
    """Rows that a stage must keep: two of the three copies of one text go, and nothing else does."""
    want = {"toxicity": 12, "ngram_jaccard": 10, "decontamination": 12, "sharding": 12}
    for name, stage in cp.STAGES:
        out = stage(spark, odd_docs, folder)
        rows = out.collect()
        if name in want:
            assert len(rows) == want[name], name
        assert {r.doc_id for r in rows} <= {r.doc_id for r in odd_docs.collect()} and rows, name
        if name != "sharding":
            assert out.columns == odd_docs.columns
        assert stage(spark, no_docs, folder).count() == 0


def test_different_texts_under_one_id_are_judged_apart(spark, folder):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "en", "a", 1), (5, text, "en", "a", 1), (5, "a clean text under the number five", "en", "a", 1)]
    left = dict(cp.STAGES)["ngram_jaccard"](spark, spark.createDataFrame(rows, COLUMNS), folder)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, text), (5, rows[2][1])]
