import itertools
import random
import re

import pytest

from tessera.llm import ngram_jaccard as nj

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(docs, num=75, den=100):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (p, (i, a)), (q, (j, b)) in itertools.combinations(enumerate(sets), 2):
        if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
            parent[root(q)] = root(p)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i if i is not None else -1, len(s), least.get(root(k), -1) if i is not None else -1) for k, (i, s) in enumerate(sets))


def ours(spark, df, **kw):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in nj.ngram_jaccard(spark, df, **kw).collect())


def corpus(seed, groups, copies, words, common):
    rng, out, n = random.Random(seed), [], itertools.count()
    passage = [f"common{i}" for i in range(common)]
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(words)] + passage
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append((next(n), " ".join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed, 40, 8, 60, 25)
    assert ours(spark, spark.createDataFrame(docs, "doc_id long, text string")) == classes(docs)


def test_heavy_columns_and_cells(spark, monkeypatch):
    """With few rows to a heavy column and to a cell every group goes through parts, pivots and cells."""
    monkeypatch.setattr(nj, "HEAVY_DF", 2)
    monkeypatch.setattr(nj, "CELL", 8)
    docs = corpus(5, 12, 30, 40, 30)
    assert ours(spark, spark.createDataFrame(docs, "doc_id long, text string")) == classes(docs)


def group(rng, copies, words, edited):
    """Near copies of one text; of few edits all link, of many only some do, mostly by way of others."""
    base = [f"g{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        w = list(base)
        for at in rng.sample(range(words), rng.randrange(edited + 1)):
            w[at] = f"e{rng.randrange(10**9)}"
        yield " ".join(w)


@pytest.mark.parametrize("copies", [10, 49, 500])
def test_groups_of_near_copies(spark, copies):
    rng = random.Random(copies)
    texts = [*group(rng, copies, 80, 3), *group(rng, copies, 60, 4), *[" ".join(f"o{rng.randrange(300)}" for _ in range(60)) for _ in range(100)]]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = ours(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert got == classes(docs) and len({c for _, _, c in got}) > 100


def test_overlaps_grow_with_a_group_not_with_its_square(spark):
    """One row for each row of a posting that is no pivot, however long it is."""
    import numpy as np
    import pyarrow as pa

    def made(m):
        keys = np.repeat(np.arange(1, 41, dtype=np.uint64), m)
        ids, sizes = np.tile(np.arange(m, dtype=np.int64), 40), np.full(40 * m, 60, np.uint32)
        batch = pa.record_batch([pa.array([0], pa.int32()), *(pa.array([nj.pack(x)], pa.binary()) for x in (np.diff(keys, prepend=np.uint64(0)), ids, sizes))], ["bucket", "k", "d", "n"])
        return sum(b.num_rows for b in nj._product(75, 100, 4)([batch]) if b.column(0)[0].as_py() == 0)

    assert [made(m) for m in (2, 12, 24, 48, 96)] == [1, 11, 23, 47, 95]


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (5, text), (5, "a clean text under the number five"), (5, "a clean text under the number five"), (6, text + " more"), (None, text), (None, text), (8, None), (8, None), (9, "")]
    left = nj.one_of_each(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string"))
    assert left.columns == ["doc_id", "text", "class_id"]
    assert sorted(((r.doc_id or -1), r.text or "") for r in left.collect()) == sorted([(3, text), (5, rows[2][1]), (-1, text), (-1, text), (8, ""), (9, "")])


def test_numbers_of_links(spark, monkeypatch):
    monkeypatch.setattr(nj, "CELL", 16)
    docs = [*corpus(11, 8, 25, 40, 10), (900, None), (901, "")]
    docs += [(i + 500, t) for i, t in docs[:20]]
    sets = [shingles(t) for _, t in docs]
    want = {i: sum(bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for q, b in enumerate(sets) if q != p) for p, ((i, _), a) in enumerate(zip(docs, sets, strict=True))}
    got = {r.doc_id: r.n_links for r in nj.ngram_jaccard(spark, spark.createDataFrame(docs, "doc_id long, text string"), links=True).collect()}
    assert got == want and len(set(want.values())) > 4


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ours(spark, odd_docs)
    assert got == sorted((i if i is not None else -1, len(shingles(t)), {2: 1 if "one" in (t or "") else 2}.get(i, i if i is not None else -1)) for i, t in docs)
    assert ours(spark, no_docs) == []


def test_threshold_is_exact(spark):
    a, b = [f"x{i}" for i in range(16)], [f"x{i}" for i in range(13)] + ["y"]
    docs = [(1, " ".join(a)), (2, " ".join(b))]  # 9 of 13 shingles: below 0.75, above 0.69
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {c for _, _, c in ours(spark, df)} == {1, 2}
    assert {c for _, _, c in ours(spark, df, threshold=(9, 13))} == {1}
    with pytest.raises(ValueError):
        nj.ngram_jaccard(spark, df, threshold=(3, 2))


def test_links_are_counted_on_request_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k")], "doc_id long, text string")
    assert nj.ngram_jaccard(spark, docs, links=True).columns == ["doc_id", "n_shingles", "component_id", "text_key", "n_links"]
    monkeypatch.setattr(nj, "_link_counts", lambda *_: pytest.fail("links are counted unasked"))
    assert nj.ngram_jaccard(spark, docs).columns == ["doc_id", "n_shingles", "component_id", "text_key"]
    assert ours(spark, docs) == [(1, 6, 1), (2, 7, 1)]
