"""The last three operators against brute force, with odd rows, and the parts that their methods rest on."""

import functools
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import conversation_repair as cr
from tessera.llm import lexical_search as ls
from tessera.llm import substring_dedup as sd

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- ranked search ----------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_ranks(docs, items, k=10):
    words = [Counter(terms(t)) for _, t in docs]
    n = [sum(w.values()) for w in words]
    many, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for w in words for t in w)
    out = []
    for item, text in sorted(set(items), key=lambda x: (x[0], x[1] or "")):
        scored = []
        for (doc, _), w, size in zip(docs, words, n, strict=True):
            score = 0
            for t in terms(text):
                if w[t]:
                    m = 25 + 75 * size * many // total
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda x: x[:2])


def ranks(spark, docs, items):
    got = ls.lexical_search(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=lambda x: x[:2])


def library(seed, many, vocabulary=120):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([3, 20, 80])))) for i in range(many)]
    items = [(q, " ".join(word() for _ in range(rng.choice([1, 4, 12])))) for q in range(12)]
    return docs, items


def test_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 5)
    docs, items = library(1, 700)
    docs += [(3, docs[3][1]), (900, docs[4][1]), (901, docs[4][1]), (902, ""), (903, None), (904, "w0 " * 400), (None, docs[5][1])]  # ties, copies, long texts, counts above a byte
    items += [(50, "W0, w0;w0 w119 été"), (51, None), (52, "nothing_like zzz"), (3, "w7")]
    assert ranks(spark, docs, items) == brute_ranks(docs, items)


def test_ranks_of_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "words"), (2, "")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ls.lexical_search(spark, odd_docs, items).collect()), key=lambda x: x[:2])
    assert got == brute_ranks(docs, [(1, "words"), (2, "")]) and got
    assert ls.lexical_search(spark, no_docs, items).collect() == [] == ls.lexical_search(spark, odd_docs, items.limit(0)).collect()


def test_block_maxima_leave_blocks_encoded(monkeypatch):
    monkeypatch.setattr(ls, "CHUNK", 64)
    docs, items = library(2, 6000, 1000)
    hashes = np.array(sorted({t for _, text in items for t in ls.terms_of(text)}), np.uint64)
    batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["id", "text"])
    (row,) = [r for b in ls._indexed(hashes)([batch]) for r in b.to_pylist()]
    df = dict(zip(row["terms"], row["dfs"], strict=True))
    corpus = ls.Corpus(row["n_docs"], row["n_terms"], np.array([ls.weight(row["n_docs"], df.get(t, 0)) for t in range(len(hashes))]))
    want = brute_ranks(docs, items)
    got, decoded, all_of_them = [], 0, 0
    for q, text in items:
        shard = ls.Shard(row, corpus)
        query = [(int(np.searchsorted(hashes, np.uint64(t))), n) for t, n in ls.terms_of(text).items()]
        best, score = shard.search(query, 10)
        got += [(q, r + 1, int(shard.ids[b]), int(s)) for r, (b, s) in enumerate(zip(best, score, strict=True))]
        decoded, all_of_them = decoded + shard.decoded, all_of_them + sum(df.get(t, 0) for t, _ in query)
    assert got == want and decoded < 0.9 * all_of_them


# --- repeated spans ---------------------------------------------------------------------------------------------------


def brute_spans(docs, k=20):
    """(id, words, removed, kept) of rows; rows that repeat an id and a text are one."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", d[1] or "") for d in docs}
    first = {}
    order = sorted(words, key=lambda d: (d[0] is None, d[0] or 0))
    for d in order:
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), (d, i))
    out = []
    for d in docs:
        w, gone = words[d], set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] != (d, i):
                gone |= set(range(i, i + k))
        out.append((d[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def spans(spark, docs, **kw):
    got = sd.dedup_substrings(spark, spark.createDataFrame(docs, "doc_id long, text string"), **kw).collect()
    for r in got:
        assert r.n_removed == sum(s.words for s in r.removed)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr)


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    shared = [text(rng.choice([19, 20, 21, 35, 60])) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [x for _ in range(rng.randrange(1, 4)) for x in (text(rng.randrange(25)), rng.choice(shared)[rng.randrange(3) :])]
        docs.append((i, " \n\t".join([" ".join(p) for p in parts if p])))
    loop = " ".join(["a b c"] * 30)
    return [*docs, (61, loop), (62, "z " + loop), (63, " ".join(["x"] * 70)), (64, docs[0][1]), (None, docs[1][1]), (65, docs[1][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, seed):
    docs = passages(seed)
    docs.append(docs[5])
    assert spans(spark, docs) == brute_spans(docs)
    assert spans(spark, docs, k=6, anchor=6) == brute_spans(docs, 6) == spans(spark, docs, k=6, anchor=1)


def test_paths_are_compact_and_verified(spark):
    """A passage of 60 words in three texts is one row of the same length for each later place, whatever surrounds it."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i} before{i} {passage} after{i} {i}") for i in (4, 2, 9)], "doc_id long, text string")
    got = sd.repeated_spans(spark, docs).collect()
    for i in (4, 9):
        mine = sorted((r.start, r.windows) for r in got if r.id == i)
        assert sorted(x for start, n in mine for x in range(start, start + n)) == list(range(2, 43)) and len(mine) < 20
    assert all(r.source.id == 2 and r.source.start == r.start for r in got)


def test_spans_of_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sd.dedup_substrings(spark, odd_docs)
    assert set(odd_docs.columns) <= set(got.columns)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr) == brute_spans(rows)
    assert sd.dedup_substrings(spark, no_docs).collect() == []


# --- repaired conversations -------------------------------------------------------------------------------------------


def brute_repair(symbols):
    """The cheapest edits by trying all: states by audits, row by row, with up to two rows put in at each place."""
    best = {0: (0, "")}

    def more(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                to = cr.ASSISTANT if state == cr.USER else cr.USER
                ways[to] = min(ways.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return ways

    best = more(best)
    for s in symbols:
        new = {}
        for state, (cost, audit) in best.items():
            options = [(state, 2, "D")]
            if s != "d":
                extra = 5 if s.isupper() else 0
                for to, before in cr.BEFORE.items():
                    if state in before:
                        if cr.STATE_OF.get(s.lower()) == to:
                            options.append((to, extra, "K"))
                        if to in cr.NAMES:
                            options.append((to, extra + 1, "R"))
            for to, c, e in options:
                new[to] = min(new.get(to, (10**9, "")), (cost + c, audit + e))
        best = more(new)
    return min(best[x] for x in (0, cr.ASSISTANT) if x in best)


def test_edits_equal_brute_force_under_any_grammar():
    rng = random.Random(5)
    grammars = [(), ("ua",), ("ua", "ud", chr(cr.FIRST_RULE) * 2, chr(cr.FIRST_RULE + 2) + chr(cr.FIRST_RULE)), ("uu", "dd", "aU", "us")]
    cases = ["".join(c) for n in range(4) for c in itertools.product("suaodUA", repeat=n)] + ["".join(rng.choice("suaouaSUAOd") for _ in range(rng.randrange(4, 40))) for _ in range(150)]
    for symbols in cases:
        want = brute_repair(symbols)
        for rules in grammars if len(symbols) > 3 else grammars[:2]:
            assert cr.cheapest(symbols, rules) == want, symbols


def test_ropes_compare_as_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(40))) for _ in range(60)]
    rope = lambda t: functools.reduce(lambda a, b: a + b, [cr.Rope(t[k : k + 5]) for k in range(0, len(t), 5)], cr.Rope())
    for a, b in itertools.product(texts, texts):
        assert (rope(a) < rope(b)) == (a < b) and str(rope(a)) == a


def valid(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles)) is not None


def test_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 4, "user", "cut of"), (1, 5, "assistant", "Fine.")]
    rows += [(2, 0, "user", " \t"), (3, None, "tool", "x."), (3, 7, None, None), (None, 1, "user", "A."), (None, 2, "assistant", "B."), (4, 0, "user", "gone.")]
    rows += [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS audit", "if(conv_id = 4, 0, 1) AS times")
    got = {r.conv_id: r for r in cr.repair_conversations(spark, df, df.times).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (1, 0, 1, 1, 1, 6, "KKDDDK")
    assert [(r.role, r.text) for r in one.repaired] == [("system", "Be kind."), ("user", "Hello?"), ("assistant", "Fine.")]
    assert (got[2].cost, got[2].audit, got[2].repaired) == (2, "D", [])
    assert (got[3].gaps, got[3].blank, got[3].illegal, got[3].audit) == (0, 1, 1, "DD")
    assert (got[4].cost, got[4].audit, got[4].gaps) == (0, "", 0) and got[None].audit == "KK"
    assert got[5].cost == 0 and len(got[5].repaired) == 3000
    assert all(valid([x.role for x in r.repaired]) for r in got.values())
    assert cr.repair_conversations(spark, df.limit(0)).collect() == []


def test_rules_come_from_all_conversations(spark):
    strings = spark.createDataFrame([("uaua", 500), ("suaua", 100), ("uu", 3), ("d", 1)], "symbols string, n long")
    rules = cr.grammar(strings)
    assert rules[0] == "ua" and rules[1] == chr(cr.FIRST_RULE) * 2 and len(cr.rewrite("ua" * 64, rules)) <= 32
    assert cr.grammar(strings, max_rules=1) == ("ua",)
