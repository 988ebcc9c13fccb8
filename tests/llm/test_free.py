"""Decontamination, nearest neighbours, line dedup, toxicity and WARC."""

import base64
import hashlib
import io
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontamination, line_dedup, toxicity, warc


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_exact_edit_verification():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert decontamination.edits(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute_edits(a, b)


def test_decontamination_finds_items_with_edits_and_nothing_else(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)] + [(90, None), (91, ""), (92, "a b")]
    docs, want, held = [], set(), {}
    for i in range(200):
        w = [word() for _ in range(rng.randrange(5, 200))]
        if i % 4 == 0:
            k = rng.randrange(20)
            part = items[k][1].split()
            for _ in range(i % 5):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(w))
            w[at:at] = [p.upper() + "!" for p in part]
            want.add((i, k))
            held[i] = True
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(spark, d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(docs)
    for r in got[:10]:
        tokens = lambda s: re.findall(r"[0-9a-z]+", s.lower())
        assert r.edits == brute_edits(tokens(items[r.item_id][1]), tokens(text[r.doc_id]))
    assert {r.doc_id for r in decontamination.drop_contaminated(spark, d, b).collect()} == set(range(200)) - set(held)


def test_decontamination_finds_items_of_any_length_with_all_their_edits():
    from tessera.llm.common import text_bytes

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    han = lambda: chr(rng.randrange(0x4E00, 0x9F00))
    for n in (5, 7, 9, 10, 12, 15, 20):
        for one, by in ((word, " "), (han, "")):
            items = [[one() for _ in range(n)] for _ in range(60)]
            texts = []
            for item in items:
                part = [[w] for w in item]
                for i in rng.sample(range(n), n // 5):
                    part[i] = rng.choice([[], [one()], [one(), *part[i]]])
                texts.append(by.join([one() for _ in range(9)] + sum(part, []) + [one() for _ in range(9)]))
            held = decontamination.Items(list(range(60)), pa.array([by.join(i) for i in items]), 0.95, 0.2, 5, pieces=True)
            assert [(r, k) for r, k, *_ in decontamination.hits_of(*text_bytes(pa.array(texts)), held)] == [(i, i) for i in range(60)]


def test_samples_alone_reach_their_target():
    """Recall of the sampled walks at the most edits that an item may have; without walks nothing is found."""
    from tessera.llm.common import text_bytes

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    for n in (5, 8, 10, 15, 30, 59):
        items = [[word() for _ in range(n)] for _ in range(150)]
        texts = []
        for item in items:
            part = [[w] for w in item]
            for i in rng.sample(range(n), n // 5):
                part[i] = rng.choice([[], [word()], [word(), *part[i]]])
            texts.append(" ".join([word() for _ in range(9)] + sum(part, []) + [word() for _ in range(9)]))
        held = decontamination.Items(list(range(150)), pa.array([" ".join(i) for i in items]), 0.98, 0.2, 5)
        found = {r for r, k, *_ in decontamination.hits_of(*text_bytes(pa.array(texts)), held) if r == k}
        assert len(found) >= 0.93 * 150, n
        few = decontamination.Items(list(range(150)), pa.array([" ".join(i) for i in items]), 0.2, 0.2, 5)
        assert len(few.tables) < len(held.tables)
        held.tables = []
        assert not decontamination.hits_of(*text_bytes(pa.array(texts)), held)


def test_steps_are_sampled_from_the_whole_walk():
    for words in (3, 10, 64, 500):
        steps = [decontamination.sampled(r, decontamination.window_of(words)) for r in range(64)]
        assert words // 2 < max(map(max, steps)) <= 2 * words and len(set(steps)) > (3 if words == 3 else 30)
    assert len({decontamination.starting_place(r, 40) for r in range(32)}) > 20
    many = [decontamination.repetitions_for(n, 0.2, 0.95) for n in (5, 10, 30, 64)]
    assert all(2 < m < decontamination.MOST_REPETITIONS for m in many) and decontamination.repetitions_for(30, 0.05, 0.95) < many[2]
    assert decontamination.repetitions_for(5000, 0.2, 0.95) == decontamination.repetitions_for(512, 0.2, 0.95)


def test_decontamination_of_a_very_long_item():
    from tessera.llm.common import text_bytes

    words = [f"w{i * 7919 % 10007}" for i in range(6000)]
    text = words.copy()
    for i in range(0, 6000, 9):
        text[i] = "other"
    held = decontamination.Items([1, 2], pa.array([" ".join(words)] * 2), 0.95, 0.2, 5)
    assert [(r, k) for r, k, *_ in decontamination.hits_of(*text_bytes(pa.array(["before " + " ".join(text)])), held)] == [(0, 0), (0, 1)]


def test_decontamination_blocks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    b = spark.createDataFrame([(1, "one two three four five six seven eight", "x"), (2, "no number but words enough to count", "y"), (3, None, "z")], "item_id long, text string, doc_id string")
    want = {(1, 1), (2, 1), (None, 2)}
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark, odd_docs, b).collect()} == want
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark, odd_docs, b).collect()} == want
    kept = decontamination.drop_contaminated(spark, odd_docs, b)
    assert kept.count() == 8 and kept.schema == odd_docs.schema
    assert decontamination.contaminated(spark, no_docs, b).count() == 0 and decontamination.contaminated(spark, odd_docs, b.limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    rng = np.random.RandomState(0)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.randint(20, size=1500)] + 0.3 * rng.normal(size=(1500, 32))).astype(np.float32)
    x[700:1100] = x[5]  # a hot group of equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(spark, df, F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id.values], atol=1e-12)
        hit += len(set(own.vec_id) & set(np.lexsort((np.arange(1500), d))[:10]))
        if 700 <= q < 1100:
            assert own.vec_id.tolist() == [5, *range(700, 710)][:10] or q in range(700, 710)
    assert hit / (75 * 10) >= 0.9


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(spark, df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (0, 3, 2, round(5**0.5, 6)), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, round(2**0.5, 6))]
    assert ann.search(spark, df.limit(0), F.lit(True)).count() == 0
    assert ann.search(spark, df.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_search_of_few_vectors_returns_all(spark):
    for n in (7, 12):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.RandomState(n).normal(size=(n, 16)))], "vec_id long, embedding array<float>")
        got = ann.search(spark, df, F.lit(True)).groupBy("query_id").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {min(10, n - 1)}


def brute_lines(docs, min_words, min_lines):
    seen, out = set(), {}
    for i, text in docs:
        every = text.split("\n")
        lines = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(every) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b][1].split())
                if n >= min_words or b - a + 1 >= min_lines:
                    key = tuple(x for _, x in lines[a : b + 1])
                    if key in seen:
                        gone |= set(range(lines[a][0], lines[b][0] + 1))
                    seen.add(key)
                    break
        out[i] = "\n".join(x for k, x in enumerate(every) if k not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 14))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words, lines in ((12, 3), (50, 2)):
        got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark, df, words, lines).collect()}
        assert got == brute_lines(docs, words, lines)


def brute_whole_runs(docs, min_words, min_lines):
    rows = [[(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")] for _, t in docs]
    seen, out = set(), {}
    for (i, text), lines in zip(docs, rows, strict=True):
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for _, x in lines[a : b + 1]) >= min_words or b - a + 1 >= min_lines:
                    key = tuple(x for _, x in lines[a : b + 1])
                    if key in seen:
                        gone |= set(range(lines[a][0], lines[b][0] + 1))
                    seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_line_dedup_of_whole_runs(spark):
    long, short = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a\n{long}\n{short}\nb"), (2, f"c\n{long}\n{short}\nd")], "doc_id long, text string")
    assert {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark, df, whole_runs=True).collect()}[2] == "c\nd"
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 14))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words, lines in ((12, 3), (20, 4)):
        got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark, df, words, lines, whole_runs=True).collect()}
        assert got == brute_whole_runs(docs, words, lines) and got != brute_lines(docs, words, lines)


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    more = spark.createDataFrame([(50, f"first\n{passage}\nlast"), (51, f"other\n\n {passage}\nend"), (51, f"other\n\n {passage}\nend"), (None, passage)], "doc_id long, text string")
    rows = line_dedup.dedup_lines(spark, more).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.clean_text) for r in rows) == [(-1, 1, ""), (50, 0, f"first\n{passage}\nlast"), (51, 1, "other\n\nend"), (51, 1, "other\n\nend")]
    out = line_dedup.dedup_lines(spark, odd_docs)
    assert out.count() == 12 and out.filter("clean_text <=> text").count() == 12 and line_dedup.dedup_lines(spark, no_docs).count() == 0


def test_toxicity_learns_and_leaves_clean_texts_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "re", "mi", "to", "lu", "ne"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randrange(5, 120))]
        if i % 5 == 0:
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randrange(len(w)), rng.choice(["Grobian", "swinehund", "VILEWORD"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(spark, d, l, F.col("id") % 3 != 1)
    out = toxicity.score(spark, d, model).toPandas().set_index("doc_id")
    held = out[out.index % 3 == 1]
    toxic = held.index % 5 == 0
    assert held.predicted[toxic].mean() > 0.95 and held.predicted[~toxic].mean() == 0
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
        out = toxicity.score(spark, odd_docs, toxicity.fit(spark, odd_docs, known))
        rows = out.collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if not r.text}) == 1
        assert set(out.columns) == set(odd_docs.columns)
    assert toxicity.score(spark, no_docs, toxicity.fit(spark, no_docs, labels)).count() == 0


def test_character_grams_don_t_cross_rows():
    from tessera.llm.common import text_bytes

    buf, off = text_bytes(pa.array(["abc", "", "deä", None, "ABCD"]))
    row, feature = toxicity.grams(buf, off)
    assert sorted(row.tolist()) == [0, 2, 4, 4, 4]
    one = lambda t: set(toxicity.grams(*text_bytes(pa.array([t])))[1].tolist())
    assert set(feature[row == 0].tolist()) == one("abc") and one("abc") <= one("abcd") == one("ABCD")


def test_warc_round_trip(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u\r\n4", ""), (None, "u5", "same"), (2, "u6", "same"), (7, "u7", "x" * 500_000), (8, "u8", "ünï\r\n\r\ncode")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_bytes string")
    got = warc.read(warc.write(spark, df), payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: "same", 2: "same", 3: "", 4: "", None: "same", 7: "x" * 500_000, 8: "ünï\r\n\r\ncode"}[r.page_id].encode()
        assert r.payload_bytes == len(text) and r.payload_digest == base64.b32encode(hashlib.sha1(text).digest()).decode()
        assert (bytes(r.payload) == text) if r.record_type == "response" else r.payload is None
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(-1, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "revisit", 4), (4, "response", 0), (7, "response", 0), (8, "response", 0)]
    assert {r.record_type for r in warc.read(warc.write(spark, df, revisit_from=100)).collect()} == {"response"}
    assert warc.read(warc.write(spark, df.limit(0))).count() == 0


def test_archive_frames():
    import zstandard

    out = io.BytesIO()
    records = [warc.record(i, f"http://h/{i}", f"<html>{'body ' * 50}{i}</html>".encode(), None, False) for i in range(300)]
    assert warc.write_archive(iter(records), out) == 300
    raw = out.getvalue()
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(raw[4:8], "little")
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
    assert first.decompress(raw[8 + size :]) == records[0]
    assert [r["page_id"] for r in warc.read_archive(io.BytesIO(raw))] == list(range(300))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))


def test_runs_come_from_selected_lines_and_their_extension(spark, monkeypatch):
    """Without the joined positions nothing is found; without extension only the selected lines."""
    passage = "\n".join(f"line {i} has a few words of its own" for i in range(9))
    df = spark.createDataFrame([(1, f"one\n{passage}\nend"), (2, f"two\n{passage}\nstop")], "doc_id long, text string")
    whole = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark, df, whole_runs=True).collect()}
    assert whole == {1: 0, 2: 9}
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "extended", lambda mine, other, at, there: (at, at))
        alone = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark, df, whole_runs=True).collect()}
    assert alone[1] == 0 and 0 < alone[2] < 9
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "windows", lambda h, *a: (np.arange(len(h), dtype=np.uint64), np.arange(len(h))))
        assert {r.n_removed for r in line_dedup.dedup_lines(spark, df.filter("doc_id = 1"), whole_runs=True).collect()} == {0}


def test_selected_lines_are_minima_and_positions_are_kept():
    from tessera.llm.common import text_bytes

    text = "\n".join(f"w{i}" for i in (5, 3, 9, 3, 7, 1, 8, 2, 6, 4))
    h, words, row, number = line_dedup.lines_of(*text_bytes(pa.array([text])))
    code, at = line_dedup.windows(h, words, row, 50, 3)
    assert len(code) == 8 and at.tolist() == [max(k for k in range(s, s + 3) if h[k] == h[s : s + 3].min()) for s in range(8)]
    assert len(set(at.tolist())) < 8


def test_extension_is_maximal():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        seeds = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
        if not seeds:
            continue
        i, j = (np.array(x) for x in zip(*seeds, strict=True))
        hashed = [line_dedup.mix64(np.array(x, np.uint64)) for x in (a, b)]
        first, last = line_dedup.extended(*hashed, i, j)
        for p, q, lo, hi in zip(i, j, first, last, strict=True):
            want_lo, want_hi = p, p
            while want_lo > 0 and q - (p - want_lo) > 0 and a[want_lo - 1] == b[q - (p - want_lo) - 1]:
                want_lo -= 1
            while want_hi + 1 < len(a) and q + want_hi - p + 1 < len(b) and a[want_hi + 1] == b[q + want_hi - p + 1]:
                want_hi += 1
            assert (lo, hi) == (want_lo, want_hi)


def test_a_long_text_of_equal_lines(spark):
    df = spark.createDataFrame([(1, "same line\n" * 20_000), (2, "other\n" + "same line\n" * 5)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.clean_text) for r in line_dedup.dedup_lines(spark, df, whole_runs=True).collect()}
    assert got == {1: (19_999, "same line\n"), 2: (5, "other\n")}


def test_toxicity_equals_brute_force(spark):
    """Document frequencies, ratios and scores, counted plainly over the n-grams of each text."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "gám", "ugly", "vile"][: 3 + 2 * (i % 2)]) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    plain = lambda t: {fold(t)[k : k + n] for n in (3, 4, 5) for k in range(len(t) - n + 1)}
    from tessera.llm.common import text_bytes

    number = lambda gram: next(f for f in toxicity.grams(*text_bytes(pa.array([gram])))[1] if f not in {x for g in plain(gram) - {gram} for x in toxicity.grams(*text_bytes(pa.array([g])))[1]}) if len(gram) > 3 else toxicity.grams(*text_bytes(pa.array([gram])))[1][0]
    every = {g: number(g) for g in set().union(*(plain(t) for _, t in docs))}
    counts = {g: [sum(g in plain(t) for i, t in docs if i % 2 == k) for k in (0, 1)] for g in every}
    batch = pa.record_batch([pa.array([i % 2 for i, _ in docs], pa.int32()), pa.array([t for _, t in docs])], ["toxic", "text"])
    ours = np.zeros((2, 1 << toxicity.HASH_BITS), np.int64)
    for out in toxicity._document_counts([batch]):
        for b, x in zip(out.column(0).to_pylist(), out.column(1), strict=True):
            ours[:, b << toxicity.BLOCK_BITS : (b + 1) << toxicity.BLOCK_BITS] += np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
    assert {g: ours[:, f].tolist() for g, f in every.items()} == counts
    ratio, _ = toxicity.log_ratios(ours[:, [every[g] for g in counts]], {0: 60, 1: 60})
    assert np.allclose(ratio, [np.log(((b + 1) / 62) / ((a + 1) / 62)) for a, b in counts.values()])
    model = toxicity.fit(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    assert np.count_nonzero(model.weights) > 3
    for r in toxicity.score(spark, spark.createDataFrame(docs, "doc_id long, text string"), model).collect():
        total = model.intercept + sum(model.weights[every[g]] for g in plain(r.text))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_archives_are_read_by_tasks_of_their_own(spark):
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.md5(F.col("id").cast("string"))).alias("html"))
    written = warc.write(spark, df.repartition(6))
    back = warc.read(written)
    many = written.count()
    assert many >= 1 and back.rdd.getNumPartitions() == many and back.count() == 4000


def embeddings():
    folder = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001").replace("sf0.001", "sf0.1")
    return f"{folder}/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(embeddings()), reason="no test data")
def test_search_recall_on_the_table(spark):
    df = spark.read.parquet(embeddings())
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = ann.search(spark, df, F.col("vec_id") % 10 == 0).toPandas().groupby("query_id").vec_id.agg(set)
    hit = total = 0
    for q in got.index:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        hit, total = hit + len(want & got[q]), total + 10
    assert total >= 500 and hit / total >= 0.9


def test_search_keeps_doubles(spark):
    rng = np.random.RandomState(3)
    x = rng.normal(size=(400, 8)) + 1e-12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.search(spark, df, F.col("vec_id") % 100 == 0, k=3).collect():
        assert abs(r.score - np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())) < 1e-14


def test_search_takes_queries_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.RandomState(5).normal(size=(900, 16)))], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann.search(spark, df, F.lit(True), k=4, probe_share=1.0).collect()))
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1)
    assert sorted(map(tuple, ann.search(spark, df, F.lit(True), k=4, probe_share=1.0).collect())) == whole and len(whole) == 3600


def test_clustered_vectors_need_few_lists():
    rng = np.random.RandomState(1)
    centre = rng.normal(size=(30, 16)) * 10
    near = (centre[rng.randint(30, size=3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    apart = rng.normal(size=(3000, 16)).astype(np.float32)
    assert ann.share_of_lists(near, ann.kmeans(near, 30), 10, 0.97) < 0.25 < ann.share_of_lists(apart, ann.kmeans(apart, 30), 10, 0.97)
