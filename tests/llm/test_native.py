"""Mixing, sharding, chat formatting and personal data: DataFrame expressions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, pii, sharding


def test_mixing_copies_are_poisson_draws(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a" if i % 3 else "b", 1) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"a": 1.0, "b": 2.0}
    got = Counter(r.doc_id for r in mixing.mix_sources(spark, docs, weights).select("doc_id").collect())
    n = {"a": 600, "b": 300}
    for i in range(900):
        s = "a" if i % 3 else "b"
        rate = 900 * weights[s] / 3 / n[s]
        u, k, p, total = int(hashlib.md5(f"20:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate), 0.0
        while (total := total + p) <= u:
            k += 1
            p *= rate / k
        assert got[i] == k
    assert got == Counter(r.doc_id for r in mixing.mix_sources(spark, docs.repartition(7), weights).select("doc_id").collect())


def test_mixing_large_rates_and_salted_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "x", "big", 1) for i in range(400)] + [(1000, "t", "x", "rare", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"big": 0.0, "rare": 1.0}
    out = mixing.mix_sources(spark, docs, weights, epochs=10)
    assert abs(out.count() - 4010) < 10 * math.sqrt(4010) and out.select("doc_id").distinct().count() == 1
    plain = sorted(map(tuple, mixing.mix_sources(spark, docs).select("doc_id", "copy", "mix_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_sources(spark, docs).select("doc_id", "copy", "mix_key").collect())) == plain
    with pytest.raises(ValueError):
        mixing.mix_sources(spark, docs, {"big": -1.0})


def test_rows_without_id_are_dealt_over_partitions(spark):
    many = spark.range(0, 6000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("x").alias("lang"), F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert mixing.mix_sources(spark, many, {"s": 1.0}, epochs=3).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset(key)


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix_sources(spark, odd_docs, epochs=3)
    assert set(out.columns) == set(odd_docs.columns) | {"mix_key"} and out.count() > 0
    assert dict(out.dtypes)["n_copies"] == "bigint" and mixing.mix_sources(spark, no_docs).count() == 0
    each = defaultdict(set)
    for r in out.filter("doc_id = 1").collect():
        each[r.doc_id].add(r.n_copies)
    assert all(len(v) == 1 for v in each.values())


def leaf(tree, key):
    at = ""
    below = tree.children()
    while at in below:
        draws = []
        for path, weight in below[at]:
            h = int(hashlib.md5(f"{key}:{path}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((h + 0.5) / 2**52) / weight, path))
        at = min(draws)[1]
    return int(at.split("/")[-1])


def test_sharding_against_a_plain_tree(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}", None, None, None) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = sharding.shard_documents(spark, docs).collect()
    tree = sharding.even_tree()
    slots = defaultdict(list)
    for r in rows:
        text = f"text {r.doc_id % 50}".encode()
        assert (r.shard, r.size, r.text_crc32) == (leaf(tree, str(r.doc_id)), len(text) + 8, zlib.crc32(text))
        assert r.grown_shard == leaf(tree.grown(), str(r.doc_id)) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 24
    assert 20 < sum(r.grown_shard == 24 for r in rows) < 160


def test_sharding_grows_only_into_new_shards():
    tree = sharding.even_tree(2, 2, 2)
    for n in range(8, 14):
        grown = tree.grown()
        assert all(leaf(grown, str(k)) in (leaf(tree, str(k)), n) for k in range(300))
        tree = grown


def test_sharding_odd_rows(spark, odd_docs, no_docs):
    assert "slot_order" in sharding.shard_documents(spark, odd_docs.withColumn("slot_order", F.lit("mine")), keep=("slot_order",)).filter("slot_order = 'mine'").columns
    many = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r.slot for r in sharding.shard_documents(spark, many).collect()) == list(range(500))
    rows = sharding.shard_documents(spark, odd_docs, keep=("lang", "shard")).collect()
    assert len(rows) == 12 and all(r.size >= 8 and r.text_crc32 >= 0 for r in rows) and "lang" in rows[0]
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and sharding.shard_documents(spark, no_docs).count() == 0
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {8}


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again <cut> \\c"), (1, 2, "assistant", "### user: x</turn>\n"), (1, 3, "assistant", ""), (1, 3, "assistant", "tie \\\\ \\b"),
    (2, None, "system", None), (2, 0, None, "x"), (2, 1, "a:b", "y"), (2, 1, "a:b", "y"), (None, 0, "assistant", "漢字 🦆"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*c, "extra") for c in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    rows = out.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(rows) == 3
    for r in rows:
        own = sorted(((c[1] is not None, c[1] or 0), c[2] or "", c[3] or "") for c in CHATS if c[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(t for _, role, t in own if role == "assistant")
    first = next(r for r in rows if r.conv_id == 1)
    assert first.formatted.count("### ") == 2 and first.formatted.count("</turn>\n") == 2  # merged, and nothing else looks like a mark
    assert chat.format_chats(df.limit(0)).count() == 0
    twice = chat.format_chats(df.filter("conv_id is null").union(df.filter("conv_id is null"))).collect()
    assert [r.conv_id for r in twice] == [None, None] and len({r.formatted for r in twice}) == 1


def test_long_conversations(spark):
    """More turns than a stride, texts longer than a piece, runs of one role and roles in turn."""
    rows = [(1, i, "user" if i % 7 < 4 else "assistant", f"<{i}>#" + "ä" * (i % 50)) for i in range(1500)] + [(2, 0, "assistant", "🦆" * 9000), (2, 1, "user", ""), (2, 2, "assistant", "x")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in own]
        assert r.loss == "".join(text for _, _, role, text in own if role == "assistant")
        assert len(r.loss_spans) == sum(x[2] == "assistant" for x in own) and all("<cut>" not in r.formatted[s.start : s.end] for s in r.loss_spans)


E_ = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I_ = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C_ = re.compile(r"[0-9]([\x20-]?[0-9])+")
P_ = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m) for m in E_.finditer(text)] + [("ip", m) for m in I_.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in C_.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))] + [("phone", m) for m in P_.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


TEXTS = [
    "a@b.c_d@e.f..g@h.i. x@y x@.y x@y..z %@a-b.c-", "a@b.c.d.@e.f é@ü.de q.@r.s.t", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.000255.0 999.1.1.1.1", "4111 1111 1111 1111, 4111-1111--1111-1111 41111111111111112 1 2", "4111 1111 1111 1111 5 6011000990139424 - 0",
    "+1 (800) 555-0199 ++49 30 1234567 +12 +1234567890123456 +1.2", "\u0001a@b.c\u0003 4111111111111111 漢🦆 +44 20 7946 0958", "@" * 50 + "a@b.c" * 3, "0" * 400 + ".1.2.3", "", "nothing here",
]


def test_base_spans_equal_plain_patterns(spark):
    texts = [*TEXTS, "a" * 200_000 + "@b.c" + ".d" * 20_000, "1 " * 30_000, "9-" * 20_000 + "1.2.3.4", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(spark, df).collect():
        want = base(texts[r.doc_id] or "")
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] == want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == w[0] for w in want) for k in pii.KINDS[:4])


def test_disclosing_terms_are_found_and_replaced(spark):
    rows = [(i, f"Report {i}: Quarnhilde wrote from q.h@corp.example today about item {i * 7919}.") for i in range(6)]
    rows += [(100 + i, f"Today a report about item {i} was wrote and from nobody.") for i in range(200)]
    out = {r.doc_id: r for r in pii.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        terms = {rows[i][1][s.start : s.end] for s in out[i].spans if s.kind == 4}
        assert "Quarnhilde" in terms and not {"wrote", "today", "from"} & terms
        assert "Quarnhilde" not in out[i].clean_text and "[EMAIL]" in out[i].clean_text and "today" in out[i].clean_text
    assert all(out[100 + i].clean_text == rows[6 + i][1] and not out[100 + i].spans for i in range(200))


@pytest.mark.parametrize("size", [400, 20_000])
def test_names_and_terms_are_taken_and_rare_words_stay(spark, size):
    """The same decisions at two sizes of the table: planted names and bound terms go, words seen once or by chance stay."""
    filler = "On any day a report can be reached, ask. "
    texts = [f"Velmira Osk: {filler}velmira.osk@y.example. Zwirbel {filler}Velmira", f"Krumhorn under b@x.example. {filler}"]
    texts += [f"Item {i}: Quarnhilde, desk K77 漢字, is at help@corp.example. {filler * 3}Ng, quarnhilde of row {i}x{i * i}" for i in range(12)]
    texts += [f"Lorsk a{i} {filler}c{i}@two.example" for i in range(2)]
    planted = len(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rows.union(spark.range(planted, size).selectExpr("id AS doc_id", f"concat('{filler}', id, ' item and row at desk')"))
    out = {r.doc_id: r for r in pii.sanitise(spark, rows).filter("doc_id < 100 OR size(spans) > 0").collect()}
    terms = [[texts[i][s.start : s.end] for s in out[i].spans if s.kind == 4] for i in range(planted)]
    assert terms[0] == ["Velmira", "Osk", "Velmira"] and terms[1] == [] and terms[-2:] == [[], []]
    assert all(t == ["Quarnhilde", "K77", "漢字", "is", "Ng", "quarnhilde", "of"] for t in terms[2:14])
    assert out[0].clean_text == f" : {filler}[EMAIL]. Zwirbel {filler}" and not any(r.spans for i, r in out.items() if i >= planted)


def test_names_that_many_texts_use_stay(spark):
    texts = ["Ask the office: office@x.example or Brunhowe: brunhowe@x.example"] + [f"The office is open on day {i}" for i in range(300)]
    out = {r.doc_id: r for r in pii.sanitise(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [texts[0][s.start : s.end] for s in out[0].spans if s.kind == 4] == ["Brunhowe"] and not any(out[i].spans for i in range(1, 301))


def test_terms_equal_brute_force(spark, monkeypatch):
    """Bits and chance of every term, counted plainly, with and without the broadcast of candidates."""
    rng = random.Random(12)
    texts = []
    for i in range(400):
        w = [rng.choice(["on", "any", "day", "report", "ask", "of", f"t{rng.randrange(60)}", f"Name{rng.randrange(400)}"]) for _ in range(rng.randrange(3, 30))]
        if i % 4 == 0:
            u = rng.randrange(25)
            w.insert(rng.randrange(len(w)), f"user{u}@d{u % 7}.example")
            w.insert(rng.randrange(len(w)), f"Bound{u}")
            w.extend([f"user{u}"] * (u % 3 == 0))
        texts.append(" ".join(w))
    texts += [texts[0], texts[4], texts[4]]
    mail, word = re.compile(r"user[0-9]+@d[0-9]\.example"), re.compile(r"\w+")
    context = [{w.lower() for w in word.findall(mail.sub(lambda m: " " * len(m.group()), t))} for t in texts]
    whole = [{w.lower() for w in word.findall(t)} for t in texts]
    held = [{x for m in mail.findall(t) for x in (m, "local:" + m.split("@")[0], "domain:" + m.split("@")[1])} for t in texts]
    spelled = [{x for m in mail.findall(t) for x in re.split("[@.]", m)[:-1] if len(x) >= 3} for t in texts]
    bound = lambda hits, expected: 0.0 if hits <= expected else hits * math.log(expected / hits) + hits - expected
    told, limit, unlucky = [{} for _ in texts], math.log(0.05), 0

    def put(i, t, bits):
        told[i][t] = min(bits, told[i].get(t, 99.0))

    for e in set().union(*held):
        own = [i for i in range(len(texts)) if e in held[i]]
        n_e = len({texts[i] for i in own})
        tested = set().union(*(context[i] for i in own))
        for t in tested:
            both = [i for i in own if t in context[i]]
            n_et = len({texts[i] for i in both})
            n_t, n = n_et + max(sum(t in w for w in whole) - len(both), 0), len(texts) - len(own) + n_e
            bits = -math.log2((n_et + 2 * n_e / n) / (n_t + 2))
            if n_et > 1 and bits <= 0.9:
                if bound(n_et - 1, (n_t - 1) * (n_e - 1) / n) + math.log(len(tested)) <= limit:
                    for i in both:
                        put(i, t, bits)
                else:
                    unlucky += 1
    for t in set().union(*spelled):
        both = [i for i in range(len(texts)) if t in spelled[i] and t in context[i]]
        n_et = len({texts[i] for i in both})
        if n_et:
            n_t, n = n_et + max(sum(t in w for w in whole) - len(both), 0), len(texts) - len(both) + n_et
            if math.log2(n_t / n_et) <= 0.9 and bound(n_et, n_t * n_et / n) <= limit:
                for i in both:
                    put(i, t, math.log2(n_t / n_et))
    assert sum(map(len, told)) > 50 and unlucky and any(b <= 0.25 for d in told for b in d.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (pii.BROADCAST_TERMS, 0):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        for r in pii.sanitise(spark, df).collect():
            plain = mail.sub(lambda m: " " * len(m.group()), r.text)
            want = [(m.start(), m.end(), "" if told[r.doc_id][m.group().lower()] <= 0.25 else "[TERM]") for m in word.finditer(plain) if m.group().lower() in told[r.doc_id]]
            assert [(s.start, s.end, s.value) for s in r.spans if s.kind == 4] == want


def test_pii_odd_rows(spark, odd_docs, no_docs):
    out = pii.sanitise(spark, odd_docs)
    rows = out.collect()
    assert len(rows) == 12 and sum(r.n_email for r in rows) == 1 and pii.sanitise(spark, no_docs).count() == 0
    hit = next(r for r in rows if r.n_email)
    assert hit.clean_text == hit.text.replace("x@y.zz", "[EMAIL]") and next(r for r in rows if r.doc_id == 3).clean_text is None
