"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal what they match.

Base spans are e-mail and IP addresses, card and phone numbers, leftmost and without overlap in their kind. The other words
of a document that holds one are its context, wherever they stand. What is protected are the values and their parts, which
many documents may share: local part and domain, the first half of an IP address, the first six digits of a number. Over the
whole corpus, p(e|t) is the share of the texts with the term t that hold the protected e too, drawn to p(e) with the weight of
``support`` texts. ``-log2 p(e|t)`` are the bits that still hide e from who reads t: e's own information less the mutual
information of both. They don't depend on the size of the table. A term with at most ``generalise_at`` bits is generalised, with
at most ``remove_at`` bits removed, at every occurrence in the documents that hold e, if chance doesn't explain it: given that
t occurs with e once, as every word of these documents does, the further texts with both must be so many that independent
draws would reach them with a probability of ``chance`` at most, over all terms tested for e (Chernoff's bound). So a word seen once,
or rare words met by chance, stay. A term that an e-mail address itself spells (``jane`` and ``doe`` in ``jane.doe@...``) is
the only one tested for that: one text can be enough, if most texts with the term hold such an address as well.
Copies of one text with e weigh as one. Texts without base spans stay as they are.

Only DataFrame functions are used. Patterns are written so that Java's matcher neither recurses nor rescans: separators
that can't be part of a match are first masked, one character for one, and runs are taken possessively.

Defined results: null counts as empty; null ids are kept and joined by text; rows that repeat an id and a text share
their spans; offsets are code points, ends are exclusive. Columns of the input named as the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, unused, without

KINDS = ("email", "ip", "card", "phone", "term")
MASK, MARK = "\u0001", "\u0003"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
#: Terms are runs of letters, marks and digits.
TERM, NO_TERM = r"[\p{L}\p{M}\p{N}]++", r"[^\p{L}\p{M}\p{N}]++"
#: Hashes of candidate terms (8 bytes each) up to this many are broadcast when their documents are counted.
BROADCAST_TERMS = 200_000
#: Pieces of addresses shorter than this aren't taken for names.
LEAST_NAME = 3


def marked_spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches of ``pattern`` as spans: each match is set between marks, and the pieces' lengths are added up."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    padded = F.lpad(number, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = sum((F.substring(padded if (18 - i) % 2 == 0 else doubled, i + 1, 1).cast("int") for i in range(19)), F.lit(0))
    return total % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Spans of each base kind in ``text`` (free of the mask and mark characters)."""
    none = F.expr(f"cast(array() as {SPAN})")
    local = rf"[A-Za-z0-9._%+{MASK}-]"
    dots = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", MASK)
    email = marked_spans(dots, rf"(?:(?<!{local})|\G){local}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++", 0)
    email = F.transform(email, lambda s: s.withField("value", F.translate(s["value"], MASK, ".")))
    ip = marked_spans(text, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1)
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"
    ip = F.filter(ip, lambda s: s["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
    runs = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", MASK)
    card = marked_spans(runs, "[0-9][0-9 -]++", 2)
    card = F.filter(card, lambda s: F.length(digits(s["value"])).between(13, 19) & luhn(F.substring(digits(s["value"]), 1, 19)))
    phone = marked_spans(text, r"\+[0-9][ ().0-9-]+[0-9]", 3)
    phone = F.filter(phone, lambda s: F.length(digits(s["value"])).between(9, 15))
    return [
        F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), ip).otherwise(none),
        F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), card).otherwise(none),
        F.when(F.contains(text, F.lit("+")), phone).otherwise(none),
    ]


def may_hold(text: Column) -> Column:
    """Whether ``text`` has what every base span has, which is cheap to see."""
    return F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")) | text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[ -]?[0-9]){12}")


def clean_of_marks(text: Column) -> Column:
    """``text`` with the characters that serve as mask and mark replaced, one for one, by another that nothing matches."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(MASK)) | F.contains(text, F.lit(MARK)), F.translate(text, MASK + MARK, "\u0002\u0002")).otherwise(text)


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces, one for one, in place of what ``spans`` cover."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def put(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["text"], kept, F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))).alias("text"))

    return F.aggregate(ordered, begin, put, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def row_key(id_col: Column, text: Column) -> Column:
    """A key of rows that repeat an id (null too) and a text."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), id_col.cast("string")), F.lit("n")), F.lit(":"), text)


def protected(span: Column) -> Column:
    """What a base span protects: its value and the parts of it that others may share."""
    mail, number = F.lower(span["value"]), digits(span["value"])
    local, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    return (
        F.when(span["kind"] == 0, F.array(F.concat(F.lit("0:"), mail), F.concat(F.lit("local:"), local), F.concat(F.lit("domain:"), domain)))
        .when(span["kind"] == 1, F.array(F.concat(F.lit("1:"), span["value"]), F.concat(F.lit("net:"), F.substring_index(span["value"], ".", 2))))
        .otherwise(F.array(F.concat_ws(":", span["kind"].cast("string"), number), F.concat(F.lit("begin:"), span["kind"].cast("string"), F.lit(":"), F.substring(number, 1, 6))))
    )


def names_of(base: Column) -> Column:
    """Pieces of e-mail addresses, but for the last of the domain."""
    pieces = F.transform(F.filter(base, lambda s: s["kind"] == 0), lambda s: F.split(F.regexp_replace(F.lower(s["value"]), r"[.][a-z0-9-]+$", ""), "[^a-z0-9]+"))
    return F.filter(F.flatten(pieces), lambda w: F.length(w) >= LEAST_NAME)


def log_chance(hits: Column, expected: Column) -> Column:
    """Chernoff's bound of the logarithm of the probability that independent draws reach ``hits``."""
    return F.when(hits <= expected, 0.0).otherwise(hits * F.log(expected / hits) + hits - expected)


def disclosing_terms(docs: DataFrame, found: DataFrame, scratch: Scratch, generalise_at: float, support: int, chance: float, least_length: int, text_col: str) -> DataFrame:
    """(text, code, bits): the terms (their hashes) of a text that leave at most ``generalise_at`` bits of what it protects, more than chance would.

    What the same texts hold is one class: it has the same terms and shares. A class of one text has no further texts to test.
    """
    texts = scratch.table(found.groupBy("__text").agg(F.first("base").alias("base"), F.first("__words").alias("__words"), F.sum("__rows").alias("__rows")), "texts")
    parts = texts.select("__text", "__rows", F.explode(F.array_distinct(F.flatten(F.transform("base", protected)))).alias("entity"))
    sets = parts.groupBy("entity").agg(F.sum("__rows").alias("rows_e"), F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("__text")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "__text")).alias("y"))
    sets = sets.filter("n_e > 1").select("entity", "rows_e", "n_e", F.xxhash64("rows_e", "n_e", "x", "y").alias("class"))
    classes = scratch.table(parts.join(sets, "entity").select("__text", "class", "rows_e", "n_e").distinct(), "classes")
    near = classes.join(texts.select("__text", "__rows", "__words"), "__text").select("__text", "__rows", "class", "rows_e", "n_e", F.explode("__words").alias("code"))
    pairs = near.groupBy("class", "code").agg(F.sum("__rows").alias("rows_et"), F.count("*").alias("n_et"), F.max("rows_e").alias("rows_e"), F.max("n_e").alias("n_e"))
    pairs = scratch.table(pairs, "pairs")
    tests = pairs.groupBy("class").agg(F.count("*").alias("tests"))
    several = pairs.filter("n_et > 1").join(tests, "class")
    spelled = texts.select("__text", "__rows", F.explode(F.array_intersect("__words", F.transform(names_of(F.col("base")), lambda w: F.xxhash64(w)))).alias("code"))
    spelled = scratch.table(spelled, "spelled")
    alone = spelled.groupBy("code").agg(F.sum("__rows").alias("rows_et"), F.count("*").alias("n_et"))
    terms = scratch.table(several.select("code").union(alone.select("code")).distinct(), "terms")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_col), NO_TERM))).alias("term")).filter(F.length("term") >= least_length)
    held = words.select(F.xxhash64("term").alias("code"))
    if terms.count() <= BROADCAST_TERMS:
        held = held.join(F.broadcast(terms), "code", "left_semi")
    held = scratch.table(held.groupBy("code").agg(F.count("*").alias("rows_t")), "held")
    rows = float(docs.count())
    told = several.join(held, "code")
    n_t = F.col("n_et") + F.greatest(F.col("rows_t") - F.col("rows_et"), F.lit(0))
    size = rows - F.col("rows_e") + F.col("n_e")
    bits = -F.log2((F.col("n_et") + support * F.col("n_e") / size) / (n_t + support))
    luck = log_chance(F.col("n_et") - 1, (n_t - 1) * (F.col("n_e") - 1) / size) + F.log("tests")
    told = told.select("class", "code", bits.alias("bits"), luck.alias("luck")).filter((F.col("bits") <= generalise_at) & (F.col("luck") <= math.log(chance)))
    told = scratch.table(told.select("class", "code", "bits"), "told")
    named = alone.join(held, "code")
    size = rows - F.col("rows_et") + F.col("n_et")
    named = named.select("code", F.log2(n_t / F.col("n_et")).alias("bits"), log_chance(F.col("n_et"), n_t * F.col("n_et") / size).alias("luck"))
    named = scratch.table(named.filter((F.col("bits") <= generalise_at) & (F.col("luck") <= math.log(chance))).select("code", "bits"), "named")
    both = near.join(told, ["class", "code"]).select("__text", "code", "bits").union(spelled.join(named, "code").select("__text", "code", "bits"))
    return scratch.table(both.groupBy("__text", "code").agg(F.min("bits").alias("bits")), "told-texts")


def sanitise(spark: SparkSession, docs: DataFrame, generalise_at: float = 0.9, remove_at: float = 0.25, support: int = 2, chance: float = 0.05, least_length: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base`` and ``spans`` (arrays of kind, start, end, value) and ``clean_text``.

    Base spans become ``[EMAIL]`` and so on; a generalised term becomes ``[TERM]``, a removed one nothing; of overlapping
    spans the one that starts first (the longest of those) is replaced, with all it covers.
    """
    scratch = Scratch(spark, "pii")
    own = ("n_email", "n_ip", "n_card", "n_phone", "base", "spans", "clean_text")
    docs = without(docs, *own)
    text = F.col("__t")
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    prepared = docs.select(row_key(F.col(id_col), key).alias("__key"), key.alias("__text"), clean_of_marks(F.col(text_col)).alias("__t"))
    holding = prepared.filter(may_hold(text))
    spans = holding.select("__key", "__text", "__t", *[c.alias(f"__{k}") for c, k in zip(base_spans(text), KINDS, strict=False)])
    spans = spans.withColumn("base", F.concat(*[F.col(f"__{k}") for k in KINDS[:4]])).filter(F.size("base") > 0)
    found = spans.select("__key", "__text", blanked(text, F.col("base")).alias("__t"), "base")
    found = found.groupBy("__key", "__text").agg(F.first("__t").alias("__t"), F.first("base").alias("base"), F.count("*").alias("__rows"))
    words = F.filter(F.array_distinct(F.transform(F.split(text, NO_TERM), lambda w: F.lower(w))), lambda w: F.length(w) >= least_length)
    words = F.transform(words, lambda w: F.xxhash64(w))
    found = scratch.table(found.withColumn("__words", words), "found")
    told = disclosing_terms(docs, found, scratch, generalise_at, support, chance, least_length, text_col)
    # every second piece is a term; a row for each, as an array that grows by its terms would be copied for each of them
    pieces = found.join(told.select("__text").distinct(), "__text", "left_semi").select("__key", "__text", F.posexplode(F.split(F.regexp_replace(text, TERM, f"{MARK}$0{MARK}"), MARK, -1)).alias("place", "value"))
    upto = Window.partitionBy("__key").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("end", F.sum(F.char_length("value")).over(upto).cast("int")).filter("place % 2 = 1")
    hits = pieces.select("__key", "__text", F.xxhash64(F.lower("value")).alias("code"), (F.col("end") - F.char_length("value")).alias("start"), "end", "value").join(told, ["__text", "code"])
    hits = hits.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "bits"))).alias("__terms"))
    terms = F.transform("__terms", lambda t: F.struct(F.lit(4).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.when(t["bits"] <= remove_at, F.lit("")).otherwise(F.lit("[TERM]")).alias("value")))
    known = found.select("__key", "base").join(hits, "__key", "left").select("__key", "base", F.coalesce(terms, F.expr(f"cast(array() as {SPAN})")).alias("__added"))
    row, added = unused(docs, "row_key", "added_terms")
    known = known.withColumnsRenamed({"__key": row, "__added": added})
    # rows that can't hold a span aren't shuffled with their texts
    mine = may_hold(clean_of_marks(F.col(text_col)))
    rest = docs.filter(~mine).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema])
    out = docs.filter(mine).join(known, row_key(F.col(id_col), key) == F.col(row), "left").unionByName(rest)
    none = F.expr(f"cast(array() as {SPAN})")
    out = out.withColumn("base", F.coalesce("base", none)).withColumn(added, F.coalesce(added, none))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": many(i) for i, k in enumerate(KINDS[:4])}
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])
    ordered = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.element_at(labels, s["kind"] + 1).alias("put"))), F.transform(added, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["value"].alias("put")))))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    put = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct((-s["end"]).alias("at"), F.concat(acc["text"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), s["put"]).alias("text"))).otherwise(acc)
    clean = F.when(F.size(ordered) == 0, F.col(text_col)).otherwise(F.aggregate(ordered, begin, put, lambda acc: F.concat(acc["text"], F.substring(whole, acc["at"] + 1, F.char_length(whole)))))
    return out.withColumns(counts | {"clean_text": clean, "spans": F.concat("base", added)}).drop(row, added)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
