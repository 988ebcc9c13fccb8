"""Chat formatting in Spark expressions.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into blocks by array
functions (where roles change, a block begins; a slice of the turns is a block), and blocks are concatenated::

    ### role: text<cut>text</turn>\\n

``<cut>`` stands between the texts of merged turns. Roles and texts are escaped: ``\\`` becomes ``\\b``, ``<`` ``\\l``,
``#`` ``\\h``, and in roles ``:`` ``\\c``. So no control string can occur inside one, whatever it says, and unescaping gives
back each text exactly. ``loss_spans`` are the places of assistant texts (code points, end exclusive), without cuts.

Defined results: null texts and roles are empty; turns with equal numbers are ordered by role, then text, null numbers
first; each row with a null ``conv_id`` is a conversation of its own, so that such rows, however many, meet in no task; repeated rows are turns like others; no rows give no
conversations. Extra columns are ignored. A conversation is one value of the result, and so is held by one task, whose work
grows with the conversation's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, CUT, NAMED = "### ", "</turn>\n", "<cut>", ": "
TRICKY = "\\### Assistant: </turn> ok"
#: Numbers of a running sum, and code points of a text, that are taken together.
STRIDE, PIECE = 256, 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once, however often ``use`` names it, also inside of functions of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column) -> Column:
    """What the numbers before each one of a non-empty array add up to."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v)

    def parted(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(STRIDE)), lambda at: F.slice(x, at + 1, STRIDE))

    def begins(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + total(part))))

    def inside(parts: Column, begin: Column) -> Column:
        return F.flatten(F.transform(parts, lambda part, k: F.transform(part, lambda v, i: F.get(begin, k) + total(F.slice(part, F.lit(1), i)))))

    return let(numbers, lambda x: let(parted(x), lambda parts: let(begins(parts), lambda begin: inside(parts, begin))))


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for coded, plain in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(chats: DataFrame, trained_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (array of start, end)."""
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    turns = chats.select(F.col(conv_col).alias("conv_id"), alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns")).drop("alone")
    head = lambda role: F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(NAMED))
    same = lambda i: (i > 0) & (F.get("turns", i)["role"] == F.get("turns", i - 1)["role"])

    def blocks(starts: Column) -> Column:
        def block(at: Column, k: Column) -> Column:
            own = F.slice("turns", at + 1, F.coalesce(F.get(starts, k + 1), F.size("turns")) - at)
            return F.concat(head(F.get("turns", at)["role"]), F.array_join(F.transform(own, lambda t: escape(t["text"])), CUT), F.lit(CLOSE))

        return F.array_join(F.transform(starts, block), "")

    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: ~same(i))
    whole = let(starts, blocks)

    def mark(t: Column, i: Column) -> Column:
        lead = F.when(same(i), len(CUT)).otherwise(F.when(i > 0, len(CLOSE)).otherwise(0) + F.char_length(head(t["role"])))
        return F.struct((t["role"] == trained_role).alias("trained"), lead.alias("lead"), F.char_length(escape(t["text"])).alias("size"))

    def spans(marks: Column, before: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = (F.get(before, i) + m["lead"]).cast("int")
            return F.struct(m["trained"].alias("trained"), start.alias("start"), (start + m["size"]).alias("end"))

        return F.transform(F.filter(F.transform(marks, span), lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    placed = let(F.transform("turns", mark), lambda marks: let(running(F.transform(marks, lambda m: m["lead"] + m["size"])), lambda before: spans(marks, before)))
    return turns.select("conv_id", whole.alias("formatted"), placed.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b, i: b != "")

    def turns(b: Column) -> Column:
        def texts(role: Column) -> Column:
            said = F.split(F.substring(b, F.char_length(role) + len(OPEN) + len(NAMED) + 1, F.char_length(b)), CUT, -1)
            return let(unescape(role), lambda name: F.transform(said, lambda t: F.struct(name.alias("role"), unescape(t).alias("text"))))

        return let(F.substring_index(F.substring(b, F.lit(len(OPEN) + 1), F.char_length(b)), NAMED, 1), texts)

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""

    def cut(pieces: Column) -> Column:
        def text(s: Column) -> Column:
            first = F.floor(s["start"] / PIECE).cast("int")
            around = F.array_join(F.slice(pieces, first + 1, F.floor((s["end"] - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(s["end"] > s["start"], unescape(F.substring(around, s["start"] % PIECE + 1, s["end"] - s["start"]))).otherwise("")

        return F.array_join(F.transform(spans, text), "")

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    formatted = format_chats(chats.union(tricky))
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS i, (lag(role) OVER w) IS DISTINCT FROM role AS fresh,
    replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS text_e,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS role_e
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text_e) + CASE WHEN fresh THEN length(role_e) + 14 ELSE 5 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
