"""Conversation structure repair: the cheapest edits that give a conversation's roles the form ``(s?(ua)+)?``.

A row's role and first fault make it one of nine symbols, and a conversation a string of them. Re-Pair is run over the strings of all
conversations: in each round Spark counts neighbouring symbols, the most frequent pairs that share no symbol become
rules, and the strings are rewritten. The finite automaton of the form has four states (nothing yet, after system, after user,
after assistant); a symbol is a 4 x 4 matrix of (cost, audit) over the min-plus semiring, its entries the cheapest edits
that lead from a state to another, and a rule's matrix is the product of its two parts'. Rules are evaluated bottom-up, once
for all conversations, and a conversation is the balanced product of what its string was rewritten to.

Audits are ropes: a product joins two entries by reference, and compares those of equal cost by their hashes. Of edits
of the same rows and cost none is a prefix of another (they would differ by inserted rows alone, which cost), so the least
audit of a product is made of least audits of its parts, and the result is exact.

The grammar is bounded (``max_rules``), whatever the table's size; it only saves work, and any grammar gives the same result. What Spark
returns to the driver is at most ``PAIRS`` counts a round. A conversation is one value, as its audit and its repaired rows are;
its work is in proportion to its length times a logarithm.

Defined results: rows are ordered by turn (null first), then role, text; a null role or text is one space; rows without a conversation
are one conversation, with a null id; other roles than those that begin with s, u or a can't be kept. Other columns are not returned.
"""

from __future__ import annotations

import functools
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: States from which a user or an assistant row may follow.
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (START,)}
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Symbols: s, u, a and o(ther) for sound rows, in upper case for truncated ones, d for those that must go.
MUST_GO = "d"
FIRST_RULE = 0x100
PAIRS = 64

# --- ropes ------------------------------------------------------------------------------------------------------------

_MOD, _RADIX = (1 << 61) - 1, 0x1F3A5C7E9B2D4
_shift = functools.lru_cache(1 << 16)(lambda n: pow(_RADIX, n, _MOD))


class Rope:
    """A text that shares its parts; ``code`` is a rolling hash of it."""

    __slots__ = ("text", "left", "right", "size", "code")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.code = len(text), functools.reduce(lambda h, c: (h * _RADIX + ord(c)) % _MOD, text, 0)
        else:
            self.size, self.code = left.size + right.size, (left.code * _shift(right.size) + right.code) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        return Rope(self.text + other.text) if self.size + other.size <= 16 and self.left is None and other.left is None else Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.text)
            else:
                todo += (r.right, r.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """By code points; equal parts are passed over by their hashes."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size == y.size and x.code == y.code):
                continue
            if x.left is not None and (y.left is None or x.size >= y.size):
                a += (x.right, x.left)
                b.append(y)
            elif y.left is not None:
                b += (y.right, y.left)
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                elif y.size > n:
                    b.append(Rope(y.text[n:]))
        return bool(b)


# --- matrices ---------------------------------------------------------------------------------------------------------

Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]


def better(x: Entry, y: Entry) -> Entry:
    if x is None or y is None:
        return x if y is None else y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if y[1] < x[1] else x


def product(left: Matrix, right: Matrix) -> Matrix:
    rows = []
    for i in range(4):
        row: list[Entry] = [None] * 4
        for k, x in enumerate(left[i]):
            if x is not None:
                for j, y in enumerate(right[k]):
                    if y is not None and (row[j] is None or x[0] + y[0] <= row[j][0]):
                        row[j] = better(row[j], (x[0] + y[0], x[1] + y[1]))
        rows.append(tuple(row))
    return tuple(rows)


def _matrix(entries: dict[tuple[int, int], list[tuple[int, str]]]) -> Matrix:
    best = {at: min(ways) for at, ways in entries.items()}
    return tuple(tuple((best[i, j][0], Rope(best[i, j][1])) if (i, j) in best else None for j in range(4)) for i in range(4))


def inserts() -> Matrix:
    """Rows put between others: none, one or two; more lead back to where they began."""
    ways = {(i, i): [(0, "")] for i in range(4)}
    for i in (START, SYSTEM, ASSISTANT):
        ways.setdefault((i, USER), []).append((INSERT, "I"))
    for i in (START, SYSTEM):
        ways[i, ASSISTANT] = [(2 * INSERT, "II")]
    ways[USER, ASSISTANT] = [(INSERT, "I")]
    return _matrix(ways)


def row_matrix(symbol: str) -> Matrix:
    """One row's edits, and what may be put after it."""
    ways = {(i, i): [(DELETE, "D")] for i in range(4)}
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol.isupper() else 0
        own = STATE_OF.get(symbol.lower())
        for to, before in BEFORE.items():
            for i in before:
                if own == to:
                    ways.setdefault((i, to), []).append((extra, "K"))
                if to in NAMES:
                    ways.setdefault((i, to), []).append((extra + REROLE, "R"))
    return product(_matrix(ways), inserts())


@functools.lru_cache(4)
def matrices(rules: tuple[str, ...]) -> dict[str, Matrix]:
    """Of every symbol and, bottom-up, of every rule."""
    known = {x: row_matrix(x) for x in "suaoSUAOd"}
    for k, pair in enumerate(rules):
        known[chr(FIRST_RULE + k)] = product(known[pair[0]], known[pair[1]])
    return known


def rewrite(symbols: str, rules: tuple[str, ...]) -> str:
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(FIRST_RULE + k))
    return symbols


def cheapest(symbols: str, rules: tuple[str, ...]) -> tuple[int, str]:
    """The least cost of a string of symbols, and the least audit of that cost."""
    known = matrices(rules)
    parts = [known[c] for c in rewrite(symbols, rules)]
    while len(parts) > 1:
        parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    first = inserts()[START]
    ends: list[Entry] = list(first) if not parts else list(product((first, *[(None,) * 4] * 3), parts[0])[0])
    cost, audit = better(ends[START], ends[ASSISTANT])
    return cost, str(audit)


# --- conversations ----------------------------------------------------------------------------------------------------


def symbols_of(roles: list[str], texts: list[str]) -> tuple[str, Counter]:
    """A symbol for each row, and how many rows are blank, repeated and truncated."""
    out, faults, seen = [], Counter(), set()
    for role, text in zip(roles, texts, strict=True):
        bare = text.rstrip(BLANKS)
        again = (role, text) in seen
        seen.add((role, text))
        kind = role[:1] if role[:1] in STATE_OF else "o"
        if not bare:
            faults["blank"] += 1
            kind = MUST_GO
        elif again:
            faults["duplicate"] += 1
            kind = MUST_GO
        elif bare[-1] not in ".!?":
            faults["truncated"] += 1
            kind = kind.upper()
        out.append(kind)
    return "".join(out), faults


def applied(audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, at, state = [], 0, START
    for edit in audit:
        if edit in "RI":
            state = ASSISTANT if state == USER else USER
            out.append((NAMES[state], texts[at] if edit == "R" else ""))
        elif edit == "K":
            state = STATE_OF[roles[at][:1]]
            out.append((roles[at], texts[at]))
        at += edit != "I"
    return out


def _threads(batch: pa.RecordBatch):
    """Conversations of a batch: roles and texts of their rows."""
    rows = batch.column(batch.schema.get_field_index("rows"))
    edges = rows.offsets.to_pylist()
    flat = rows.values
    roles, texts = flat.field("role"), flat.field("text")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield roles.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist()


def _strings(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([symbols_of(r, t)[0] for r, t in _threads(batch)], pa.string())], ["symbols"])


def _pairs(rules: tuple[str, ...]):
    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = rewrite(symbols, rules)
                for pair in map("".join, zip(text, text[1:], strict=False)):
                    count[pair] += n
        yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["pair", "n"])

    return run


def grammar(strings: DataFrame, max_rules: int = 96, rounds: int = 10) -> tuple[str, ...]:
    """Rules, as pairs of symbols, from (``symbols``, ``n``): in each round the most frequent pairs that share no symbol."""
    rules: list[str] = []
    for _ in range(rounds):
        counts = strings.mapInArrow(_pairs(tuple(rules)), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counts.filter("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS).collect()
        taken: set[str] = set()
        before = len(rules)
        for row in best:
            if len(rules) < max_rules and not taken & set(row.pair):
                taken |= set(row.pair)
                rules.append(row.pair)
        if len(rules) == before:
            break
    return tuple(rules)


def _repaired(rules: tuple[str, ...]):
    def run(batches):
        known = functools.lru_cache(1 << 12)(lambda symbols: cheapest(symbols, rules))
        for batch in batches:
            blank, duplicate, truncated, cost, audits, rows = [], [], [], [], [], []
            for roles, texts in _threads(batch):
                symbols, faults = symbols_of(roles, texts)
                least, audit = known(symbols)
                blank.append(faults["blank"])
                duplicate.append(faults["duplicate"])
                truncated.append(faults["truncated"])
                cost.append(least)
                audits.append(audit)
                rows.append([{"role": r, "text": t} for r, t in applied(audit, roles, texts)])
            made = [*(pa.array(x, pa.int64()) for x in (blank, duplicate, truncated)), batch.column(2), pa.array(cost, pa.int64()), pa.array(audits, pa.string()), pa.array(rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
            yield pa.record_batch([batch.column(0), batch.column(1), *made], ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])

    return run


def repair_conversations(spark: SparkSession, rows: DataFrame, times: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rules: int = 96) -> DataFrame:
    """One row per conversation: its id, ``gaps`` in its turns, faults (``blank``, ``duplicate``, ``truncated``), ``illegal`` neighbours,
    ``cost`` and ``audit`` of the cheapest edits, and ``repaired``, the rows they leave. ``times`` says how often a row stands; a row
    that stands no time names its conversation all the same.
    """
    scratch = Scratch(spark, "conversation-repair")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    many = F.array(one) if times is None else F.array_repeat(one, times.cast("int"))
    threads = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.flatten(F.collect_list(many))).alias("rows"))
    turns = F.array_compact(F.transform("rows", lambda r: r["turn"]))
    gaps = F.when(F.size(turns) > 0, F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))).otherwise(F.lit(0)).cast("long")
    # places where a pair of neighbouring initials isn't one of three
    initial = F.transform("rows", lambda r: F.substring(r["role"], 1, 1))
    both = F.zip_with(F.slice(initial, 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice(initial, 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(both, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    table = scratch.table(threads.select("conv", gaps.alias("gaps"), illegal.alias("illegal"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows")), "threads")
    strings = scratch.table(table.select("rows").mapInArrow(_strings, "symbols string").groupBy("symbols").agg(F.count("*").alias("n")), "strings")
    rules = grammar(strings, max_rules)
    scratch.drop("strings")
    kind = threads.schema["conv"].dataType.simpleString()
    out = table.mapInArrow(_repaired(rules), f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>")
    return out.withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with faults, by a hash of conversation and turn, and how often each stands."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = (F.crc32(key.cast("binary")) % 20).cast("int")
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), times.alias("times")), F.col("times")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = repair_conversations(spark, rows, times)
    text = F.concat_ws("\n", F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))


def _sql_step(j: str, ways: list[tuple[str, str, str, str]]) -> str:
    """Least of (state, condition, cost, letters), as text of nine digits of cost, a colon and the audit."""
    each = [f"CASE WHEN {when} THEN lpad((substr({v}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{letters}' END" for v, when, cost, letters in ways]
    return f"least({', '.join(each)}) AS {j}" if len(each) > 1 else f"{each[0]} AS {j}"


_GO, _KEPT = "true", "NOT must"
_ROW_STEP = ", ".join([
    _sql_step("t0", [("v0", _GO, "2", "D")]),
    _sql_step("t1", [("v1", _GO, "2", "D"), ("v0", _KEPT + " AND kind = 's'", "extra", "K")]),
    _sql_step("t2", [("v2", _GO, "2", "D"), *[(f"v{i}", _KEPT + " AND kind = 'u'", "extra", "K") for i in (0, 1, 3)], *[(f"v{i}", _KEPT, "extra + 1", "R") for i in (0, 1, 3)]]),
    _sql_step("t3", [("v3", _GO, "2", "D"), ("v2", _KEPT + " AND kind = 'a'", "extra", "K"), ("v2", _KEPT, "extra + 1", "R")]),
])
_INSERT_STEP = ", ".join([
    "t0 AS v0, t1 AS v1",
    _sql_step("v2", [("t2", _GO, "0", ""), *[(f"t{i}", _GO, "5", "I") for i in (0, 1, 3)]]),
    _sql_step("v3", [("t3", _GO, "0", ""), ("t2", _GO, "5", "I"), *[(f"t{i}", _GO, "10", "II") for i in (0, 1)]]),
])

ORACLE = f"""
WITH RECURSIVE table_of AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)) AS bytes FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) % 20 AS fault FROM k, table_of),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, substr(role, 1, 1) AS kind, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM p),
s AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM f),
x AS (SELECT conv_id, i, role, text, kind, blank OR duplicate AS must, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM s),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(cut) AS truncated,
  count_if(next IS NOT NULL AND kind || substr(next, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM s GROUP BY conv_id),
dp(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, '000000000:', NULL::VARCHAR, '000000005:I', '000000010:II' FROM c
  UNION ALL SELECT conv_id, i, {_INSERT_STEP} FROM (SELECT dp.conv_id, x.i, {_ROW_STEP} FROM dp JOIN x ON x.conv_id = dp.conv_id AND x.i = dp.i + 1)),
e AS (SELECT conv_id, substr(least(v0, v3), 1, 9)::BIGINT AS cost, substr(least(v0, v3), 11) AS audit FROM dp JOIN c USING (conv_id) WHERE i = rows),
m(conv_id, audit, n, pos, state, line) AS (
  SELECT conv_id, audit, 0, 0::BIGINT, '', NULL::VARCHAR FROM e
  UNION ALL SELECT conv_id, audit, n, pos, CASE WHEN edit IN ('R', 'I') THEN turned ELSE coalesce(kept, state) END,
    CASE edit WHEN 'I' THEN CASE turned WHEN 'u' THEN 'user:' ELSE 'assistant:' END WHEN 'R' THEN CASE turned WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text WHEN 'K' THEN role || ':' || text END
  FROM (SELECT q.*, x.role, x.text, CASE WHEN edit = 'K' THEN kind END AS kept FROM (
    SELECT conv_id, audit, n + 1 AS n, pos + CASE WHEN substr(audit, n + 1, 1) = 'I' THEN 0 ELSE 1 END AS pos, state, substr(audit, n + 1, 1) AS edit, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS turned FROM m WHERE n < length(audit)) q
    JOIN x ON x.conv_id = q.conv_id AND x.i = greatest(q.pos, 1))),
r AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS repaired FROM m WHERE line IS NOT NULL GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c USING (conv_id) LEFT JOIN e USING (conv_id) LEFT JOIN r USING (conv_id)
"""
