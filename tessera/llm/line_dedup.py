"""Line dedup by winnowing over line hashes.

A line is what stands between newlines, without white space around it; blank lines don't count. From each line on, the
shortest run of lines that has ``min_words`` words or ``min_lines`` lines is a window. A window selects its smallest line
hash (the last of equal ones): equal windows select the same line, wherever they stand, so any repeated run that holds a
window is guaranteed to share a fingerprint. A selected line is kept once, with its position and the hashes of the windows
that select it. Positions are joined on fingerprint and window with the earliest position (by id, then text, then line) that
has both. Each pair of positions, which is a match of one line so far, is extended line by line both ways, as far as both
texts agree, and what the maximal runs of a text cover is deleted there, with its newlines.

A run's last lines may be too few for a window from any of them on, and another text than the earliest may share them. With
``whole_runs`` the shortest runs that end at each line are windows too, so that these lines are found; without, they are kept.

Groups are never gathered: each window is reduced to its earliest position before anything is joined back, so a line that a
third of all documents hold costs a row for each of them. Extension compares running hashes by bisection: a text of equal
lines costs its length times a logarithm.

Defined results: null texts stay null and have no lines; rows that repeat an id and a text are one place, and are treated
alike; a null id counts as later than any other; a run that overlaps its own earlier occurrence keeps the first line it
repeats. Columns of the input named as the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_HASH, Scratch, mix64, powers, row_slices, text_bytes, unused, without, words_of

NEWLINE = 0x0A


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that aren't blank: hashes, words, rows, and their numbers among all lines of their rows."""
    _, start, end, row = words_of(buf, off, BYTE_HASH)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    broken = np.concatenate(([0], np.cumsum(buf == NEWLINE)))
    number = broken[start] - broken[off[row]]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(number) != 0))))
    last = np.append(first[1:], len(start)) - 1
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_HASH[buf] * up[: len(buf)], out=total[1:])
    return mix64((total[end[last]] - total[start[first]]) * down[start[first]]), last - first + 1, row[first], number[first]


def window_ends(words: np.ndarray, min_words: int, min_lines: int) -> np.ndarray:
    """The last line of the shortest run from each line on, as if lines went on for ever."""
    run = np.concatenate(([0], np.cumsum(words)))
    return np.minimum(np.searchsorted(run, run[:-1] + min_words) - 1, np.arange(len(words)) + min_lines - 1)


def windows(h: np.ndarray, words: np.ndarray, row: np.ndarray, min_words: int, min_lines: int, whole_runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window and the line that it selects; with ``whole_runs`` also of the shortest ones that end at each line."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(words)))
    first, last = np.arange(n), window_ends(words, min_words, min_lines)
    edge = np.searchsorted(row, row, "right")
    inside = (last < edge) & ((run[np.minimum(last, n - 1) + 1] - run[:-1] >= min_words) | (last - first + 1 >= min_lines))
    first, last = first[inside], last[inside]
    if whole_runs:
        end = np.arange(n)
        begin = np.maximum(np.searchsorted(run, run[1:] - min_words, "right") - 1, end - min_lines + 1)
        on = (begin >= np.searchsorted(row, row)) & ((run[1:] - run[np.maximum(begin, 0)] >= min_words) | (end - begin + 1 >= min_lines))
        both = np.unique(np.stack((np.append(first, begin[on]), np.append(last, end[on])), 1), axis=0)
        first, last = both[:, 0], both[:, 1]
    code, least, at = np.zeros(len(first), np.uint64), h[first], first
    for k in range(min_lines):
        on = first + k <= last
        line = h[np.minimum(first + k, n - 1)]
        code = np.where(on, mix64(code ^ line), code)
        at = np.where(on & (line <= least), first + k, at)
        least = np.where(on, np.minimum(least, line), least)
    return code, at


PLACE = ("none", "id", "text_key")
SELECTED = "none boolean, id long, text_key long, hashes array<long>, words array<int>, numbers array<int>, selected array<struct<fingerprint:long,at:int,windows:array<long>>>"


def _selected(min_words: int, min_lines: int, whole_runs: bool):
    """Of each text that has windows: its lines, and the selected ones with their positions and windows; lines are numbered as ``split`` by newlines does."""

    def run(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(3))
            for i, j in row_slices(off):
                h, words, row, number = lines_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                code, at = windows(h, words, row, min_words, min_lines, whole_runs)
                order = np.argsort(at, kind="stable")
                code, at = code[order], at[order]
                edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[: len(at)])
                at = at[edges]
                begin = np.searchsorted(row, np.arange(j - i + 1))
                held = np.searchsorted(row[at], np.arange(j - i + 1))
                lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                chosen = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array((at - begin[row[at]]).astype(np.int32)), lists(code.view(np.int64), np.append(edges, len(code)))], ["fingerprint", "at", "windows"])
                out = [*(batch.column(k).slice(i, j - i) for k in range(3)), lists(h.view(np.int64), begin), lists(words.astype(np.int32), begin), lists(number.astype(np.int32), begin), pa.ListArray.from_arrays(pa.array(held, pa.int32()), chosen)]
                yield pa.record_batch(out, [*PLACE, "hashes", "words", "numbers", "selected"]).filter(pa.array(np.diff(held) > 0))

    return run


def extended(mine: np.ndarray, other: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the longest equal runs around lines ``at`` of ``mine`` and ``there`` of ``other``, which are equal."""
    up, down = powers(max(len(mine), len(other)) + 1)

    def total(h):
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=out[1:])
        return out

    t, u = total(mine), total(other)
    same = lambda a, b, size: (t[a + size] - t[a]) * down[a] == (u[b + size] - u[b]) * down[b]

    def longest(most, agree):
        """The largest number of lines up to ``most`` that agree, where fewer agree too."""
        low, high = np.zeros_like(most), most
        while (low < high).any():
            middle = (low + high + 1) // 2
            yes = agree(middle)
            low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
        return low

    before = longest(np.minimum(at, there), lambda size: same(at - size, there - size, size))
    after = longest(np.minimum(len(mine) - at, len(other) - there), lambda size: same(at, there, size))
    return at - before, at + after - 1


def _runs(min_words: int, min_lines: int, whole_runs: bool):
    """The maximal runs (numbers of their first and last lines) around the matching positions of two texts."""

    def run(batches):
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            spans = []
            for k in range(len(batch)):
                mine, other = (column[c][k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("hashes", "other"))
                seeds = column["seeds"][k].values
                first, last = extended(mine, other, *(seeds.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1)))
                if not whole_runs:  # as far as a window from one of its lines on reaches
                    ends = window_ends(column["words"][k].values.to_numpy(zero_copy_only=False), min_words, min_lines)
                    last = ends[np.searchsorted(ends, last, "right") - 1]
                number = column["numbers"][k].values.to_numpy(zero_copy_only=False)
                both = np.unique(np.stack((number[first], number[last]), 1), axis=0)
                spans.append([{"first": int(a), "last": int(b)} for a, b in both])
            yield pa.record_batch([*(column[c] for c in PLACE), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], [*PLACE, "spans"])

    return run


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int, min_lines: int, id_col: str, text_col: str, scratch: Scratch, whole_runs: bool = False) -> DataFrame:
    """(none, id, text_key, runs): the lines (first, last) of later repeated runs; ``none`` marks null ids, which are 0."""
    number = F.col(id_col).cast("long")
    keyed = docs.select(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = scratch.table(keyed.mapInArrow(_selected(min_words, min_lines, whole_runs), SELECTED), "selected")
    places = texts.select(*PLACE, F.explode("selected").alias("s")).select(*PLACE, "s.fingerprint", "s.at", F.explode("s.windows").alias("window"))
    earliest = places.groupBy("fingerprint", "window").agg(F.min(F.struct(*PLACE, "at")).alias("e"), F.count("*").alias("n")).filter("n > 1").select("fingerprint", "window", "e")
    met = places.join(earliest, ["fingerprint", "window"]).filter(F.struct(*PLACE, "at") != F.col("e"))
    there = [F.col(f"e.{c}").alias(f"e_{c}") for c in PLACE]
    pairs = met.groupBy(*PLACE, *there).agg(F.collect_set(F.struct("at", F.col("e.at").alias("there"))).alias("seeds"))
    # as a table of its own, so that adaptive execution can split the join where many texts match one
    lines = scratch.table(texts.groupBy(*PLACE).agg(*(F.first(c).alias(c) for c in ("hashes", "words", "numbers"))), "lines")
    others = lines.select(*(F.col(c).alias(f"e_{c}") for c in PLACE), F.col("hashes").alias("other"))
    matched = scratch.table(pairs, "pairs").join(lines, [*PLACE]).join(others, [f"e_{c}" for c in PLACE])
    found = scratch.table(matched.select(*PLACE, "hashes", "words", "numbers", "other", "seeds").mapInArrow(_runs(min_words, min_lines, whole_runs), "none boolean, id long, text_key long, spans array<struct<first:int,last:int>>"), "found")
    spans = F.array_sort(F.flatten(F.collect_set("spans")))
    begin = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    gone = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def merge(acc, s):
        """Runs that overlap are one: the open run, and those that are closed."""
        on = s["first"] <= acc["open"]["last"]
        longer = F.struct(acc["open"]["first"].alias("first"), F.greatest(acc["open"]["last"], s["last"]).alias("last"))
        return F.when(on, F.struct(longer.alias("open"), acc["closed"].alias("closed"))).otherwise(F.struct(s.alias("open"), F.concat(acc["closed"], F.array(acc["open"])).alias("closed")))

    merged = F.aggregate("spans", F.struct(gone.alias("open"), begin.alias("closed")), merge, lambda acc: F.filter(F.concat(acc["closed"], F.array(acc["open"])), lambda r: r["first"] >= 0))
    return found.groupBy(*PLACE).agg(spans.alias("spans")).select(*PLACE, merged.alias("runs"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = 50, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", whole_runs: bool = False) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed``, ``removed_runs`` (array of first, last line, from 0) and ``clean_text``."""
    scratch = Scratch(spark, "line-dedup")
    docs = without(docs, "n_lines", "n_removed", "removed_runs", "clean_text")
    runs = scratch.table(repeated_runs(spark, docs, min_words, min_lines, id_col, text_col, scratch, whole_runs), "runs")
    scratch.drop("selected", "lines", "pairs", "found")
    none, number, key, cut = unused(docs, "run_none", "run_id", "run_key", "run_list")
    runs = runs.select(F.col("none").alias(none), F.col("id").alias(number), F.col("text_key").alias(key), F.col("runs").alias(cut))
    own = F.col(id_col).cast("long")
    # runs grow with the input, so they are never broadcast
    joined = docs.join(runs.hint("merge"), (own.isNull() == F.col(none)) & (F.coalesce(own, F.lit(0)) == F.col(number)) & (F.xxhash64(text_col) == F.col(key)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists(F.col(cut), lambda r: i.between(r["first"], r["last"])))
    removed = F.coalesce(F.size(lines) - F.size(kept), F.lit(0))
    out = joined.withColumn("removed_runs", F.coalesce(cut, F.expr("cast(array() as array<struct<first:int,last:int>>)")))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))).withColumn("n_removed", F.when(F.col(cut).isNull(), 0).otherwise(removed))
    out = out.withColumn("clean_text", F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, "n_lines", "n_removed", "removed_runs", "clean_text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), whole_runs=True).select("doc_id", "n_lines", "n_removed", "clean_text")


ORACLE = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k FROM raw),
b AS (SELECT doc_id, k, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
v AS (SELECT *, lead(k, 1) OVER d AS k2, lead(k, 2) OVER d AS k3, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(w, 1) OVER d AS w2,
  lag(k, 1) OVER d AS j2, lag(k, 2) OVER d AS j3, lag(line, 1) OVER d AS m2, lag(line, 2) OVER d AS m3, lag(w, 1) OVER d AS v2 FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
win AS (SELECT doc_id, k AS first, CASE WHEN w >= 50 THEN k WHEN w + w2 >= 50 THEN k2 ELSE k3 END AS last,
  CASE WHEN w >= 50 THEN line WHEN w + w2 >= 50 THEN line || chr(10) || l2 ELSE line || chr(10) || l2 || chr(10) || l3 END AS key FROM v
  UNION SELECT doc_id, CASE WHEN w >= 50 THEN k WHEN w + v2 >= 50 THEN j2 ELSE j3 END AS first, k AS last,
  CASE WHEN w >= 50 THEN line WHEN w + v2 >= 50 THEN m2 || chr(10) || line ELSE m3 || chr(10) || m2 || chr(10) || line END AS key FROM v),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, first) AS n FROM win WHERE last IS NOT NULL AND first IS NOT NULL),
gone AS (SELECT DISTINCT x.doc_id, x.k FROM x JOIN m ON m.doc_id = x.doc_id AND m.n > 1 AND x.k BETWEEN m.first AND m.last)
SELECT x.doc_id, count(*)::INT AS n_lines, count(gone.k)::INT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY x.k) FILTER (gone.k IS NULL), '') AS clean_text
FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.k = x.k GROUP BY x.doc_id
"""
