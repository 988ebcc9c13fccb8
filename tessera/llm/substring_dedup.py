"""Substring dedup by compaction of a De Bruijn graph of words.

Nodes are the windows of ``k`` words; edges are the ``k + 1`` words of two windows that follow each other. An edge is nonbranching if both
its nodes occur as often as the edge itself. Maximal paths of nonbranching edges are compacted, and every text that enters a
path runs through it whole, as one word more or less, or the end of a text, would make another count. So a path's places
are rows of one length, its earliest place in the order of documents is the source, and each other place is a repeated span.

1. Each window selects its smallest shingle of ``anchor`` words (the last of equal ones): equal windows select equal anchors. Anchors are counted, and
   windows whose anchor stands once are left out: they stand once as well. That is a filter, and never loses a repeat.
2. Neighbouring windows left that select one anchor are a walk. Which windows are in one walk depends on their words alone, so paths
   are cut where the anchor changes without cutting two texts differently. Equal walks (by 128 bits of their words) are
   compacted first: they are counted, the earliest is their source, and the others are repeated spans. What is left is one place for each different walk,
   and nothing to do where no other walk has its anchor, as its nodes then stand in no other.
3. The nodes of the others, weighted by the walks' counts, are counted, and are *single-entry* if they have one node before, wherever they stand.
   Walks join their nodes' counts: a walk goes on along a path while the next node is single-entry and occurs as often as the one before.
4. Paths are verified against their source coordinates: same first node (by 96 bits) and same length. Of the walks that run through a path the
   one with the earliest place is the source, and the others' places are repeated spans as well.

Nothing gathers a group: nodes and paths are reduced to counts and earliest places before anything is joined back, so a passage that a
third of all documents hold costs a row for each of them. Counting combines before the shuffle, and joins against hot nodes
have one row for each node on the other side, so that adaptive execution can split them.

Defined results: a null text has no words; rows that repeat an id and a text are one document, and are treated alike; a null id
counts as later than any other; rows that share an id but not the text are ordered by a hash of the text. Columns of the
input named as the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BYTE_HASH, Scratch, mix64, powers, release, row_slices, text_bytes, unused, without, words_of

PLACE = ("none", "id", "text_key")
RESULTS = ("n_words", "n_removed", "removed", "kept_text")
_OTHER = np.uint64(0xA0761D6478BD642F)


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each word on, where so many are left."""
    many = len(word) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[:many])


def stretch(word: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Hashes of ``many`` words from ``first`` on."""
    up, down = powers(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=total[1:])
    return mix64((total[first + many] - total[first]) * down[first])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's list begins in the values of all, and these."""
    edges = np.asarray(column.offsets)
    return edges - edges[0], np.asarray(column.flatten())


def anchors_of(word: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of ``anchor`` words within each window, and its last place there."""
    least = grams(word, anchor)
    many = max(len(word) - k + 1, 0)
    best, place = least[:many].copy(), np.arange(many)
    for step in range(1, k - anchor + 1):
        near = least[step : step + many]
        on = near <= best
        np.copyto(best, near, where=on)
        np.copyto(place, np.arange(step, step + many), where=on)
    return best, place


def _slices(batch: pa.RecordBatch, text: int):
    """Word hashes of a batch's texts, some rows at a time: first row, rows, words, row of each word."""
    buf, off = text_bytes(batch.column(text))
    for i, j in row_slices(off, 1 << 20):
        word, start, end, row = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], BYTE_HASH)
        yield i, j, word, row


def _anchors(k: int, anchor: int):
    """Runs of windows that select one anchor: place, anchor, first window and number of windows."""

    def run(batches):
        for batch in batches:
            for i, _, word, row in _slices(batch, 3):
                if len(word) < k:
                    continue
                inside = row[k - 1 :] == row[: len(word) - k + 1]
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                best, place = (x[at] for x in anchors_of(word, k, anchor))
                own = row[at]
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                many = np.diff(np.append(first, len(at)))
                own = own[first]
                took = batch.select([0, 1, 2]).take(pa.array(i + own))
                begin = np.searchsorted(row, own)
                span = (at[first] - begin) << 32 | many
                yield pa.record_batch([*(took.column(c) for c in range(3)), pa.array(best[first].view(np.int64)), pa.array(span)], [*PLACE, "anchor", "span"])

    return run


def _walks(k: int, anchor: int):
    """The walks of given spans of each text: place, first window, number of windows, anchor, and two hashes of their words."""

    def run(batches):
        for batch in batches:
            edges, span = _lists(batch.column(4))
            for i, j, word, row in _slices(batch, 3):
                if len(word) < k:
                    continue
                mine, own = span[edges[i] : edges[j]], np.repeat(np.arange(i, j), np.diff(edges[i : j + 1]))
                start, many = mine >> 32, mine & 0xFFFFFFFF
                first = np.searchsorted(row, own - i) + start
                took = batch.select([0, 1, 2]).take(pa.array(own))
                best = grams(word, anchor)[first[:, None] + np.arange(k - anchor + 1)].min(1)
                codes = [pa.array(mix64(stretch(w, first, many + (k - 1)) ^ many.astype(np.uint64)).view(np.int64)) for w in (word, mix64(word ^ _OTHER))]
                yield pa.record_batch([*(took.column(c) for c in range(3)), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(best.view(np.int64)), *codes], [*PLACE, "start", "windows", "anchor", "walk", "walk_check"])

    return run


def _nodes(k: int):
    """Given walks of each text, with their counts: place, first window, count and the hashes of their nodes."""

    def run(batches):
        for batch in batches:
            edges, span = _lists(batch.column(4))
            _, count = _lists(batch.column(5))
            for i, j, word, row in _slices(batch, 3):
                if len(word) < k:
                    continue
                node, check = grams(word, k), grams(mix64(word ^ _OTHER), k)
                mine, own = span[edges[i] : edges[j]], np.repeat(np.arange(i, j), np.diff(edges[i : j + 1]))
                start, many = mine >> 32, mine & 0xFFFFFFFF
                ends = np.cumsum(many)
                at = np.repeat(np.searchsorted(row, own - i) + start - (ends - many), many) + np.arange(many.sum())
                lists = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))  # noqa: B023, E731
                took = batch.select([0, 1, 2]).take(pa.array(own))
                yield pa.record_batch([*(took.column(c) for c in range(3)), pa.array(start.astype(np.int32)), pa.array(count[edges[i] : edges[j]]), lists(node[at].view(np.int64)), lists(check[at].view(np.int64).astype(np.int32))], [*PLACE, "start", "n", "nodes", "checks"])

    return run


def _kept():
    """Numbers of words and removed words, removed spans merged, and the words that stay."""

    def run(batches):
        for batch in batches:
            text = batch.column(batch.num_columns - 2)
            spans = batch.column(batch.num_columns - 1)
            words, gone, removed, kept = [], [], [], []
            buf, off = text_bytes(text)
            for i, j in row_slices(off, 1 << 20):
                part = buf[off[i] : off[j]]
                _, start, end, row = words_of(part, off[i : j + 1] - off[i], BYTE_HASH)
                begin = np.searchsorted(row, np.arange(j - i + 1))
                raw = part.tobytes()
                for r in range(j - i):
                    lo, hi = begin[r], begin[r + 1]
                    cover = np.zeros(hi - lo + 1, np.int64)
                    mine = spans[i + r].as_py()
                    if mine:
                        both = np.asarray(mine, np.int64)
                        np.add.at(cover, both >> 32, 1)
                        np.add.at(cover, (both >> 32) + (both & 0xFFFFFFFF), -1)
                    out = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                    words.append(hi - lo)
                    gone.append(int(out.sum()))
                    removed.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    stay = np.flatnonzero(~out) + lo
                    kept.append(b" ".join([raw[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]).decode())
            own = [batch.column(c) for c in range(batch.num_columns - 2)]
            made = [pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), pa.array(kept, pa.string())]
            yield pa.record_batch([*own, *made], [*batch.schema.names[:-2], *RESULTS])

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, k: int = 20, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Stretches of paths that aren't their source: place (``none``, ``id``, ``text_key``), ``start``, ``windows``, and ``source``, the place and start of the earliest."""
    if not 1 <= anchor <= k:
        raise ValueError("an anchor has 1 to k words")
    scratch = scratch or Scratch(spark, "substring-dedup")
    text = F.col(text_col).cast("string")
    placed = docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    place, span = F.struct(*PLACE, "start"), F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("windows"))
    anchors = placed.mapInArrow(_anchors(k, anchor), "none boolean, id long, text_key long, anchor long, span long")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    spans = anchors.join(shared, "anchor").groupBy(*PLACE).agg(F.collect_set("span").alias("spans"))  # a text's own, no more than it has words
    spans = scratch.table(spans, "spans")
    release(spark)
    walks = placed.join(spans, list(PLACE)).select(*PLACE, "text", "spans").mapInArrow(_walks(k, anchor), "none boolean, id long, text_key long, start int, windows int, anchor long, walk long, walk_check long")
    walks = scratch.table(walks, "walks")
    release(spark)
    different = walks.groupBy("walk", "walk_check").agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("anchor").alias("anchor"), F.min(place).alias("source"))
    different = scratch.table(different, "different")
    scratch.drop("spans")
    equal = walks.join(different.filter("n > 1").select("walk", "walk_check", "source"), ["walk", "walk_check"]).filter(place > F.col("source")).select(*PLACE, "start", "windows", "source")
    # one place for each different walk that shares its anchor with others, with its nodes
    mixed = different.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    firsts = different.join(mixed, "anchor", "left_semi").select(*[F.col(f"source.{c}").alias(c) for c in (*PLACE, "start")], "windows", "n").groupBy(*PLACE).agg(F.collect_list(F.struct(span.alias("span"), "n")).alias("own"))
    given = placed.join(firsts, list(PLACE)).select(*PLACE, "text", F.col("own.span").alias("spans"), F.col("own.n").alias("counts"))
    nodes = scratch.table(given.mapInArrow(_nodes(k), "none boolean, id long, text_key long, start int, n long, nodes array<long>, checks array<int>"), "nodes")
    release(spark)
    each = nodes.select(*PLACE, "start", "n", F.posexplode(F.arrays_zip("nodes", "checks", F.concat(F.array(F.lit(0).cast("long")), "nodes").alias("before"))).alias("at", "x"))
    each = each.filter("x.checks is not null").select(*PLACE, "start", "n", "at", F.col("x.nodes").alias("node"), F.col("x.checks").alias("check"), F.col("x.before").alias("before"))
    # edges: how often a node occurs, and whether it is always entered from the same one
    counted = each.groupBy("node", "check").agg(F.sum("n").alias("times"), F.min("before").alias("lo"), F.max("before").alias("hi")).filter("times > 1")
    counted = counted.select("node", "check", "times", (F.col("lo") == F.col("hi")).alias("single"))
    along = Window.partitionBy(*PLACE, "start").orderBy("at")
    met = each.select(*PLACE, "start", "at", "node", "check").join(counted, ["node", "check"])
    met = met.withColumn("again", F.lag("at").over(along)).filter("again is null or again < at")  # rows that repeat an id and a text
    on = F.col("single") & (F.lag("at").over(along) == F.col("at") - 1) & (F.lag("times").over(along) == F.col("times"))
    path = met.withColumn("on", F.coalesce(on, F.lit(False))).withColumn("last", ~F.coalesce(F.lead("on").over(along), F.lit(False)))
    ends = path.filter("last or not on").withColumn("to", F.when(F.col("last"), F.col("at")).otherwise(F.lead("at").over(along))).filter("not on")
    paths = scratch.table(ends.select(*PLACE, (F.col("start") + F.col("at")).alias("start"), (F.col("to") - F.col("at") + 1).alias("windows"), "node", "check"), "paths")
    scratch.drop("nodes")
    sources = paths.groupBy("node", "check", "windows").agg(F.min(place).alias("source"))
    merged = paths.join(sources, ["node", "check", "windows"]).filter(place > F.col("source")).select(*PLACE, "start", "windows", "source")
    return equal.unionByName(merged)


def dedup_substrings(spark: SparkSession, docs: DataFrame, k: int = 20, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (spans of words, first and number) and ``kept_text``, the words that stay joined by spaces."""
    scratch = Scratch(spark, "substring-dedup")
    docs = without(docs, *RESULTS)
    later = repeated_spans(spark, docs, k, anchor, id_col, text_col, scratch)
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("windows") + (k - 1))
    gone = scratch.table(later.groupBy(*PLACE).agg(F.collect_set(packed).alias("spans")), "gone")
    scratch.drop("walks", "different", "paths")
    release(spark)
    none, at, key, text, spans = unused(docs, "of_none", "of_id", "of_key", "whole_text", "gone_spans")
    gone = gone.select(F.col("none").alias(none), F.col("id").alias(at), F.col("text_key").alias(key), F.col("spans").alias(spans))
    same = (F.col(id_col).isNull() == F.col(none)) & (F.coalesce(F.col(id_col), F.lit(0)).cast("long") == F.col(at)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key))
    joined = docs.join(gone, same, "left").select(*docs.columns, F.col(text_col).cast("string").alias(text), spans)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(_kept(), ", ".join([*fields, "n_words long, n_removed long, removed array<struct<first:int,words:int>>, kept_text string"]))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(spark, docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
g AS (SELECT t.doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS gram FROM t, unnest(range(1, len(words) - 18)) AS r(i) WHERE len(words) >= 20),
l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1 AS later FROM g),
c AS (SELECT w.doc_id, w.word, w.i, coalesce(max(CASE WHEN later THEN 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN l USING (doc_id, i)),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)
"""
