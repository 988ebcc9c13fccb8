"""Ranked lexical search by Block-Max MaxScore over an index of shards.

Terms are runs of ASCII letters, digits and all that isn't ASCII, with A-Z lower-cased, told apart by 64-bit hashes. The index is a table with a row for
each shard of at most ``SHARD`` documents: their ids and lengths, and for each term a list cut into blocks, one for each ``CHUNK`` document
numbers. A block holds document offsets in two bytes and frequencies in one (exceptions aside), and outside of these bytes its largest
frequency and shortest length within each of four classes of frequencies, which bound what a posting in it can score.

A shard is searched for each query in turn. The largest bound of a list says what it can add at most. Lists are ordered by it, and those at the
low end that together can't reach the tenth best score so far are non-essential: only documents of the other, essential lists are candidates.
Chunks are visited from the largest sum of block maxima on, until that falls below the tenth score. In a chunk the essential blocks are
decoded and added up; non-essential ones follow from the largest on, and before each the candidates that cannot reach the tenth
score with the maxima of the blocks left are rejected; where none is left, blocks stay encoded. Bounds are compared strictly, so ties are
never lost. Each shard returns its best ``k``; Spark keeps the best ``k`` of each task before the shuffle, and merges those.

Queries come in blocks of at most ``BLOCK_BYTES`` of text and ``BLOCK_ITEMS`` items, and the index of a block has the lists of its terms. The number of documents, the
sum of their lengths and document frequencies are exact sums over the whole index.

Defined results: a null or empty text has no terms; such documents aren't found and such queries find nothing; rows that repeat an id are
documents each; a null id is ordered last; queries are the different rows of (id, text).
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import FOLDED_HASH, IN_TERM, Scratch, row_slices, text_bytes, words_of

CHUNK, SHARD, MAX_POSTINGS = 512, 16_384, 4_000_000
#: Largest frequencies of the classes within which blocks keep maxima; the last is open.
CLASSES = (1, 2, 4, 1 << 40)
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 10_000
INDEX = "n_docs long, n_terms long, none binary, ids binary, lengths binary, terms array<int>, dfs array<int>, list_ends binary, block_chunk binary, block_end binary, block_tf binary, block_length binary, offsets binary, tfs binary, large_at binary, large binary"


def _shard(none: np.ndarray, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """An index row of documents that hold terms, and their postings (document, term, frequency)."""
    order = np.lexsort((ids, none))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    none, ids, lengths, doc = none[order], ids[order], lengths[order], place[doc]
    by = np.lexsort((doc, term))
    doc, term, tf = doc[by], term[by], tf[by]
    new_list = np.concatenate(([True], term[1:] != term[:-1]))[: len(term)]
    chunk = doc // CHUNK
    begin = np.flatnonzero(new_list | np.concatenate(([True], chunk[1:] != chunk[:-1]))[: len(term)])
    lists = np.flatnonzero(new_list)
    ends = lambda first, n: np.append(first[1:], n)
    large = np.flatnonzero(tf > 255)
    kind = np.searchsorted(CLASSES, tf)
    block_tf, block_length = np.zeros((len(begin), len(CLASSES)), np.int64), np.zeros((len(begin), len(CLASSES)), np.int64)
    if len(begin):
        for c in range(len(CLASSES)):
            block_tf[:, c] = np.maximum.reduceat(np.where(kind == c, tf, 0), begin)
            block_length[:, c] = np.minimum.reduceat(np.where(kind == c, lengths[doc], 1 << 40), begin)
        block_length[block_tf == 0] = 0  # classes that the block lacks
    parts = {
        "none": none.astype(np.uint8), "ids": ids, "lengths": lengths, "list_ends": np.searchsorted(begin, ends(lists, len(term))).astype(np.int32), "block_chunk": chunk[begin].astype(np.int32), "block_end": ends(begin, len(term)).astype(np.int32),
        "block_tf": block_tf, "block_length": block_length, "offsets": (doc % CHUNK).astype(np.uint16), "tfs": np.where(tf > 255, 0, tf).astype(np.uint8), "large_at": large, "large": tf[large].astype(np.int64),
    }
    made = {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}
    made |= {"terms": pa.array([term[lists].tolist()], pa.list_(pa.int32())), "dfs": pa.array([np.diff(np.append(lists, len(term))).tolist()], pa.list_(pa.int32()))}
    made |= {"n_docs": pa.array([n_docs], pa.int64()), "n_terms": pa.array([n_terms], pa.int64())}
    names = [f.split()[0] for f in INDEX.split(", ")]
    return pa.record_batch([made[n] for n in names], names)


def _indexed(terms: np.ndarray):
    """Shards of (id, text) rows, with the lists of the sorted hashes ``terms``."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        docs = postings = n_docs = n_terms = 0

        def flush():
            nonlocal held, docs, postings, n_docs, n_terms
            if n_docs:
                yield _shard(*([np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 6), n_docs, n_terms)
            held, docs, postings, n_docs, n_terms = [], 0, 0, 0, 0

        for batch in batches:
            none = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            buf, off = text_bytes(batch.column(1))
            for i, j in row_slices(off, 1 << 20):
                word, _, _, row = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], FOLDED_HASH, IN_TERM)
                length = np.bincount(row, minlength=j - i) if len(row) else np.zeros(j - i, np.int64)
                n_docs, n_terms = n_docs + int((length > 0).sum()), n_terms + len(word)
                if not len(word) or not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
                on = terms[at] == word
                key, tf = np.unique(row[on] * len(terms) + at[on], return_counts=True)
                if not len(key):
                    continue
                own, doc = np.unique(key // len(terms), return_inverse=True)
                held.append((none[i:j][own], ids[i:j][own], length[own].astype(np.int64), doc + docs, key % len(terms), tf))
                docs, postings = docs + len(own), postings + len(key)
                if docs >= SHARD or postings >= MAX_POSTINGS:
                    yield from flush()
        yield from flush()

    return run


class Corpus(NamedTuple):
    """Documents with a term, all their terms with repeats, and the weight of each term of the index."""

    documents: int
    terms: int
    weights: np.ndarray


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, length: np.ndarray, corpus: Corpus) -> np.ndarray:
    m = 25 + 75 * length * corpus.documents // corpus.terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """A row of the index, with blocks that are decoded on demand; ``decoded`` counts their postings."""

    def __init__(self, row: dict, corpus: Corpus):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.corpus, self.decoded = corpus, 0
        self.none, self.ids, self.lengths = read("none", np.uint8), read("ids", np.int64), read("lengths", np.int64)
        self.offsets, self.tfs = read("offsets", np.uint16), read("tfs", np.uint8)
        self.large_at, self.large = read("large_at", np.int64), read("large", np.int64)
        self.list_of = {t: k for k, t in enumerate(row["terms"])}
        list_ends, chunk = read("list_ends", np.int32), read("block_chunk", np.int32)
        self.block_end = read("block_end", np.int32).astype(np.int64)
        self.block_begin = np.concatenate(([0], self.block_end[:-1]))
        self.chunks = (len(self.ids) + CHUNK - 1) // CHUNK
        bound = impact(read("block_tf", np.int64), read("block_length", np.int64), corpus).reshape(-1, len(CLASSES)).max(1)
        lists = np.repeat(np.arange(len(list_ends)), np.diff(np.concatenate(([0], list_ends))))
        self.block = np.full((len(list_ends), self.chunks), -1, np.int64)
        self.block[lists, chunk] = np.arange(len(chunk))
        self.bound = np.zeros((len(list_ends), self.chunks), np.int64)
        self.bound[lists, chunk] = bound

    def decode(self, blocks: np.ndarray, weights: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and weighted impacts of the postings in blocks of one chunk."""
        begin, many = self.block_begin[blocks], self.block_end[blocks] - self.block_begin[blocks]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        tf = self.tfs[at].astype(np.int64)
        if len(self.large_at) and not tf.all():
            zero = tf == 0
            tf[zero] = self.large[np.searchsorted(self.large_at, at[zero])]
        offset = self.offsets[at].astype(np.int64)
        self.decoded += len(at)
        return offset, impact(tf, self.lengths[chunk * CHUNK + offset], self.corpus) * np.repeat(weights, many)

    def search(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents (by score, then number) and their scores; ``query`` has (term, repeats)."""
        on = [(self.list_of[t], n * self.corpus.weights[t]) for t, n in query if t in self.list_of and self.corpus.weights[t] > 0]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not on:
            return best, score
        lists, weights = np.array([x for x, _ in on]), np.array([w for _, w in on], np.int64)
        most = self.bound[lists].max(1) * weights
        order = np.argsort(most, kind="stable")
        lists, weights = lists[order], weights[order]
        together = np.cumsum(most[order])
        bound, block = self.bound[lists] * weights[:, None], self.block[lists]
        below = np.cumsum(bound, 0)  # what a chunk's blocks up to a list can add
        tenth = 0  # the score to reach: above 0 while there are fewer than k
        for c in np.argsort(-below[-1], kind="stable").tolist():
            if below[-1, c] < max(tenth, 1):
                break
            first = int(np.searchsorted(together, tenth, "left")) if tenth else 0  # lists before it are non-essential
            held = np.flatnonzero(block[first:, c] >= 0) + first
            if not len(held):
                continue
            offset, gained = self.decode(block[held, c], weights[held], c)
            total = np.bincount(offset, gained, CHUNK).astype(np.int64)  # sums stay below 2^53
            candidate = np.unique(offset)
            for t in range(first - 1, -1, -1):
                candidate = candidate[total[candidate] + below[t, c] >= tenth]
                if not len(candidate):
                    break
                if block[t, c] >= 0:
                    offset, gained = self.decode(block[t : t + 1, c], weights[t : t + 1], c)
                    total[offset] += gained
            candidate = candidate[(total[candidate] >= tenth) & (total[candidate] > 0)]
            if len(candidate):
                best, score = np.append(best, c * CHUNK + candidate), np.append(score, total[candidate])
                keep = np.lexsort((best, -score))[:k]
                best, score = best[keep], score[keep]
                tenth = int(score[-1]) if len(score) == k else 0
        return best, score


def _searched(shared, k: int):
    def run(batches):
        corpus, queries = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, corpus)
                item, none, ids, scores = [], [], [], []
                for q, query in queries:
                    best, score = shard.search(query, k)
                    item.append(np.full(len(best), q, np.int64))
                    none.append(shard.none[best])
                    ids.append(shard.ids[best])
                    scores.append(score)
                yield pa.record_batch([pa.array(np.concatenate(item)), pa.array(np.concatenate(none) > 0), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["item", "none", "id", "score"])

    return run


def terms_of(text: str | None) -> Counter:
    """Hashes of a text's terms, and how often each stands."""
    buf, off = text_bytes(pa.array([text], pa.string()))
    return Counter(words_of(buf, off, FOLDED_HASH, IN_TERM)[0].tolist())


def _blocks(queries: DataFrame, id_col: str, text_col: str):
    """Queries in blocks of bounded size: number, id and terms of each."""
    block, size, k = [], 0, 0
    for row in queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct().orderBy("id", "text").toLocalIterator():
        many = len(row.text or "")
        if block and (size + many > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((k, row.id, terms_of(row.text)))
        size, k = size + many, k + 1
    if block:
        yield block


def lexical_search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(``query_id``, ``rank``, ``id_col``, ``score``): the ``k`` documents that score highest for each query, equal ones by ascending id."""
    scratch = Scratch(spark, "lexical-search")
    found = []
    for number, block in enumerate(_blocks(queries, query_id, query_text)):
        terms = np.array(sorted({t for _, _, own in block for t in own}), np.uint64)
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        index = scratch.table(texts.mapInArrow(_indexed(terms), INDEX), f"index-{number}")
        totals = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
        if not totals.d or not len(terms):
            continue
        dfs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect()  # a row for each of the block's terms at most
        weights = np.zeros(len(terms), np.int64)
        for r in dfs:
            weights[r.terms] = weight(totals.d, r.df)
        corpus = Corpus(totals.d, totals.t, weights)
        asked = [(q, [(int(np.searchsorted(terms, np.uint64(t))), n) for t, n in own.items()]) for q, _, own in block if own]
        shared = spark.sparkContext.broadcast((corpus, asked))  # of one block
        spread = index.repartition(4 * spark.sparkContext.defaultParallelism)
        hits = spread.mapInArrow(_searched(shared, k), "item long, none boolean, id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "none", "id")
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, i, _ in block], f"item long, name {queries.schema[query_id].dataType.simpleString()}")
        found.append(ranked.join(F.broadcast(names), "item").select(F.col("name").alias(query_id), "rank", F.when(~F.col("none"), F.col("id")).alias(id_col), "score"))
    if not found:
        return spark.createDataFrame([], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, {id_col} long, score long")
    return reduce(DataFrame.unionAll, found)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
