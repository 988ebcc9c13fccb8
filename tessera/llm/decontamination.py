"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit verification.

Texts and items are sequences of words (runs of letters, digits and non-ASCII bytes, A-Z read as a-z; kana and Han by the
character). The CGK embedding
walks a sequence: at step j it emits the word under its pointer, and a random bit of (j, word) tells whether the pointer
moves on. Two walks with the same bits fall into step again after an edit, so a small edit distance becomes a small
Hamming distance between what they emit. Each repetition draws its own bits, the place of the item where its walk starts
(places are spread over the whole item), and a sample of the steps of the walk from there to the item's end, any two scales of
which are as likely (``sampled``). As many repetitions are made as find ``target_recall`` of simulated copies of an item's size with
``max_share`` of its words edited (``repetitions_for``). Windows are tried at every word of a text, and walked only
as long as what they have emitted at the sampled steps agrees with some item.

With ``pieces=True``, for those who need every copy, what the samples may miss is looked up as well: an item is cut into one piece
more than the edits it may have, one of which stands unchanged in any text that holds the item, and each place of a piece gives a
window. By default the walks alone decide which windows are looked at. Every window that agrees is verified: the least number of word edits that turn the item into a stretch of the text, by exact dynamic
programming over the window and ``max_edits`` words on either side. The text holds the item if that is at most
``max_share`` of the item's words.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, one at a time, a pass over the texts for each block; texts
never move.

Defined results: null and blank texts and items hold nothing; items below ``min_words`` words are no evidence and are left
out; repeated items are found one by one, repeated rows row by row; a row with a null id has hits with a null id. Extra
columns of both inputs are ignored by ``contaminated`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import IN_TERM, Scratch, mix64, row_slices, small_batches, text_bytes, unused, words_of

BLOCK_BYTES = 16 << 20
#: Steps that a repetition samples besides the one where its walk starts, and words that it has at least.
SAMPLES, ROOM = 3, 3
#: Words that a walk is sampled over at most.
LONGEST = 512
MOST_REPETITIONS, SIMULATED = 64, 256
NO_WORD = np.uint64(0)
#: Words of a piece that are looked up.
PIECE = 8
#: Numbers in an array that is made for many places of a text at once.
WIDTH = 1 << 22


def window_of(words: int) -> int:
    """Words over which the walk is sampled that has so many before it: the power of two below, so that no sampled step is beyond its end."""
    return min(LONGEST, 1 << (words.bit_length() - 1))


@functools.lru_cache(maxsize=None)
def sampled(r: int, window: int) -> tuple[int, ...]:
    """The steps that a repetition samples: the start, and draws from a walk over the window (two steps to a word), log-uniform."""
    draws = np.exp(np.random.RandomState(977 * r + window).uniform(0, np.log(2 * window), SAMPLES)).astype(int)
    return (0, *np.unique(draws).tolist())


def starting_place(r: int, size: int) -> int:
    """Where a repetition starts in an item: halves, quarters and so on of it, in turn."""
    share, part = 0.0, 0.5
    while r:
        share, part, r = share + part * (r & 1), part / 2, r >> 1
    return int(share * (size - min(size, ROOM) + 1))


@functools.lru_cache(maxsize=None)
def repetitions_for(size: int, max_share: float, target_recall: float) -> int:
    """How many repetitions find the target share of random copies of an item with all the edits that it may have."""
    size = min(size, LONGEST)  # longer items have more places to start from, and are found by as many repetitions
    rng, edits_made = np.random.RandomState(size), int(size * max_share)
    items = rng.randint(1, 1 << 62, (SIMULATED, size)).astype(np.uint64)
    texts = np.zeros((SIMULATED, size + edits_made + 1), np.uint64)
    for k in range(SIMULATED):
        words = [[w] for w in items[k]]
        for i in rng.choice(size, edits_made, replace=False):
            other = np.uint64(rng.randint(1, 1 << 62))
            words[i] = ([], [other], [other, *words[i]])[rng.randint(3)]
        flat = [w for part in words for w in part]
        texts[k, : len(flat)] = flat
    every, found = np.arange(SIMULATED), np.zeros(SIMULATED, bool)
    for r in range(MOST_REPETITIONS):
        start = starting_place(r, size)
        at = sampled(r, window_of(size - start))
        same = texts == items[:, start, None]
        agree, i, j = same.any(1), np.full(SIMULATED, start), same.argmax(1)
        for step in range(at[-1] + 1):
            mine, other = items[every, np.minimum(i, size - 1)], texts[every, np.minimum(j, texts.shape[1] - 1)]
            if step in at:
                agree &= (i >= size) | (mine == other)
            i, j = i + moves(mine, r, step) * (i < size), j + moves(other, r, step)
        found |= agree
        if found.mean() >= target_recall:
            return r + 1
    return MOST_REPETITIONS


class Items:
    """Items of a block, with what their walks emit at the sampled positions."""

    def __init__(self, ids: list, texts: pa.Array, target_recall: float, max_share: float, min_words: int, pieces: bool = False):
        buf, off = text_bytes(texts)
        word, start, end, row = words_of(buf, off, within=IN_TERM, unspaced=True)
        ends = np.searchsorted(row, np.arange(len(ids) + 1))
        every = [(ids[k], word[ends[k] : ends[k + 1]], (end - start)[ends[k] : ends[k + 1]]) for k in range(len(ids)) if ends[k + 1] - ends[k] >= min_words]
        self.ids, self.words = [k for k, _, _ in every], [w for _, w, _ in every]
        self.most = [int(len(w) * max_share) for w in self.words]
        many = [repetitions_for(len(w), max_share, target_recall) for w in self.words]
        walks: dict[tuple[int, int], list[tuple[int, int]]] = {}  # items and where their walks start, by repetition and window
        for k, (_, w, length) in enumerate(every):
            for r in range(many[k]):
                start = starting_place(r, len(w))
                start += int(np.argmax(length[start : max(start + 1, min(start + min(3, len(w) // 8), len(w) - ROOM + 1))]))  # of the next words the longest, likely the rarest
                walks.setdefault((r, window_of(len(w) - start)), []).append((k, start))
        self.tables = []  # for each sampled step, sorted (signature, item, start) of complete walks and signatures of the others
        for (r, window), own in sorted(walks.items()):
            at = sampled(r, window)
            full: list[list[tuple[int, int, int]]] = [[] for _ in at]
            part: list[set[int]] = [set() for _ in at]
            for k, start in own:
                signatures = walk_one(self.words[k][start:], r, at)
                for level, s in enumerate(signatures[:-1]):
                    part[level].add(s)
                full[len(signatures) - 1].append((signatures[-1], k, start))
            levels = []
            for f, p in zip(full, part, strict=True):
                f = sorted(f)
                keys = np.array([x[0] for x in f], np.uint64)
                known = np.unique(np.concatenate((keys, np.array(sorted(p), np.uint64))))
                levels.append((keys, np.array([x[1:] for x in f], np.int64).reshape(-1, 2), np.array(sorted(p), np.uint64), bit_table(known)))
            self.tables.append((r, at, levels))
        self.pieces = {}  # by words: sorted signatures, (item, start) and bits
        if pieces:
            self.cut()

    def cut(self) -> None:
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k, (w, most) in enumerate(zip(self.words, self.most, strict=True)):
            many = min(most + 1, len(w))
            cuts = [j * len(w) // many for j in range(many + 1)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                size = min(hi - lo, PIECE)
                pieces.setdefault(size, []).append((int(signature(w[lo : lo + size])), k, lo))
        for size, f in pieces.items():
            f = sorted(f)
            keys = np.array([x[0] for x in f], np.uint64)
            self.pieces[size] = (keys, np.array([x[1:] for x in f], np.int64), bit_table(keys))


def bit_table(known: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[known & np.uint64(0xFFFF)] = True
    return table


def moves(word: np.ndarray, r: int, j: int) -> np.ndarray:
    """The random bit of (repetition, step, word)."""
    return (mix64(word ^ np.uint64(r << 32 | j)) & np.uint64(1)).astype(np.int64)


def walk_one(words: np.ndarray, r: int, at: tuple[int, ...]) -> list[int]:
    """Signatures of what the walk of a sequence emits at the sampled positions, as long as it has words."""
    out, i, sig = [], 0, np.zeros(1, np.uint64)
    for j in range(at[-1] + 1):
        if i >= len(words):
            break
        w = words[i : i + 1]
        if j in at:
            sig = mix64(sig ^ w)
            out.append(int(sig[0]))
        i += int(moves(w, r, j)[0])
    return out


def signature(words: np.ndarray) -> np.uint64:
    sig = np.zeros(1, np.uint64)
    for i in range(len(words)):
        sig = mix64(sig ^ words[i : i + 1])
    return sig[0]


def owned(keys: np.ndarray, owners: np.ndarray, sig: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(place, item, where the item would start) of the places whose signature is a key."""
    lo, hi = np.searchsorted(keys, sig, "left"), np.searchsorted(keys, sig, "right")
    many = hi - lo
    if not many.any():
        return None
    which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    walked = np.repeat(here, many)
    return walked, owners[which, 0], walked - owners[which, 1]


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def candidates(word: np.ndarray, end: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(where the walk started, item, where the item would start) of windows that agree with an item; ``end`` is where each word's row ends."""
    padded = np.append(word, NO_WORD)
    opening = mix64(word)
    low = (opening & np.uint64(0xFFFF)).astype(np.int32)
    for r, at, levels in items.tables:
        here = sig = None
        step = None
        for j in range(at[-1] + 1):
            if here is None:
                here = np.flatnonzero(levels[0][3][low])
                sig, step = opening[here], np.zeros(len(here), np.int64)
                emitted, level = word[here], 0
            else:
                place = here + step
                emitted = np.where(place < end[here], padded[np.minimum(place, len(word))], NO_WORD)
                level = at.index(j) if j in at else -1
                if level >= 0:
                    sig = mix64(sig ^ emitted)
            if level >= 0:
                keys, owners, part, table = levels[level]
                maybe = table[sig & np.uint64(0xFFFF)]
                here, sig, step, emitted = here[maybe], sig[maybe], step[maybe], emitted[maybe]
                if len(keys) and (known := owned(keys, owners, sig, here)):
                    yield known
                on = member(part, sig)
                here, sig, step, emitted = here[on], sig[on], step[on], emitted[on]
            if not len(here):
                break
            step = step + moves(emitted, r, j)
    sig = opening
    for size in range(1, max(items.pieces, default=0) + 1):
        if size > 1:
            sig = mix64(sig[:-1] ^ word[size - 1 :])
        if not len(sig):
            break
        if size in items.pieces:
            keys, owners, table = items.pieces[size]
            here = np.flatnonzero(table[sig & np.uint64(0xFFFF)])
            here = here[here + size <= end[here]]
            if len(here) and (known := owned(keys, owners, sig[here], here)):
                yield known


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least number of word edits that turn ``item`` into a stretch of ``text``, and where the first such stretch ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def plausible(word: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, most: int) -> np.ndarray:
    """Whether the words around each place hold enough of the item's different words: an edit removes one at most."""
    own = np.unique(item)
    ok = np.zeros(len(place), bool)
    span = np.arange(-most, len(item) + most)
    many = max(1, WIDTH // len(span))
    for s in range(0, len(place), many):
        at = place[s : s + many, None] + span
        inside = (at >= begin[s : s + many, None]) & (at < end[s : s + many, None])
        near = word[np.clip(at, 0, len(word) - 1)]
        where = np.minimum(np.searchsorted(own, near), len(own) - 1)
        inside &= own[where] == near
        seen = np.zeros((len(at), len(own)), bool)
        seen[np.nonzero(inside)[0], where[inside]] = True
        ok[s : s + many] = seen.sum(1) >= len(own) - most
    return ok


def hits_of(buf: np.ndarray, off: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, word where the stretch ends) of the items that rows hold, by row and item."""
    if not items.ids:
        return []
    word, _, _, row = words_of(buf, off, within=IN_TERM, unspaced=True)
    if not len(word):
        return []
    ends = np.searchsorted(row, np.arange(len(off)))
    found = [np.stack((row[walked], k, place), 1) for walked, k, place in candidates(word, ends[row + 1], items)]
    if not found:
        return []
    out: dict[tuple[int, int], tuple[int, int]] = {}
    every = np.concatenate(found)
    _, first = np.unique(((every[:, 1] << 40) + every[:, 2] + (1 << 32)), return_index=True)  # places tell rows apart, by item
    every = every[first]
    edges = np.flatnonzero(np.concatenate(([True], np.diff(every[:, 1]) != 0, [True])))
    kept = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        k = int(every[lo, 1])
        rows, place = every[lo:hi, 0], every[lo:hi, 2]
        kept.append(every[lo:hi][plausible(word, place, ends[rows], ends[rows + 1], items.words[k], items.most[k])])
    for r, k, p in np.concatenate(kept).tolist():
        best = out.get((r, k))
        if best is not None and best[0] == 0:
            continue
        item, most, begin = items.words[k], items.most[k], ends[r]
        if p >= begin and p + len(item) <= ends[r + 1] and np.array_equal(word[p : p + len(item)], item):
            out[r, k] = (0, int(p + len(item) - begin))
            continue
        lo, hi = max(begin, p - most), max(begin, min(ends[r + 1], p + len(item) + most))
        cost, stop = edits(item, word[lo:hi])
        if cost <= most and (best is None or cost < best[0]):
            out[r, k] = (cost, int(lo + stop - begin))
    return [(r, k, *v) for (r, k), v in sorted(out.items())]


class Blocks:
    """Blocks of items, each of a bounded number of bytes; one is broadcast at a time."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, target_recall: float, max_share: float, min_words: int, pieces: bool):
        self.spark, self.how = spark, (target_recall, max_share, min_words, pieces)
        self.items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
        self.many = -(-(self.items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // BLOCK_BYTES)

    def block(self, k: int):
        part = self.items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(self.many)) == k).orderBy("id", "text").toArrow()
        return self.spark.sparkContext.broadcast(Items(part["id"].to_pylist(), part["text"].combine_chunks(), *self.how))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, target_recall: float = 0.98, max_share: float = 0.2, min_words: int = 5, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", pieces: bool = False) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``, ``item_words`` and ``end_word`` (of the first best stretch, exclusive), a row for each row and item it holds."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits int, item_words int, end_word int"
    scratch, blocks = Scratch(spark, "decontamination"), Blocks(spark, benchmark, item_col, item_text_col, target_recall, max_share, min_words, pieces)
    if not blocks.many:
        return spark.createDataFrame([], schema)
    for k in range(blocks.many):
        held = blocks.block(k)

        def run(batches, held=held):
            items = held.value
            for batch in batches:
                buf, off = text_bytes(batch.column(1))
                ids = batch.column(0)
                rows = []
                for i, j in row_slices(off):
                    rows += [(ids[i + r].as_py(), items.ids[k], cost, len(items.words[k]), stop) for r, k, cost, stop in hits_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], items)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "edits", "item_words", "end_word"])

        with small_batches(spark):
            source.mapInArrow(run, schema).write.mode("append").parquet(scratch.path("hits"))
        held.destroy()
    return spark.read.schema(schema).parquet(scratch.path("hits"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, target_recall: float = 0.98, max_share: float = 0.2, min_words: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pieces: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    blocks = Blocks(spark, benchmark, item_col, item_text_col, target_recall, max_share, min_words, pieces)
    if not blocks.many:
        return docs
    if blocks.many == 1:  # one pass that keeps or drops rows where they are
        held, place = blocks.block(0), docs.columns.index(text_col)

        def run(batches):
            items = held.value
            for batch in batches:
                buf, off = text_bytes(batch.column(place))
                clean = np.ones(len(off) - 1, bool)
                for i, j in row_slices(off):
                    clean[[i + r for r, *_ in hits_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], items)]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)
    (key,) = unused(docs, "held_key")
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    gone = contaminated(spark, texts, benchmark, target_recall, max_share, min_words, "key", item_col, "text", item_text_col, pieces)
    return docs.join(gone.select(F.col("doc_id").alias(key)).distinct(), F.xxhash64(text_col) == F.col(key), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
