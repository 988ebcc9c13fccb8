"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself.

Rows of the incidence matrix are documents, columns are hashed word n-grams. The product is taken one block of columns
at a time: a block holds the postings of a range of n-gram hashes, and each posting adds one to the overlap of its
smallest row, the pivot, with every other row in it. Size-derived bounds keep the product sparse and exact:

* a pair with Jaccard of ``num/den`` or more shares ``o = num*(a+b)/(num+den)`` columns at least, so under any one order
  of the columns two such rows share ``min(o, q)`` of the first ``a - ceil(num*a/den) + q`` and ``b - ceil(num*b/den) + q``
  columns; only those leading columns enter the blocks, and pairs whose accumulated overlap stays below ``min(o, q)``, even
  if all columns of which neither is the pivot were shared too, are discarded (``q`` grows with the smaller row, see
  ``least_shared``);
* the order puts columns that many rows hold last (document frequencies are counted over the whole corpus), so a
  passage that many documents share enters a block only where little else is in the row;
* pairs whose sizes alone rule the threshold out are never made.

Surviving pairs get their overlap in full, from the whole sets of both documents, and links are those that reach the
threshold. Documents with equal sets are one row of the matrix, known by a signature of the set: copies are never expanded. So a
posting costs its length, whatever its length is. A column that many rows hold is dealt over parts of the corpus, each with a pivot of its own, and the
pivots of the parts are linked to the smallest one: no block grows with a column.

Where links leave rows of a posting in different components, the rows are open: they may link without either being a
pivot. An open row that holds fewer open columns than any pair of its size must share is closed. The others, where they have
enough columns left by the same bound, are dealt into cells of bounded size, and each pair of cells is multiplied as dense blocks: a task returns a spanning forest of the links
it finds, never the pairs, so no link between components is lost.

Defined results: null or blank texts have an empty set, ``n_shingles`` 0 and are their own component; rows with a null
id get a null component and link nothing; repeated rows of one id are judged row by row; a class of equal sets is
named by its smallest id; extra columns are ignored. Sets are sets of 64-bit hashes of word n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, mix64, pack, row_slices, text_bytes, unpack, unused, words_of

#: Columns held by more documents than this come last in the order.
HEAVY_DF = 32
#: Bytes of text whose postings are packed together; bounds a task's memory.
CHUNK = 4 << 20
#: Rows of a cell of long postings.
CELL = 384
#: Up to this many rows, the sets that candidates need are picked out by a filter of 16 bits or more for each: 16 MB at most.
FILTERED_ROWS = 1 << 22
#: Overlaps that a task holds before it gives them out.
HELD = 1 << 19
#: Columns known as heavy (8 bytes each on the driver) and the bits of the filter broadcast for them (8 MB).
MAX_HEAVY, FILTER_BITS = 1 << 20, 26


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the rows' offsets in them."""
    rows = len(off) - 1
    word, _, _, row = words_of(buf, off)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    salt = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    if len(word) >= n:
        h = word[: len(word) - n + 1] * salt[0]
        for k in range(1, n):
            h = h + word[k : len(word) - n + 1 + k] * salt[k]
        keep = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
        h, owner = mix64(h[keep]), row[: len(keep)][keep]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([np.uint64(np.sum(word[first[r] : first[r + 1]] * salt[: count[r]], dtype=np.uint64)) for r in short])
        whole = mix64(whole + np.uint64(0x51ED270B) * count[short].astype(np.uint64))
        h, owner = np.concatenate((h, whole)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
    for r in np.flatnonzero(np.diff(ends) > 1):
        h[ends[r] : ends[r + 1]].sort()
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[fresh], owner[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))


def signatures(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: two sums of independent hashes of the members."""
    total = np.zeros((2, len(h) + 1), np.uint64)
    for k in (0, 1):
        np.cumsum(mix64(h ^ np.uint64(0x1234567 + k)), out=total[k, 1:])
    return tuple((total[k, ends[1:]] - total[k, ends[:-1]]).view(np.int64) for k in (0, 1))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """ids, their validity, hashes and offsets of slices of batches of (id, text), and the bytes of each slice."""
    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        ids = np.asarray(batch.column(0).fill_null(0))
        buf, off = text_bytes(batch.column(1))
        for i, j in row_slices(off):
            h, ends = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
            yield ids[i:j], known[i:j], h, ends, int(off[j] - off[i])


def _signed(n: int):
    def run(batches):
        for batch in batches:
            done = 0
            for ids, known, h, ends, _ in _sets([batch], n):
                a, b = signatures(h, ends)
                key, done = batch.column(2).slice(done, len(ids)), done + len(ids)
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=~known), key, pa.array(np.diff(ends)), pa.array(a), pa.array(b)], ["id", "text_key", "n", "s1", "s2"])

    return run


def _once(batches, n: int):
    """Signatures, hashes, offsets and rows of slices, without empty sets, rows without id, and sets that the last slices had already; per chunk of text."""
    held, size, seen = [], 0, {}
    for ids, known, h, ends, nbytes in _sets(batches, n):
        a, b = signatures(h, ends)
        rows = []
        for r in np.flatnonzero(known & (np.diff(ends) > 0)):
            key = (a[r], b[r])
            if key not in seen:
                rows.append(r)
                seen[key] = None
                if len(seen) > 1 << 16:
                    seen.pop(next(iter(seen)))
        held.append((a, h, ends, np.array(rows, np.int64)))
        size += nbytes
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _truncated(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def _by_bucket(key: np.ndarray, bits: int, bucket_bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted keys with the same leading bits."""
    bucket = (key >> np.uint64(bits - bucket_bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


def _column_counts(n: int, bits: int, bucket_bits: int):
    """All columns of all rows, as packed differences of their sorted hashes."""

    def run(batches):
        for held in _once(batches, n):
            parts = [h[ends[r] : ends[r + 1]] for _, h, ends, rows in held for r in rows]
            if not parts:
                continue
            key = np.sort(_truncated(np.concatenate(parts), bits))
            out = [(b, pack(np.diff(key[at], prepend=np.uint64(0)))) for b, at in _by_bucket(key, bits, bucket_bits)]
            yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])

    return run


def _grouped(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one bucket after another, of batches sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield now, rows


def _heavy(least: int):
    """Columns that more than ``least`` rows hold."""

    def run(batches):
        for _, rows in _grouped(batches):
            key = np.sort(np.concatenate([np.cumsum(unpack(x, np.uint64)) for (x,) in rows]))
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            df = np.diff(np.append(edges, len(key)))
            often = df > least
            if often.any():
                yield pa.record_batch([pa.array(key[edges[often]].view(np.int64)), pa.array(df[often].astype(np.int64))], ["column", "df"])

    return run


def _filter_index(key: np.ndarray) -> np.ndarray:
    return mix64(key) >> np.uint64(64 - FILTER_BITS)


def _in_filter(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = _filter_index(key)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def least_shared(size):
    """``q`` of the module's first bound."""
    return 2 + size // 24


def least_shared_of(size: Column) -> Column:
    return (F.floor(size / 24) + 2).cast("long")


def _postings(n: int, bits: int, bucket_bits: int, part_bits: int, num: int, den: int, heavy):
    """The leading columns of each row: (column, signature, size of the row), packed by block of columns; those known as heavy by part of the corpus."""

    def run(batches):
        table = np.frombuffer(heavy.value, np.uint8) if heavy is not None else None
        for held in _once(batches, n):
            keys, often, ids, sizes, places = [], [], [], [], []
            for doc, h, ends, rows in held:
                late = _in_filter(table, _truncated(h, bits)) if table is not None else np.zeros(len(h), bool)
                for r in rows:
                    own, flag = h[ends[r] : ends[r + 1]], late[ends[r] : ends[r + 1]]
                    size = len(own)
                    lead = min(size, size - -(-num * size // den) + least_shared(size))
                    if flag[:lead].any():
                        own, flag = np.concatenate((own[~flag], own[flag])), np.sort(flag)
                    keys.append(own[:lead])
                    often.append(flag[:lead])
                    ids.append(doc[r])
                    sizes.append(size)
                    places.append(lead)
            if not keys:
                continue
            lead, often = np.array(places), np.concatenate(often)
            key = _truncated(np.concatenate(keys), bits)
            doc, size = np.repeat(np.array(ids, np.int64), lead), np.repeat(np.array(sizes, np.uint32), lead)
            part = (1 << bucket_bits) + int(mix64(doc[:1].view(np.uint64))[0] >> np.uint64(64 - part_bits)) if part_bits else 1 << bucket_bits
            out = []
            for heavy_ones in (False, True):
                at = np.flatnonzero(often == heavy_ones)
                at = at[np.argsort(key[at])]
                for b, run_of in _by_bucket(key[at], bits, bucket_bits) if not heavy_ones else [(part, slice(None))] * bool(len(at)):
                    own = at[run_of]
                    out.append((b, pack(np.diff(key[own], prepend=np.uint64(0))), pack(doc[own]), pack(size[own])))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 4))], ["bucket", "k", "d", "n"])

    return run


PRODUCT = "kind int, a long, b long, shared long, least long, ids array<long>"


def _rows(kind: int, a, b=None, shared=None, least=None, ids=None) -> pa.RecordBatch:
    n = len(a)
    of = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), of(a), of(b), of(shared), of(least), pa.nulls(n, pa.list_(pa.int64())) if ids is None else pa.array(ids, pa.list_(pa.int64()))], ["kind", "a", "b", "shared", "least", "ids"])


def _summed(rows: np.ndarray) -> np.ndarray:
    """(a, b, shared, least), a row for each pair."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)))[: len(rows)])
    if not len(first):
        return rows
    return np.stack((rows[first, 0], rows[first, 1], np.add.reduceat(rows[:, 2], first), np.maximum.reduceat(rows[:, 3], first)), 1)


def _product(num: int, den: int, bucket_bits: int):
    """Overlaps with pivots, summed over the blocks of a task (kind 0); postings with rows that are no pivots (1: column, pivot, rows, 2048 at a time; ``shared`` is 1 for a part of a heavy column); how many of those hold a row (2)."""

    def run(batches):
        found = np.zeros((0, 4), np.int64)
        for block, rows in _grouped(batches):
            heavy = bool(block >> bucket_bits)
            key = np.concatenate([np.cumsum(unpack(x[0], np.uint64)) for x in rows])
            doc = np.concatenate([unpack(x[1], np.int64) for x in rows])
            size = np.concatenate([unpack(x[2], np.uint32) for x in rows]).astype(np.int64)
            del rows
            order = np.lexsort((doc, key))
            key, doc, size = key[order], doc[order], size[order]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))  # copies from different chunks are one row
            key, doc, size = key[fresh], doc[fresh], size[fresh]
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            length = np.diff(np.append(edges, len(key)))
            first = np.repeat(edges, length)
            a, b = first, np.arange(len(key))
            near = (doc[a] != doc[b]) & (num * np.maximum(size[a], size[b]) <= den * np.minimum(size[a], size[b]))
            a, b = a[near], b[near]
            small, both = np.minimum(size[a], size[b]), size[a] + size[b]
            new = np.stack((doc[a], doc[b], np.ones(len(a), np.int64), np.minimum(least_shared(small), -(-num * both // (num + den)))), 1)
            found = _summed(np.concatenate((found, _summed(new))))
            if len(found) > HELD:
                yield from (_rows(0, *found[s : s + 50_000].T) for s in range(0, len(found), 50_000))
                found = found[:0]
            lasting = np.flatnonzero((length > 2) | heavy)
            open_rows = [(int(key[lo]), int(doc[lo]), doc[lo : lo + many]) for lo, many in zip(edges[lasting], length[lasting], strict=True)]
            open_rows = [(column, pivot, ids[s : s + 2048]) for column, pivot, ids in open_rows for s in range(0, len(ids), 2048)]
            if open_rows:
                yield _rows(1, [x[0] for x in open_rows], [x[1] for x in open_rows], shared=np.ones(len(open_rows), np.int64) if heavy else None, ids=[x[2] for x in open_rows])
                counted = np.repeat((length > 2) | heavy, length)
                if not heavy:
                    counted &= np.arange(len(doc)) != first
                ids, times = np.unique(doc[counted], return_counts=True)
                yield _rows(2, ids, shared=times)
        yield from (_rows(0, *found[s : s + 50_000].T) for s in range(0, len(found), 50_000))

    return run


def _bits(width: int):
    """Words of a bit filter of ids."""

    def run(batches):
        for batch in batches:
            at = np.unique(mix64(np.asarray(batch.column(0)).view(np.uint64)) >> np.uint64(64 - width))
            word, first = np.unique(at >> np.uint64(5), return_index=True)
            bits = np.uint64(1) << (at & np.uint64(31))
            if len(at):
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(bits, first).astype(np.int64))], ["word", "bits"])

    return run


def overlaps_of(sets: list[np.ndarray]) -> np.ndarray:
    """How many columns each two rows share, by dense products of blocks of columns."""
    size = np.array([len(x) for x in sets])
    column, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=len(column)) > 1
    at, row = (np.cumsum(shared) - 1)[at[shared[at]]], row[shared[at]]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(at, (lo, lo + 2048))
        block = np.zeros((len(sets), 2048), np.float32)
        block[row[a:b], at[a:b] - lo] = 1
        overlap += block @ block.T
    return overlap.astype(np.int64)


def _linked(table: pa.Table, num: int, den: int) -> np.ndarray:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["members"]]
    size, overlap = np.array([len(x) for x in sets]), overlaps_of(sets)
    return den * overlap >= num * (size[:, None] + size[None, :] - overlap)


def _link_counts(num: int, den: int):
    """How many rows of the other part (of the same one, but not the class itself, in a cell on the diagonal) each class links to."""

    def run(table: pa.Table) -> pa.Table:
        part, copies = np.asarray(table["part"]), np.asarray(table["copies"])
        linked = _linked(table, num, den)
        if table["i"][0].as_py() == table["j"][0].as_py():
            np.fill_diagonal(linked, False)
        else:
            linked &= part[:, None] != part[None, :]
        return pa.table({"class": table["class"], "links": pa.array(linked.astype(np.int64) @ copies)})

    return run


def _cell(num: int, den: int):
    """A spanning forest of the links between components in a cell."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = np.asarray(table["class"]), np.asarray(table["component"])
        linked = _linked(table, num, den) & (comp[:, None] != comp[None, :])
        parent = {int(c): int(c) for c in np.unique(comp)}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        edges = []
        for i, j in np.argwhere(np.triu(linked, 1)):
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _whole_sets(n: int, width: int, bits):
    """Whole sets, with their signatures, of the rows whose ids are in the filter (all, without one)."""

    def run(batches):
        words = np.frombuffer(bits.value, np.uint32) if bits is not None else None
        for batch in batches:
            if words is not None:
                at = mix64(np.asarray(batch.column(0).fill_null(0)).view(np.uint64)) >> np.uint64(64 - width)
                batch = batch.filter(pa.array((words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)))
            for ids, known, h, ends, _ in _sets([batch], n):
                rows = np.flatnonzero(known & (np.diff(ends) > 0))
                s1, s2 = signatures(h, ends)
                yield pa.record_batch([pa.array(ids[rows]), pa.array(s1[rows]), pa.array(s2[rows]), pa.array([h[ends[r] : ends[r + 1]].tobytes() for r in rows], pa.binary())], ["rep", "s1", "s2", "members"])

    return run


def _overlaps(num: int, den: int):
    """The pairs whose full overlap reaches the threshold."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            hit = []
            for k in range(len(a)):
                p, q = (np.frombuffer(v[k].as_buffer(), np.uint64) for v in (x, y))
                if num * max(len(p), len(q)) > den * min(len(p), len(q)):
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if den * both >= num * (len(p) + len(q) - both):
                    hit.append(k)
            hit = pa.array(hit, pa.int64())
            yield pa.record_batch([a.take(hit), b.take(hit)], ["a", "b"])

    return run


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, component) of the ends of ``edges`` (a, b): smallest id of each connected component, by min-label spreading with pointer jumping."""
    both = scratch.table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{tag}-both")
    label = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        near = both.join(label, both.v == label.id).groupBy("u").agg(F.min("component").alias("m"))
        spread = label.join(near, label.id == near.u, "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("c1"))
        root = label.select(F.col("id").alias("r"), F.col("component").alias("c2"))
        jumped = spread.join(root, spread.c1 == root.r, "left").select("id", F.least("c1", F.coalesce("c2", "c1")).alias("component"), (F.least("c1", F.coalesce("c2", "c1")) != F.col("component")).alias("moved"))
        now = scratch.table(jumped, f"{tag}-{step}")
        moved = now.filter("moved").limit(1).count()
        scratch.drop(f"{tag}-{step - 1}")
        label = now.select("id", "component")
        if not moved:
            scratch.drop(f"{tag}-both")
            return label


def ngram_jaccard(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id``, the smallest id reachable by links, and ``text_key`` (xxhash64 of the text).

    Two rows link when ``den * |intersection| >= num * |union|`` of their sets of ``n``-word shingles (``threshold`` is
    ``(num, den)``, above 0 and at most 1). With ``links`` there is ``n_links`` too, the number of rows that a row links to
    (null without an id); all pairs of different sets of a component are compared for it, in cells. Other defined results: see
    the module.
    """
    num, den = threshold
    if not 0 < num <= den or n < 1:
        raise ValueError("threshold must be in (0, 1], n at least 1")
    scratch = Scratch(spark, "ngram-jaccard")

    def in_cells(rows: DataFrame) -> DataFrame:
        """Rows (with ``parts`` of their group) in each cell (i, j) of their group that their part is in."""
        dealt = rows.withColumn("part", F.pmod(F.hash("class"), F.col("parts")))
        return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")

    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    source = keyed.select("id", "text")
    signed = scratch.table(keyed.mapInArrow(_signed(n), "id long, text_key long, n long, s1 long, s2 long"), "signed")
    # as a table of its own, so that both sides of the join are plain exchanges, which adaptive execution can split at a large class
    classes = signed.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    member = scratch.table(signed.join(classes, ["s1", "s2", "n"], "left").select("id", "text_key", "n", "rep", "class"), "member")
    scratch.drop("signed")
    total = member.agg(F.sum("n")).first()[0] or 0
    bits = int(min(60, max(32, np.ceil(np.log2(total + 1)) + 8)))
    bucket_bits = int(min(24, max(4, np.ceil(np.log2(total / (1 << 21) + 1)))))
    in_blocks = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")

    counts = in_blocks(source.mapInArrow(_column_counts(n, bits, bucket_bits), "bucket int, packed binary"))
    heavy = scratch.table(counts.mapInArrow(_heavy(HEAVY_DF), "column long, df long"), "heavy")
    cut = HEAVY_DF
    by_df = [(r["df"], r["n"]) for r in heavy.groupBy(F.floor(F.log2("df") * 8).alias("df")).agg(F.count("*").alias("n")).orderBy(F.desc("df")).collect()]
    kept = 0
    for level, many in by_df:  # the most frequent columns, as many as the filter has room for
        if kept + many > MAX_HEAVY:
            cut = 2 ** ((level + 1) / 8)
            break
        kept += many
    frequent = np.asarray(heavy.filter(F.col("df") >= cut).select("column").toArrow().column(0)).astype(np.int64).view(np.uint64)
    bitmap = None
    if len(frequent):
        table, at = np.zeros(1 << (FILTER_BITS - 3), np.uint8), _filter_index(frequent)
        np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        bitmap = spark.sparkContext.broadcast(table.tobytes())
    scratch.drop("heavy")

    posted = in_blocks(source.mapInArrow(_postings(n, bits, bucket_bits, bucket_bits - 3 if bucket_bits > 3 else 0, num, den, bitmap), "bucket int, k binary, d binary, n binary"))
    met = scratch.table(posted.mapInArrow(_product(num, den, bucket_bits), PRODUCT), "met")
    def sets_of(wanted: DataFrame, tag: str) -> DataFrame:
        """(class, members) of the wanted classes, from the texts of the rows that name them."""
        chosen = scratch.table(wanted.join(classes, "class").select("class", "rep", "s1", "s2"), f"{tag}-chosen")
        ids = chosen.select(F.col("rep").alias("id")).distinct()
        many, schema = ids.count(), "rep long, s1 long, s2 long, members binary"
        if many > FILTERED_ROWS:
            found = source.join(ids, "id", "left_semi").mapInArrow(_whole_sets(n, 0, None), schema)
        else:
            width = max(10, (16 * many).bit_length())
            marks = ids.mapInArrow(_bits(width), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
            words = np.zeros(1 << (width - 5), np.uint32)
            words[np.asarray(marks["word"])] = np.asarray(marks["bits"]).astype(np.uint32)
            found = source.mapInArrow(_whole_sets(n, width, spark.sparkContext.broadcast(words.tobytes())), schema)
        once = found.groupBy("rep", "s1", "s2").agg(F.first("members").alias("members"))
        sets = scratch.table(once.join(chosen, ["rep", "s1", "s2"]).select("class", "members"), tag)
        scratch.drop(f"{tag}-chosen")
        return sets

    postings = met.filter("kind = 1").select(F.col("a").alias("column"), F.col("b").alias("pivot"), "shared", "ids")
    parted = postings.filter("shared = 1").select("column", "pivot").distinct()
    hubs = parted.groupBy("column").agg(F.min("pivot").alias("hub"))
    between = parted.join(hubs, "column").filter("hub <> pivot").groupBy(F.col("hub").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("shared"), F.lit(0).cast("long").alias("least"))
    counted = met.filter("kind = 2").groupBy(F.col("a").alias("s1")).agg(F.sum("shared").alias("other"))
    info = scratch.table(classes.join(counted, "s1", "left").select("s1", "class", "n", F.coalesce("other", F.lit(0)).alias("other")), "info")
    pairs = met.filter("kind = 0").select("a", "b", "shared", "least").union(between).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    x, y = info.select(F.col("s1").alias("a"), F.col("class").alias("ca"), F.col("other").alias("oa")), info.select(F.col("s1").alias("b"), F.col("class").alias("cb"), F.col("other").alias("ob"))
    pairs = pairs.join(x, "a").join(y, "b").filter(F.col("shared") + F.least("oa", "ob") >= F.col("least"))
    pairs = scratch.table(pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "sets")
    first, second = sets.select(F.col("class").alias("a"), F.col("members").alias("x")), sets.select(F.col("class").alias("b"), F.col("members").alias("y"))
    linked = scratch.table(pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(_overlaps(num, den), "a long, b long"), "links")
    scratch.drop("sets", "pairs")
    label = components(spark, linked, scratch, "first")

    rows = scratch.table(info.join(label.withColumnRenamed("id", "class"), "class", "left").select("s1", "class", "n", F.coalesce("component", "class").alias("component")), "rows")
    entries = postings.select("column", "pivot", F.explode("ids").alias("s1")).join(rows.select("s1", "component"), "s1")
    mixed = entries.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("pivot").alias("hub")).filter("lo <> hi").select("column", "hub")
    mixed = scratch.table(mixed, "mixed")
    many = postings.join(mixed, "column").select("hub", F.explode("ids").alias("s1")).groupBy("hub", "s1").agg(F.count("*").alias("columns"))
    held = scratch.table(many.join(rows, "s1"), "held")
    small = F.expr(f"({num} * n + {den - 1}) div {den}")  # the least size that a row of n columns can link to
    # two rows that link meet first, in the order of the hubs' sizes, where neither has fewer columns left than they must share
    order = Window.partitionBy("class").orderBy(F.desc("rows"), F.desc("hub"))
    sized = held.join(held.groupBy("hub").agg(F.count("*").alias("rows")), "hub").withColumn("left", F.sum("columns").over(order))
    rest = sized.filter(F.col("left") >= F.least(small, least_shared_of(small))).select("hub", "class", "component")
    parts = rest.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("hub", "parts")
    open_rows = scratch.table(rest.join(parts, "hub"), "open")
    if open_rows.limit(1).count():
        sets = sets_of(open_rows.select("class").distinct(), "cell-sets")
        more = scratch.table(in_cells(open_rows).join(sets, "class").groupBy("hub", "i", "j").applyInArrow(_cell(num, den), "a long, b long"), "more")
        scratch.drop("cell-sets")
        if more.limit(1).count():
            label = components(spark, linked.union(more), scratch, "second")
        scratch.drop("more")
    scratch.drop("met", "info", "links", "rows", "mixed", "held", "open")
    # a component is named by the smallest id of its classes; with the classes that link nothing left out
    known = label.withColumnRenamed("id", "class").join(classes.select("class", "rep", "copies"), "class")
    names = known.groupBy("component").agg(F.min("rep").alias("name"), F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    label = scratch.table(known.join(names, "component"), "names")
    own = F.when(F.col("n") > 0, F.coalesce("name", "rep")).otherwise(F.col("id"))
    out = member.join(label.select("class", "name"), "class", "left")
    extra = []
    if links:
        cells = in_cells(label.select("component", "class", "copies", "parts")).join(sets_of(label.select("class"), "link-sets"), "class")
        counted = scratch.table(cells.groupBy("component", "i", "j").applyInArrow(_link_counts(num, den), "class long, links long").groupBy("class").agg(F.sum("links").alias("links")), "counted")
        scratch.drop("link-sets")
        out = out.join(counted, "class", "left").join(classes.select("class", "copies"), "class", "left")
        extra = [F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")]
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"), "text_key", *extra)


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``, any others) without near duplicates: of a component the row that names it stays.

    Rows are told apart by id and text. Of rows that share the smallest id of a component, one with the smallest key of
    its text stays. Rows with a null id are in no component and stay.
    """
    classed = Scratch(spark, "near-duplicates").table(ngram_jaccard(spark, docs, **options), "classed")
    at, by, row = unused(docs, "class_id", "class_key", "class_row")
    same = (F.col("doc_id") == F.col(at)) & (F.xxhash64(F.col("text").cast("string")) == F.col(by))
    gone = classed.filter("component_id < doc_id").select(F.col("doc_id").alias(at), F.col("text_key").alias(by)).distinct()
    kept = docs.join(gone, same, "left_anti")
    again = classed.filter("component_id = doc_id").groupBy(F.col("doc_id").alias(at)).agg(F.count("*").alias("n"), F.min("text_key").alias(by)).filter("n > 1").select(at, by)
    if not again.limit(1).count():
        return kept
    once = kept.join(again, same, "left_semi").groupBy("doc_id").agg(F.first(F.struct(*docs.columns)).alias(row))
    return kept.join(again, F.col("doc_id") == F.col(at), "left_anti").select(*docs.columns).union(once.select(f"{row}.*"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, len(words) AS many, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
g AS (SELECT doc_id, many, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS gram FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE i <= greatest(many - 4, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
