"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt into lists by their nearest centroid (k-means on a bounded, documented sample; every vector is indexed)
and turned by one random rotation, so that any leading coordinates are a fair sample of a distance. Lists are kept in
column blocks. A query scans its probed lists block by block: after ``d`` of ``D`` dimensions a candidate is abandoned if
its partial distance, scaled by ``D/d``, exceeds the threshold by more than the factor ``(1 + epsilon/sqrt(d))**2``, the
hypothesis test of the method. The nearest few lists are scanned first and set each query's threshold; the other
probed lists then give only what beats it. Distances of what is left are computed anew from the original vectors.

How many lists are probed is not a constant: true neighbours of some sampled vectors are looked up in the sample, and as many
lists are probed as hold ``target_recall`` of them (``share_of_lists``). Vectors with clusters need few, vectors without need
most of them.

Equal vectors are one vector of the index with their smallest ids, as many as a result can name, and equal queries are
one query; lists are cut into parts of at most about ``PART`` vectors, so no list, however popular, is one task. Queries are
taken in blocks of at most ``BLOCK_BYTES``, each broadcast once; what moves for a probed list is the query's number, and a
vector moves once for each block of queries.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or a component that isn't
finite take no part, nor do rows with a null id; repeated rows count once; with fewer candidates all are returned; ties
go to the smaller id; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch

PART = 4096
#: Bytes of the turned query vectors that are broadcast at a time.
BLOCK_BYTES = 8 << 20
MAX_LISTS, SAMPLE_PER_LIST, MAX_SAMPLE = 4096, 64, 65_536
COLUMNS, ROWS = 16, 1024
SPARE = 6
#: Sampled vectors whose neighbours tell how many lists to probe.
TRIED = 256


def kmeans(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 4) -> np.ndarray:
    rng = np.random.RandomState(seed)
    centre = x[rng.choice(len(x), lists, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centre, 1)[:, 0]
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        many = np.bincount(near, minlength=lists)
        centre[many > 0] = total[many > 0] / many[many > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centroids of each vector, nearest first."""
    out = []
    for s in range(0, len(x), 4096):
        d = (centre**2).sum(1)[None, :] - 2 * x[s : s + 4096] @ centre.T
        out.append(np.argmin(d, 1)[:, None] if k == 1 else np.argsort(d, 1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float32).reshape(-1, dims)


def scan(blocks: list[np.ndarray], query: np.ndarray, limit: float, keep: int, dims: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of up to ``keep`` vectors that are nearest to a query and not beyond ``limit``."""
    found_at, found = np.zeros(0, np.int64), np.zeros(0)
    for s in range(0, len(blocks[0]), ROWS):
        alive = np.arange(s, min(s + ROWS, len(blocks[0])))
        partial, seen = np.zeros(len(alive)), 0
        for block in blocks:
            step = block[alive] - query[seen : seen + block.shape[1]]
            partial = partial + np.einsum("ij,ij->i", step, step, dtype=np.float64)
            seen += block.shape[1]
            if np.isfinite(limit):
                stay = partial * (dims / seen) <= limit * (1 + (epsilon / np.sqrt(seen) if seen < dims else 1e-6)) ** 2
                alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        found_at, found = np.concatenate((found_at, alive)), np.concatenate((found, partial))
        if len(found) > keep:
            best = np.argpartition(found, keep - 1)[:keep]
            found_at, found = found_at[best], found[best]
        if len(found) == keep:
            limit = min(limit, float(found.max()))
    return found_at, found


def share_of_lists(sample: np.ndarray, centre: np.ndarray, k: int, target_recall: float) -> float:
    """The share of lists, nearest first, that holds the target share of the ``k`` nearest sampled vectors of sampled vectors."""
    tried = sample[: min(TRIED, len(sample))]
    own = nearest(sample, centre, 1)[:, 0]
    ranks = []
    for q in tried:
        d = ((sample - q) ** 2).sum(1)
        order = np.empty(len(centre), np.int64)
        order[nearest(q[None, :], centre, len(centre))[0] if len(centre) > 1 else [0]] = np.arange(len(centre))
        near = np.argsort(d, kind="stable")[1 : k + 1]
        ranks.append(order[own[near]])
    ranks = np.sort(np.concatenate(ranks))
    if not len(ranks):
        return 1.0
    return (ranks[min(len(ranks) - 1, int(np.ceil(target_recall * len(ranks))) - 1)] + 1) / len(centre)


def _scan_cell(queries_of, dims: int, keep: int, epsilon: float):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        q_out, c_out, d_out = [], [], []
        if len(vectors) and len(queries):
            known, turned = queries_of.value
            cid, x = np.asarray(vectors["cid"]), matrix(vectors["turned"], dims)
            blocks = [np.ascontiguousarray(x[:, s : s + COLUMNS]) for s in range(0, dims, COLUMNS)]
            asking = np.asarray(queries["query"])
            for q, at, limit in zip(asking, np.searchsorted(known, asking), np.asarray(queries["limit"]), strict=True):
                place, d = scan(blocks, turned[at], float(limit), keep, dims, epsilon)
                q_out.append(np.full(len(place), q))
                c_out.append(cid[place])
                d_out.append(d)
        of = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query": of(q_out, pa.int64()), "cid": of(c_out, pa.int64()), "near": of(d_out, pa.float64())})

    return run


def usable(embedding: Column) -> Column:
    whole = ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & F.coalesce(whole & F.exists(embedding, lambda v: v != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, target_recall: float = 0.97, probe_share: float | None = None, first_share: float = 0.06, epsilon: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of the ``k`` nearest rows found for the rows that ``is_query`` (over the id) admits.

    ``probe_share`` of the lists are probed, or as many as ``target_recall`` asks for. The index holds single precision,
    scores are of the vectors as they are given.
    """
    scratch, schema = Scratch(spark, "ann"), "query_id long, rank int, vec_id long, score double"
    kind = dict(vectors.dtypes)[vector_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("embedding")).filter("vec_id is not null").filter(usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["dims"]
    rows = rows.filter(F.size("embedding") == dims).withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    rows = rows.groupBy("vec_id", "h1", "h2").agg(F.first("embedding").alias("embedding"))
    order = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    small = rows.withColumn("place", order).filter(F.col("place") <= k + 1)
    classes = scratch.table(small.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    total = classes.count()
    lists = int(min(MAX_LISTS, max(1, round(np.sqrt(total)))))
    sample = classes.orderBy(F.xxhash64("cid")).limit(min(MAX_SAMPLE, SAMPLE_PER_LIST * lists)).select("embedding").toArrow()
    sample = matrix(sample["embedding"], dims)
    lists = min(lists, len(sample))
    fitted = kmeans(sample, lists)
    turn = np.linalg.qr(np.random.RandomState(7).standard_normal((dims, dims)))[0]
    shared = spark.sparkContext.broadcast((fitted, turn))

    def assign(batches):
        centre, turn = shared.value
        for batch in batches:
            x = matrix(batch.column(1), dims)
            turned = (x @ turn).astype(np.float32)
            yield pa.record_batch([batch.column(0), pa.array(nearest(x, centre, 1)[:, 0].astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(turned.ravel()), dims).cast(pa.list_(pa.float32()))], ["cid", "list", "turned"])

    indexed = scratch.table(classes.select("cid", "embedding").mapInArrow(assign, "cid long, list int, turned array<float>"), "indexed")
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    enough = int(np.searchsorted(np.cumsum(np.sort(sizes)), min(k + 1, total))) + 1  # lists that hold as many vectors as a result needs, whichever they are
    if probe_share is None:
        probe_share = share_of_lists(sample, fitted, k, target_recall)
    probes, first = max(1, int(np.ceil(lists * probe_share)), enough), max(1, int(np.ceil(lists * first_share)))
    asked = scratch.table(rows.filter(is_query).select("vec_id", "h1", "h2"), "asked")
    asking = scratch.table(classes.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(F.col("cid").alias("query"), "embedding"), "asking")
    per_block = max(256, BLOCK_BYTES // (4 * dims))
    blocks = max(1, -(-asking.count() // per_block))

    def probe(lo: int, hi: int):
        def run(batches):
            centre, _ = shared.value
            for batch in batches:
                x = matrix(batch.column(1), dims)
                near = nearest(x, centre, hi)[:, lo:hi] if hi > 1 else nearest(x, centre, 1)
                many = near.shape[1]
                limit = batch.column(2).take(pa.array(np.repeat(np.arange(len(x)), many)))
                yield pa.record_batch([pa.array(np.repeat(np.asarray(batch.column(0)), many)), pa.array(near.ravel().astype(np.int32)), limit], ["query", "list", "limit"])

        return run

    parts = F.broadcast(indexed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))  # a row for each of at most MAX_LISTS lists
    left = indexed.join(parts, "list").select("list", F.pmod(F.hash("cid"), F.col("parts")).alias("part"), "cid", "turned")

    def scanned(queries: DataFrame, held, lo: int, hi: int, tag: str) -> DataFrame:
        probed = queries.mapInArrow(probe(lo, hi), "query long, list int, limit double")
        right = probed.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "limit")
        cells = left.groupBy("list", "part").cogroup(right.groupBy("list", "part"))
        return scratch.table(cells.applyInArrow(_scan_cell(held, dims, k + 1 + SPARE, epsilon), "query long, cid long, near double"), tag)

    near = None
    for b in range(blocks):
        block = asking.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        of_block = block.orderBy("query").toArrow()
        held = spark.sparkContext.broadcast((np.asarray(of_block["query"]), (matrix(of_block["embedding"], dims) @ turn).astype(np.float32)))
        found = scanned(block.withColumn("limit", F.lit(float("inf"))), held, 0, first, f"first-{b}")
        if probes > first:
            ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("near", "cid"))).filter(F.col("place") <= k + 1 + SPARE)
            limits = ranked.groupBy("query").agg(F.max(F.when(F.col("place") == k + 1 + SPARE, F.col("near"))).alias("limit"))
            told = block.join(limits, "query", "left").select("query", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
            found = found.union(scanned(told, held, first, probes, f"second-{b}"))
        held.destroy()
        near = found if near is None else near.union(found)
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("near", "cid"))).filter(F.col("place") <= k + 1 + SPARE).select("query", "cid")
    theirs = classes.select("cid", F.col("embedding").alias("theirs"), "ids")
    mine = classes.select(F.col("cid").alias("query"), "h1", "h2", F.col("embedding").alias("mine"))
    scored = best.join(theirs, "cid").join(mine, "query").select("h1", "h2", F.explode("ids").alias("vec_id"), distance(F.col("mine"), F.col("theirs")).alias("score"))
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("score", "vec_id"))).filter(F.col("place") <= k + 1).drop("place")
    paired = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(top, ["h1", "h2"]).filter("query_id <> vec_id")
    out = paired.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
