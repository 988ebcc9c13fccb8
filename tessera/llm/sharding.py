"""Sharding by a hierarchical weighted hash tree.

A tree has regions, a region racks, a rack shards; a node weighs as much as the shards below it. A row descends from the
root: among the children of its node the one with the smallest ``-ln(u) / weight`` wins, ``u`` being a hash of the row's
key and the child's path. A child's draw depends on its own path and weight alone, so a change of weights moves rows only
into or out of the subtrees whose weights change. ``grown`` adds a shard as a region of its own: every other draw stays,
and rows move into the new shard only.

A row's slot numbers the rows of its shard without gaps. Rows of a shard are cut into ranges of a hash, the ranges are
counted, and the running counts are where each range starts: no task numbers a whole shard.

Defined results: a null id is the key ``null``; a null text has no bytes and checksum 0; rows that repeat an id share its
shard and have slots of their own; no rows give no rows. Of the input, only columns named in ``keep`` are returned, and
one that the operator's own columns clash with is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, unused

OWN = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Tree:
    """``regions[i][j][k]``: the number and the weight of shard k of rack j of region i."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, (((self.shards, weight),),)))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """By the path of a node: paths and weights of its children."""
        weigh = lambda racks: sum(w for rack in racks for _, w in rack)
        found = {"": [(str(i), weigh(region)) for i, region in enumerate(self.regions)]}
        for i, region in enumerate(self.regions):
            found[f"{i}"] = [(f"{i}/{j}", weigh([rack])) for j, rack in enumerate(region)]
            for j, rack in enumerate(region):
                found[f"{i}/{j}"] = [(f"{i}/{j}/{shard}", w) for shard, w in rack]
        return found


def even_tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Tree:
    number = iter(range(regions * racks * shards))
    return Tree(tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))


def hashed(digits: int, *parts: Column) -> Column:
    """The number that the first hexadecimal digits (15 at most) of the MD5 of the parts, joined by colons, say."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight``, from 52 bits of a hash of key and path."""
    return -F.ln((hashed(13, key, path).cast("double") + 0.5) / F.lit(float(1 << 52))) / weight


def leaf(tree: Tree, key: Column) -> Column:
    """The number of the shard that ``key`` descends to."""
    children = tree.children()
    nodes = F.create_map(*[x for path, below in children.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for p, w in below]))])

    def down(at: Column) -> Column:
        return F.array_min(F.transform(F.element_at(nodes, at), lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path"))))["path"]

    return F.element_at(F.split(down(down(down(F.lit("")))), "/"), -1).cast("int")


def shard_documents(spark: SparkSession, docs: DataFrame, tree: Tree | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` (``key``), ``shard``, ``slot``, ``grown_shard`` and the ``keep`` columns."""
    tree = tree or even_tree()
    scratch = Scratch(spark, "sharding")
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *[F.col(c) for c in keep if c.lower() not in OWN],
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    # rows without id share a key, and so a shard: there may be many, and their places are told apart by where they are read
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id().cast("string"))
    order, at, start, inside = unused(own, "slot_order", "slot_range", "slot_start", "slot_inside")
    placed = own.withColumn("shard", leaf(tree, key)).withColumn("grown_shard", leaf(tree.grown(), key))
    placed = placed.withColumn(order, hashed(15, F.lit("slot"), key, F.col("text_crc32").cast("string"), F.col("size").cast("string"), place))
    placed = scratch.table(placed.withColumn(at, F.shiftright(F.col(order), 60 - bits).cast("int")), "placed")
    counted = placed.groupBy("shard", at).agg(F.count("*").alias(start))
    before = Window.partitionBy("shard").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", at, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    number = F.row_number().over(Window.partitionBy("shard", at).orderBy(order, "doc_id", "size", "text_crc32"))
    slotted = placed.withColumn(inside, number).join(starts, ["shard", at])
    kept = [c for c in own.columns if c not in OWN]
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col(start) + F.col(inside) - 1).cast("long").alias("slot"), "grown_shard", *kept)


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_draw(path: str, weight: str) -> str:
    return f"-ln((('0x' || substr(md5(doc_id || ':' || {path}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {weight}"


def _sql_leaf(root: str, weight: str) -> str:
    """Of the default tree, with one more region of one shard where ``root`` has four children."""
    first = f"list_sort(list_transform({root}, lambda r: {{'d': {_sql_draw('r', weight)}, 'p': r}}))[1].p"
    second = f"list_sort(list_transform([0, 1], lambda k: {{'d': {_sql_draw("region || '/' || k", '4')}, 'p': k}}))[1].p"
    third = f"list_sort(list_transform([0, 1, 2, 3], lambda k: {{'d': {_sql_draw("region || '/' || rack || '/' || (region * 8 + rack * 4 + k)", '1')}, 'p': region * 8 + rack * 4 + k}}))[1].p"
    racked = f"SELECT *, CASE WHEN region < 3 THEN {second} END AS rack FROM (SELECT doc_id, {first} AS region FROM documents)"
    return f"SELECT DISTINCT doc_id, CASE WHEN region < 3 THEN {third} ELSE 24 END AS shard FROM ({racked})"


ORACLE = f"""
WITH table_of AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
x AS (SELECT doc_id, text, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
b AS (SELECT doc_id, size, list_transform(range(size - 8), lambda i: ('0x' || h[2 * i + 1] || h[2 * i + 2])::BIGINT) AS bytes FROM x),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, table_of),
p AS ({_sql_leaf('[0, 1, 2]', '8')}),
g AS ({_sql_leaf('[0, 1, 2, 3]', '(CASE WHEN r = 3 THEN 1 ELSE 8 END)')}),
o AS (SELECT c.*, ('0x' || substr(md5('slot:' || doc_id || ':' || text_crc32 || ':' || size), 1, 15))::BIGINT AS place FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, p.shard::INT AS shard, row_number() OVER (PARTITION BY p.shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot, g.shard::INT AS grown_shard
FROM o JOIN p USING (doc_id) JOIN g USING (doc_id)
"""
