"""Operator 11: sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends from regions to racks to shards. At each level the children of the node it stands in draw: child i of
weight w gets -ln(u) / w, with u hashed from the document's key and the child's name, and the smallest draw wins, so a
child is chosen in proportion to its weight. A node's weight is that of the shards below it. A draw depends on nothing
but the key, the child and its weight; so when weights change, rows move only into subtrees whose weight rose or out of
subtrees whose weight fell, and the choices inside all other subtrees stay as they are.

A shard that is added within a rack raises the weights above it, and rows that enter its region are drawn among all of
the region's racks. So one more shard comes as a region of its own (``Tree.grown``): it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import range_sums, staged

SEED = 11


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack][shard]``; shards are numbered from 0 in that order. A weight of 0 takes no rows."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def of(shards: int, shards_a_rack: int = 4, racks_a_region: int = 2) -> Tree:
        """Shards of weight 1 in racks and regions of these sizes; the last ones may be smaller."""
        size = shards_a_rack * racks_a_region
        rows = [[min(shards_a_rack, shards - at) for at in range(first, min(first + size, shards), shards_a_rack)] for first in range(0, shards, size)]
        return Tree(tuple(tuple((1.0,) * n for n in racks) for racks in rows))

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard."""
        return Tree((*self.weights, ((float(weight),),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _bits(*parts: Column) -> Column:
    """48 bits hashed from the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 12), 16, 10).cast("long")


def _drawn(weights: Column, key: Column, *path: Column) -> Column:
    """The child whose draw is smallest, the first of equals."""

    def draw(weight: Column, child: Column) -> Column:
        u = (_bits(F.lit(SEED), *path, child, key) + 0.5) / float(1 << 48)
        return F.struct(F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf"))).alias("draw"), child.alias("child"))

    return F.array_min(F.transform(weights, draw)).getField("child")


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def _nested(values: list) -> Column:
    return F.array(*(_nested(v) if isinstance(v, list) else F.lit(float(v)) for v in values))


def with_shard(rows: DataFrame, tree: Tree, key: str, out: str) -> DataFrame:
    """Adds ``out``: the shard (int) that the string column ``key`` descends to. No shuffle."""
    if not any(w > 0 for region in tree.weights for rack in region for w in rack):
        raise ValueError("a tree needs a shard of some weight")
    racks = [[sum(rack) for rack in region] for region in tree.weights]
    first, n = [], 0
    for region in tree.weights:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    region, rack = F.col("__region"), F.col("__rack")
    return (
        rows.withColumn("__region", _drawn(_nested([sum(r) for r in racks]), F.col(key)))
        .withColumn("__rack", _drawn(_nested(racks)[region], F.col(key), region))
        .withColumn("__shard", _drawn(_nested([[list(rack) for rack in r] for r in tree.weights])[region][rack], F.col(key), region, rack))
        .withColumn(out, (_nested(first)[region][rack] + F.col("__shard")).cast("int"))
        .drop("__region", "__rack", "__shard")
    )


def assign(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, size, text_crc32, shard, slot, grown_shard``: one row a document.

    The id and the tree decide the shard; ``grown_shard`` is the shard in the tree with one more. A shard's slots are
    numbered from 0 without gaps in the order of a hash of the id. Texts are read once and never shuffled: only narrow
    rows are range-sorted by shard and place, so neither a shard nor an id with a third of all rows is one task.

    A null id is a key of its own; rows that share an id share its shard and have slots by size and checksum, and equal
    rows any of theirs; a null text counts 8 bytes, as an empty one, with checksum 0; very long texts are taken whole; an
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + 8).cast("long").alias("__size"), F.crc32(text).alias("__crc"))
    keyed = narrow.withColumn("__key", _key(F.col("__id"))).withColumn("__place", _bits(F.lit(SEED), F.lit("slot"), F.col("__key")))
    found = with_shard(with_shard(keyed, tree, "__key", "__at"), tree.grown(), "__key", "__grown")
    rows = staged(found.select("__id", "__size", "__crc", "__place", "__at", "__grown", F.monotonically_increasing_id().alias("__row")))
    ordered = range_sums(rows, [F.col(c) for c in ("__at", "__place", "__id", "__size", "__crc", "__row")], {"__upto": F.lit(1).cast("long")})
    counts = {r[0]: r[1] for r in rows.groupBy("__at").count().collect()}  # a row a shard
    starts, upto = [], 0
    for shard in range(tree.shards):
        starts.append(F.lit(upto).cast("long"))
        upto += counts.get(shard, 0)
    slot = F.col("__upto") - F.array(*starts)[F.col("__at")]
    return ordered.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__at").alias("shard"), slot.alias("slot"), F.col("__grown").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, tree: Tree, id_col: str = "doc_id") -> None:
    """Writes ``docs`` as Parquet in a folder a shard (``__shard=0``, ...), rows in the order of their slots' places.

    One range shuffle of whole rows: a shard larger than a task is cut into several files. All columns of ``docs`` stay.
    """
    keyed = docs.withColumn("__key", _key(F.col(f"`{id_col}`"))).withColumn("__place", _bits(F.lit(SEED), F.lit("slot"), F.col("__key")))
    order = [F.col("__shard"), F.col("__place"), F.col("__salt")]
    placed = with_shard(keyed, tree, "__key", "__to").withColumnRenamed("__to", "__shard").withColumn("__salt", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__key", "__place", "__salt").write.partitionBy("__shard").parquet(path)
