"""Sharding against its draws made one by one, and what moves when weights change."""

import binascii
import hashlib
import math
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paddock.llm import queries, sharding

from ..compare import SF
from .test_operators import awkward, docs_of


def by_hand(key, tree):
    """The shard that a key descends to."""

    def least(weights, path):
        draws = []
        for i, w in enumerate(weights):
            u = (int(hashlib.md5(":".join(map(str, (11, *path, i, key))).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            draws.append(-math.log(u) / w if w else math.inf)
        return draws.index(min(draws))

    region = least([sum(map(sum, r)) for r in tree.weights], ())
    rack = least([sum(k) for k in tree.weights[region]], (region,))
    shard = least(tree.weights[region][rack], (region, rack))
    return sum(len(k) for r in tree.weights[:region] for k in r) + sum(len(k) for k in tree.weights[region][:rack]) + shard


def shards(spark, tree, n=6000):
    rows = spark.range(n).select(F.concat(F.lit("="), F.col("id").cast("string")).alias("key"))
    return {r.key: r.at for r in sharding.with_shard(rows, tree, "key", "at").collect()}


TREE = sharding.Tree((((1, 2), (3, 0)), ((1, 1, 1),), ((0.5, 2.5), (1,), (2,))))


def test_draws_by_hand(spark):
    found = shards(spark, TREE, 2000)
    assert found == {k: by_hand(k, TREE) for k in found}


def test_shares_follow_weights(spark):
    found, weights = Counter(shards(spark, TREE, 20_000).values()), [w for r in TREE.weights for k in r for w in k]
    for shard, w in enumerate(weights):
        share = w / sum(weights)
        assert abs(found[shard] - 20_000 * share) <= 5 * math.sqrt(20_000 * share * (1 - share)) + 1e-9


def test_movement_stays_in_changed_subtrees(spark):
    before = shards(spark, TREE)
    heavier = sharding.Tree((((1, 2), (3, 0)), ((1, 1, 1),), ((0.5, 2.5), (4,), (2,))))  # shard 9's weight rises
    after = shards(spark, heavier)
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(b >= 7 for _, b in moved)  # only into its region
    assert all(b == 9 for a, b in moved if a >= 7)  # within the region, only into its rack
    assert any(a < 7 and b != 9 for a, b in moved)
    grown = shards(spark, TREE.grown(2))
    assert {b for k, b in grown.items() if b != before[k]} == {TREE.shards}
    emptied = sharding.Tree((((1, 2), (3, 0)), ((1, 0, 1),), ((0.5, 2.5), (1,), (2,))))  # shard 5 is drained
    drained = shards(spark, emptied)
    assert 5 not in drained.values()
    assert all(before[k] in (4, 5, 6) for k in before if drained[k] != before[k])  # only its region loses rows


@pytest.mark.parametrize("shards_", [1, 3, 8, 24, 25])
def test_tree_of(shards_):
    tree = sharding.Tree.of(shards_)
    assert tree.shards == shards_ and tree.grown().shards == shards_ + 1


def test_a_tree_without_weight(spark):
    with pytest.raises(ValueError):
        sharding.with_shard(spark.range(1), sharding.Tree((((0,),),)), "id", "at")


def test_assign_odd_rows(spark):
    """Null ids and texts, repeated rows, one id with a third of all rows, clashing columns."""
    rows = awkward() + [(7, "same", "en", "a")] * 40
    tree = sharding.Tree.of(5, 2, 2)
    docs = docs_of(spark, rows).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("__at", F.lit(2))
    got = sharding.assign(docs, tree).collect()
    want = Counter()
    for i, t, _, _ in rows:
        key, data = "-" if i is None else f"={i}", (t or "").encode()
        want[i, len(data) + 8, binascii.crc32(data), by_hand(key, tree), by_hand(key, tree.grown())] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    empty = sharding.assign(docs.limit(0), tree)
    assert empty.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"] and empty.count() == 0


def test_query_over_documents(spark):
    """Each document once, every shard in use, the 25th with about its share."""
    got = queries.op11_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert {r.law for r in got} == {"key"} and {r.shard for r in got} <= set(range(24))


def test_written_shards(spark, tmp_path):
    docs = docs_of(spark, awkward())
    tree = sharding.Tree.of(5, 2, 2)
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path, tree)
    back = spark.read.parquet(path)
    assert back.drop("__shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert {(r.doc_id, r["__shard"]) for r in back.select("doc_id", "__shard").collect()} == {(i, by_hand("-" if i is None else f"={i}", tree)) for i, *_ in awkward()}
    assert len(list(Path(f"{tmp_path}/shards").glob("__shard=*"))) > 1
