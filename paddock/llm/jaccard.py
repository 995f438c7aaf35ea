"""Operator 6: n-gram Jaccard join over a token-group matrix.

Two documents link when the Jaccard similarity of their sets of word shingles reaches the threshold. Equal sets are one
node from the start. Under one order of all tokens (by hash), take of each set of n the first n - a + l, where a is the
least overlap it can link with: two sets that link share at least l of those. Here l = n - a + 2, so more than half of a
node's first tokens must be met, and passages that documents have in common do not make candidates of them.

1. Nodes are partitioned into groups, each around the most central node that its members share tokens with.
2. The matrix has a row for each (token, group): the token union of each group, with the range of its members' sizes.
3. A query node's overlap with a group's union, its own tokens aside, bounds its overlap with any member; only groups
   that reach l are opened.
4. A node meets the centre of its group first. Of the groups opened, members already known to be connected to it need no
   comparison; of the others, only those are counted whose sketches allow a link, and then compared exactly over whole
   sets. So components are exact though most pairs within a group are never made.

A sketch holds the parity of the tokens in each of some cells: two sets differ in at least as many tokens as their
sketches do in cells. Sets too large for the cells just pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import staged, tasks, tidy, unstaged

#: First tokens that a task gathers before it deals them out.
DEALT = 1 << 20
#: 64-bit words of a set's sketch.
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: Keys that over a thousandth of all rows have are fewer than this, so a number for each can be sent to every task.
HOT = 1000

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """64-bit hashes of the blank-separated words of a text in lower-case ASCII, from differences of running sums."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        if len(raw) > len(self.up):
            n = 1 << (len(raw) - 1).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(n - 1, f)]).cumprod(dtype=np.uint64) for f in (_ODD, _INVERSE))
        word = ~_BLANK[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[np.minimum(starts, max(len(raw) - 1, 0))] + (ends - starts).astype(np.uint64))

    def shingles(self, text: str, width: int) -> np.ndarray:
        """The sorted distinct shingles; a text of fewer words is one shingle, one without words has none."""
        words = self.hashes(text)
        if not len(words):
            return words
        spans = [words[i : len(words) - width + 1 + i] for i in range(width)] if len(words) >= width else [words[i : i + 1] for i in range(len(words))]
        out = np.full(len(spans[0]), len(spans), np.uint64)
        for span in spans:
            out = out * _ODD + span
        return np.unique(mixed(out))


_WORDS = Words()


def _least(n: int, percent: int) -> int:
    """The least overlap that a set of n can have with one it links to."""
    return -(-percent * n // 100)


def _first(s: np.ndarray, percent: int) -> np.ndarray:
    return s[: 2 * (len(s) - _least(len(s), percent) + 1)] if len(s) else s


def _sketch(s: np.ndarray) -> list[int]:
    """The parity of the tokens in each of the cells, as 64-bit words."""
    at = (mixed(s ^ _ODD) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH_WORDS)
    odd = np.bincount(at, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _agreed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of these sizes that link."""
    return F.ceil((a + b) * percent / (100 + percent))


def _alike(a: Column, b: Column, left: str, right: str, percent: int) -> Column:
    """Sets of these sizes whose sketches differ in no more cells than linked sets differ in tokens."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))) for s in SKETCH))
    return apart <= a + b - 2 * _agreed(a, b, percent)


def _met(a: Column, b: Column, percent: int) -> Column:
    """The least that linked sets of these sizes share of the first tokens of both."""
    taken = lambda n: F.least(n, 2 * (n - F.ceil(n * percent / 100) + 1)) - n
    return F.least(taken(a), taken(b)) + _agreed(a, b, percent)


def _common(n: Column, percent: int) -> Column:
    """The tokens l that a set of n shares, of its first ones, with any it links to; all it has, if it has fewer first ones."""
    least = F.ceil(n * percent / 100)
    return F.least(n - least + 2, least)


def _some(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches, so many rows at a time: only their texts and sets are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _listed(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype=np.int32), pa.array(flat))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, k1, k2, sketch``: size, identity and sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            sizes, k1, k2, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = _WORDS.shingles(text or "", width)
                sizes.append(len(s))
                k1.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce(mixed(s * _ODD)).view(np.int64)) if len(s) else 0)
                sketches.append(_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["id", "n", "k1", "k2", "sketch"])

    return staged(docs.select("id", "text").mapInArrow(run, "id long, n long, k1 long, k2 long, sketch array<long>"))


def _shared_tokens(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``token, id, n``: those first tokens of each document that occur elsewhere too.

    Tokens are dealt out by hash to buckets, in rows of many, and told apart there; the number of buckets follows the
    session's shuffle width, so neither a bucket nor anything sent to all tasks grows with the input.
    """
    buckets = 2 * tasks(docs.sparkSession)

    def dealt(firsts: list[np.ndarray], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        tokens, lengths = np.concatenate(firsts), [len(f) for f in firsts]
        to = (mixed(tokens) >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(to, kind="stable")
        bucket, starts = np.unique(to[order], return_index=True)
        cut = pa.array(np.append(starts, len(tokens)), pa.int32())
        columns = (tokens.view(np.int64), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.ListArray.from_arrays(cut, pa.array(c[order])) for c in columns)], ["bucket", "tokens", "ids", "sizes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, ids, sizes, held = [], [], [], 0
        for batch in _some(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = _WORDS.shingles(text or "", width)
                if len(s):
                    firsts.append(_first(s, percent).copy())
                    ids.append(i)
                    sizes.append(len(s))
                    held += len(firsts[-1])
                if held >= DEALT:
                    yield dealt(firsts, ids, sizes)
                    firsts, ids, sizes, held = [], [], [], 0
        if held:
            yield dealt(firsts, ids, sizes)

    def shared(bucket: pa.Table) -> pa.Table:
        tokens, ids, sizes = (bucket.column(c).combine_chunks().flatten().to_numpy() for c in ("tokens", "ids", "sizes"))
        order = np.argsort(tokens)
        same = np.diff(tokens[order]) == 0
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        return pa.table({"token": tokens[order], "id": ids[order], "n": sizes[order].astype(np.int64)})

    rows = docs.filter("id is not null").select("id", "text").mapInArrow(deal, "bucket int, tokens array<long>, ids array<long>, sizes array<int>")
    return rows.groupBy("bucket").applyInArrow(shared, "token long, id long, n long")


def _whole(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, members``: the whole sets of the documents named, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed([_WORDS.shingles(t or "", width) for t in batch.column(1).to_pylist()])], ["id", "members"])

    return docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, members array<long>")


def _frequent(rows: DataFrame, key: str, total: int) -> DataFrame:
    """``at``: the keys that over a thousandth of the ``total`` rows have."""
    counted = rows.groupBy(F.col(key).alias("at")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(F.col("rows") * HOT > total).select("at")


def _looked_up(rows: DataFrame, key: str, hot: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``rows`` with the ``value`` that ``table``, of one row for each ``at``, has for their ``key``.

    What the keys ``hot`` find is sent to their rows, so no task gets all rows of one; the others are met by a shuffle.
    """
    few = F.broadcast(table.join(F.broadcast(hot), "at"))
    marked = rows.join(few, F.col(key) == F.col("at"), "left").drop("at")
    far = marked.filter(F.col(value).isNull()).drop(value).join(table, F.col(key) == F.col("at")).drop("at")
    return marked.filter(F.col(value).isNotNull()).unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each end of an edge ``(a, b)`` reaches; least labels with hooking and pointer jumping.

    A node takes the least of its own label and its neighbours', its label's node takes the least that it finds this way (so
    trees hook onto lower ones as a whole, and a chain needs rounds by the log of its length), then each label becomes its
    label's label. Labels only fall, so this ends; it goes on until nothing changes. Labels are staged each round. A node
    with a third of all edges, or a label with a third of all nodes, is met where its rows lie; sums are partial first.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    hubs, nodes = staged(_frequent(both, "b", both.count())), labels.count()
    while True:
        near = _looked_up(both, "b", hubs, labels.withColumnRenamed("node", "at"), "component").groupBy("a").agg(F.min("component").alias("near"))
        found = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        found = staged(found)
        hooks = found.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("hook"))
        lower = staged(found.join(hooks, found["node"] == hooks["root"], "left").select("node", "component", F.least("low", F.coalesce("hook", "low")).alias("low")))
        up = lower.select(F.col("node").alias("at"), F.col("low").alias("jump"))
        jumped = _looked_up(lower, "low", _frequent(lower, "low", nodes), up, "jump")
        old, labels = labels, staged(jumped.select("node", F.col("jump").alias("component"), (F.col("jump") != F.col("component")).alias("moved")))
        unstaged(found, lower, old)
        if labels.filter("moved").isEmpty():
            unstaged(both, hubs)
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def _with_set(pairs: DataFrame, narrow: DataFrame, total: int, sets: DataFrame, end: str) -> DataFrame:
    """``pairs`` with ``set_<end>``, the whole set of that end. An end of over a thousandth of the ``total`` rows of ``narrow``, the pairs alone, is split into
    parts of about that many, each with a copy of its set: fewer than twice HOT copies, and no pair goes."""
    counted = narrow.groupBy(F.col(end).alias("at")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") * HOT > total)
    hot = F.broadcast(staged(counted.select("at", F.ceil(F.col("rows") * HOT / total).cast("int").alias("parts"))))
    dealt = pairs.join(hot, F.col(end) == F.col("at"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"), F.lit(0))).drop("at", "parts")
    copies = sets.join(hot, F.col("id") == F.col("at"), "left").select(F.col("id").alias(end), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("members").alias(f"set_{end}"))
    return dealt.join(copies, [end, "part"]).drop("part")


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole sets reach the threshold."""
    pairs = staged(pairs)
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = staged(_whole(docs, ids, width))
    total = max(1, pairs.count())
    with_a = _with_set(pairs, pairs, total, sets, "a")
    with_both = _with_set(with_a, pairs, total, sets, "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    reached = both * 100 >= percent * (F.size("set_a") + F.size("set_b") - both)
    out = staged(with_both.filter(reached).select("a", "b").distinct())
    unstaged(pairs, ids, sets)
    return out


def _near(a: Column, b: Column, percent: int) -> Column:
    """Sizes that can link at all."""
    return F.least(a, b) * 100 >= percent * F.greatest(a, b)


def _nodes(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``id, n, node`` of each row ``(id, text)``, and ``node, component`` of the nodes that link."""
    sets = _sets(rows, width)
    real = sets.filter("n > 0 and id is not null")
    sketches = real.select("id", "n", *(F.col("sketch")[i].alias(s) for i, s in enumerate(SKETCH))).distinct()
    copies = staged(real.groupBy("n", "k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    ids = staged(sets.select("id", "n", "k1", "k2").join(copies, ["n", "k1", "k2"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("node")))
    nodes = ids.filter("n > 0 and node = id").select("id", "n").distinct()
    # fewer shared tokens than the least for any size that a set can link with rule out all links: the bound over the union of all groups
    enough = F.count(F.lit(1)).over(Window.partitionBy("id", "n")) >= _common(F.ceil(F.col("n") * percent / 100), percent)
    found = staged(_shared_tokens(rows, width, percent).join(nodes, ["id", "n"]).withColumn("enough", enough).filter("enough").drop("enough"))
    often = found.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    token = staged(found.join(often, "token"))
    unstaged(copies, found)

    # 1. groups: each node belongs to the centre that most of its tokens have
    central = token.groupBy("id").agg((F.sum("often") / F.first("n")).alias("weight"))
    weighed = staged(token.join(central, "id"))
    centre = weighed.groupBy("token").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top")).select("token", (-F.col("top.id")).alias("centre"))
    votes = weighed.join(centre, "token").groupBy("id", "n", "centre").agg(F.count(F.lit(1)).alias("votes"))
    member = staged(votes.groupBy("id", "n").agg(F.max(F.struct("votes", (-F.col("centre")).alias("centre"))).alias("top")).select("id", "n", (-F.col("top.centre")).alias("group")))
    grouped = staged(token.join(member.select("id", "group"), "id").select("token", "id", "n", "group"))
    unstaged(token, weighed, member)

    # 2. the matrix, and 3. the groups that qualify for each query node
    matrix = staged(grouped.groupBy("token", "group").agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("nodes")))
    ranges = F.least("largest", F.greatest("smallest", "n"))  # the member's size nearest to the query's
    met = grouped.join(matrix.withColumnRenamed("group", "to"), "token").filter(((F.col("group") != F.col("to")) | (F.col("nodes") > 1)) & _near(F.col("n"), ranges, percent))
    overlap = met.groupBy("id", "n", "to").agg(F.count(F.lit(1)).alias("bound"), F.min("smallest").alias("smallest"))
    lowest = F.least(_common(F.col("n"), percent), _common(F.greatest(F.col("smallest"), F.ceil(F.col("n") * percent / 100)), percent))
    opened = staged(overlap.filter(F.col("bound") >= lowest).select("id", "to"))

    # 4. each node's own centre first, then of all qualifying groups only members of other components
    token = staged(grouped.join(opened.select("id").distinct(), "id", "left_semi"))  # both ends of a link have opened a group
    unstaged(matrix, grouped)
    mine = token.filter("id <> group").join(token.select("token", F.col("id").alias("group"), F.col("n").alias("gn")), ["token", "group"])
    first = mine.filter(_near(F.col("n"), F.col("gn"), percent)).groupBy("id", "group", "n", "gn").agg(F.count(F.lit(1)).alias("met"))
    links = _linked(first.filter(F.col("met") >= _met(F.col("n"), F.col("gn"), percent)).select(F.col("id").alias("a"), F.col("group").alias("b")), rows, width, percent)
    known = components(links)
    part = staged(token.join(known, token["id"] == known["node"], "left").select("token", "id", "n", "group", F.coalesce("component", "id").alias("part")))
    parts = part.groupBy("token", "part").agg(F.count(F.lit(1)).alias("nodes"))
    major = staged(parts.groupBy("token").agg(F.max(F.struct("nodes", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("token", F.col("top.part").alias("major")))
    apart = part.join(major, "token").join(sketches, ["id", "n"])
    shown = lambda side: (F.col("id").alias(side), F.col("n").alias(f"{side}n"), F.col("part").alias(f"{side}p"), *(F.col(s).alias(f"{side}{s}") for s in SKETCH))
    apart = staged(apart)
    unstaged(token, part, major, sets)
    minor = apart.filter("part <> major").join(opened, "id").select("token", F.col("to").alias("group"), *shown("x"))
    others = apart.select("token", "group", "major", *shown("y"))
    once = (F.col("yp") == F.col("major")) | (F.col("x") < F.col("y"))  # a pair is made once for each token
    xn, yn = F.col("xn"), F.col("yn")
    cross = minor.join(others, ["token", "group"]).filter((F.col("xp") != F.col("yp")) & once & _near(xn, yn, percent) & _alike(xn, yn, "x", "y", percent))
    ends = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("xn", "yn").alias("an"), F.greatest("xn", "yn").alias("bn"))
    pairs = cross.groupBy(*ends).agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= _met(F.col("an"), F.col("bn"), percent)).select("a", "b")
    more = _linked(pairs, rows, width, percent)
    final = components(links.unionByName(more))
    unstaged(opened, apart, links, more, known)
    return ids, final


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_shingles, component_id``: one row a document, with the smallest id reachable by links.

    Null and empty texts and texts without words have no shingles and link with nothing, not even with each other; a text
    of fewer than ``width`` words is one shingle; very long texts are taken whole; a repeated id is one node with the
    links of all its rows; a row without an id keeps a null component; an empty table gives an empty result; other
    columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with tidy(docs.sparkSession):
        ids, final = _nodes(rows, width, percent)
        out = ids.join(final, ids["node"] == final["node"], "left")
        return out.select(ids["id"].alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", ids["node"]).alias("component_id"))
