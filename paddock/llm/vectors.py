"""Vectors in shards and queries in blocks: what operators 7 and 10 share.

Shards are runs of rows as they are read, packed as matrices without a shuffle, so copies of a vector or an id spread as
rows do. Each shard's tree is built once and stored with it. A cell is some shards of a bounded number of bytes, and each shard goes to one cell
once. A stated query set is packed into blocks, which travel to every cell: in its sorted stream, which Spark spills, the shards
come first and are held, and the blocks pass one by one. Each query keeps its best results from shard to shard, which bounds
the search of the next. Only results are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import staged, tasks

SHARD_ROWS, BLOCK_ROWS, LEAF = 2048, 1024, 64
#: Bytes of the shards that a task holds at once, about, and of a shard and a block at most.
CELL_BYTES, PACK_BYTES = 128 << 20, 4 << 20
PACKED = "dim int, ids binary, data binary"
TREED = PACKED + ", points binary, span binary, kids binary, lo binary, hi binary"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of the rows whose vector is not null or empty and has finite components only."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0) & fine)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of ``usable`` as matrices of up to ``most`` rows of one dimension, in the order and the tasks they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.cumsum(dims) - dims
                found = [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]
                mats = [flat[starts[at_][:, None] + np.arange(d)] for d, at_ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in found], pa.int32()),
                        pa.array([ids[at_].tobytes() for _, at_ in found], pa.binary()),
                        pa.array([m.tobytes() for m in mats], pa.binary()),
                    ],
                    ["dim", "ids", "data"],
                )

    return rows.select("id", "vec").mapInArrow(run, PACKED)


class Tree:
    """A kd-tree over the rows of a matrix: median splits of the widest side, tight boxes, leaves of up to ``LEAF`` rows.

    Rows are reordered so that each node is a slice. ``lo`` and ``hi`` hold a box a node, ``kids`` two nodes or (-1, -1).
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        span, kids, lo, hi = [], [], [], []
        todo = [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            part = points[self.order[a:b]]
            node = len(span)
            span.append((a, b))
            kids.append([-1, -1])
            lo.append(part.min(0))
            hi.append(part.max(0))
            if parent is not None:
                kids[parent[0]][parent[1]] = node
            side = hi[-1] - lo[-1]
            if b - a > LEAF and side.max() > 0:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, int(side.argmax())], mid)]
                todo += [(a, a + mid, (node, 0)), (a + mid, b, (node, 1))]
        self.span, self.kids = np.array(span, np.int32), np.array(kids, np.int32)
        self.lo, self.hi = np.array(lo), np.array(hi)


class Shard:
    """Rows in the order of their tree: ``ids``, ``vectors`` as they came, the ``points`` that the tree is over, and the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, span: np.ndarray, kids: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.ids, self.vectors, self.points, self.lo, self.hi = ids, vectors, points, lo, hi
        self.span, self.kids = span.tolist(), kids.tolist()


class Best:
    """The k best (score, id) of one query so far: highest score, then smallest id. Scores are doubles, 64-bit or whole Python numbers."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, None, np.empty(0, np.int64)

    def kth(self):
        return self.scores[-1] if len(self.ids) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.kth()
        if keep.any():
            scores, ids = scores[keep], np.concatenate([self.ids, ids[keep]])
            scores = scores if self.scores is None else np.concatenate([self.scores, scores])
            first = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores)))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def best_first(tree: Shard, bounds: np.ndarray, visit: Callable[[int, int], None], skip: Callable[[float, int], bool], done: Callable[[float], bool]) -> None:
    """Opens nodes by falling bound (one a node) until ``done(bound)``, without those to ``skip``; ``visit`` gets the slice of each leaf."""
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if done(-bound):
            return
        if skip(-bound, node):
            continue
        left, right = tree.kids[node]
        if left < 0:
            visit(*tree.span[node])
        else:
            heapq.heappush(heap, (-bounds[left], left))
            heapq.heappush(heap, (-bounds[right], right))


def _treed(shards: DataFrame, points_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each shard with its tree over ``points_of(vectors)``, which also says which rows take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = np.frombuffer(data).reshape(-1, dim)
                some, points = points_of(vectors)
                if some.any():
                    tree = Tree(points)
                    order = np.flatnonzero(some)[tree.order]
                    parts = (np.frombuffer(ids, np.int64)[order], vectors[order], points[tree.order], tree.span, tree.kids, tree.lo, tree.hi)
                    out.append((dim, *(p.tobytes() for p in parts)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [c.split()[0] for c in TREED.split(", ")])

    return shards.mapInArrow(run, TREED)


def _read(row: dict) -> Shard:
    n = len(row["ids"]) // 8
    m = len(row["span"]) // 8
    span, kids = (np.frombuffer(row[c], np.int32).reshape(m, 2) for c in ("span", "kids"))
    vectors, points = (np.frombuffer(row[c]).reshape(n, -1) for c in ("data", "points"))
    lo, hi = (np.frombuffer(row[c]).reshape(m, -1) for c in ("lo", "hi"))
    return Shard(np.frombuffer(row["ids"], np.int64), vectors, points, span, kids, lo, hi)


def search(rows: DataFrame, is_query, k: int, points_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], probe: Callable[[Shard, np.ndarray, np.ndarray, list[Best]], None], score_type: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k best of each query over all shards.

    ``points_of(matrix)`` says which rows take part and what the tree is over; ``probe(shard, query ids, queries, bests)``
    adds a shard's results. An id that occurs in more rows is one query (its smallest vector) and no candidate of itself.
    """
    spark = rows.sparkSession
    fine = usable(rows, id_col, vec_col)
    asked = staged(fine.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec")))
    widest = max(1, fine.agg(F.max(F.size("vec"))).first()[0] or 1)
    fits = max(1, PACK_BYTES // (8 * widest))
    blocks = staged(packed(asked.repartition(max(1, -(-asked.count() // BLOCK_ROWS)), "id"), min(BLOCK_ROWS, fits)))
    shards = staged(_treed(packed(fine, min(SHARD_ROWS, fits)), points_of))
    held = shards.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("data") + F.length("points") + F.length("lo") + F.length("hi")), F.lit(0))).first()
    cells = max(-(-held[1] // CELL_BYTES), min(held[0], 2 * tasks(spark)), 1)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("points", "span", "kids", "lo", "hi")]
    stay = shards.select(F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), *(c.split()[0] for c in TREED.split(", ")))
    travel = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "dim", "ids", "data", *nothing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if now != (row["dim"], row["cell"]):
                    now, trees = (row["dim"], row["cell"]), []
                if row["kind"] == 0:
                    trees.append(_read(row))
                elif trees:
                    yield _answered(row, trees)

    def _answered(block: dict, trees: list[Shard]) -> pa.RecordBatch:
        ids, out = np.frombuffer(block["ids"], np.int64), ([], [], [])
        queries, bests = np.frombuffer(block["data"]).reshape(-1, block["dim"]), [Best(k) for _ in ids]
        for tree in trees:
            probe(tree, ids, queries, bests)
        for q, best in zip(ids.tolist(), bests, strict=True):
            out[0].extend([q] * len(best.ids))
            out[1].extend(best.ids.tolist())
            out[2].extend([] if best.scores is None else best.scores.tolist())
        scores = pa.array([max(-(2**63), min(2**63 - 1, int(s))) for s in out[2]], pa.int64()) if score_type == "long" else pa.array(out[2], pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), scores], ["query_id", "cand_id", "score"])

    streams = stay.unionByName(travel).repartition(max(tasks(spark), cells), "dim", "cell").sortWithinPartitions("dim", "cell", "kind")
    found = streams.mapInArrow(run, f"query_id long, cand_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("cand_id").alias(id_col), "score")
