"""Operator 7: exact top-k search by inner product with a kd-tree a shard.

Each shard is split at medians into tight boxes. The bound of a box is the largest inner product that a point in it can
have with the query; boxes are opened best first until no bound reaches the k-th score, which is carried on from shard
to shard. Components are whole numbers and so are scores: sums that doubles hold exactly are made in doubles, larger ones
in 64-bit numbers, and beyond those in Python's.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .vectors import Best, Shard, best_first, search

SCALE = 1024


def _whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) as doubles: exact, but for infinity where 1024 x leaves their range."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * SCALE)


def _numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) as Python's whole numbers."""
    flat = [math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in vectors.ravel().tolist()]
    return np.array(flat, object).reshape(vectors.shape)


def _points(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(vectors), bool), np.nan_to_num(_whole(vectors))


def _probe(shard: Shard, q_ids: np.ndarray, queries: np.ndarray, bests: list[Best]) -> None:
    whole = np.nan_to_num(_whole(queries))
    with np.errstate(over="ignore"):
        largest = float(np.abs(shard.points).max()) * float(np.abs(whole).max()) * whole.shape[1]
    least = [shard.ids[a:b].min() for a, b in shard.span]  # a box whose bound ties with the k-th score matters only if it holds a smaller id
    if largest < 2**52:
        kind, points, asked = np.int64, shard.points, whole
        bounds = np.maximum(whole, 0) @ shard.hi.T + np.minimum(whole, 0) @ shard.lo.T
    elif largest < 2**62:
        kind, points, asked = np.int64, shard.points.astype(np.int64), whole.astype(np.int64)
        bounds = (np.maximum(whole, 0) @ shard.hi.T + np.minimum(whole, 0) @ shard.lo.T) + largest * 1e-9
    else:  # no box is ruled out
        kind, points, asked = object, _numbers(shard.vectors), _numbers(queries)
        bounds = np.full((len(whole), len(shard.span)), np.inf)
    for row, (q, own, best) in enumerate(zip(asked, q_ids.tolist(), bests, strict=True)):

        def visit(a: int, b: int, q=q, own=own, best=best) -> None:
            other = shard.ids[a:b] != own
            best.add((points[a:b] @ q)[other].astype(kind), shard.ids[a:b][other])

        best_first(shard, bounds[row], visit, lambda bound, node, best=best: bound < best.kth() or (bound == best.kth() and least[node] > best.ids[-1]), lambda bound, best=best: bound < best.kth())


def top_k(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id_col>, score (long)``: the k highest inner products of each query, ties to the smaller id.

    ``is_query`` makes a condition of the id column; the queries are rows too, and candidates are all rows but the
    query's own. Components are floor(1024 x), however large; scores beyond a long are held at its ends. Vectors that are
    null, empty or hold null or non-finite components take no part, nor do rows without an id; vectors of other
    dimensions than the query's are no candidates; copies of a vector tie; repeated candidate rows are ranked each; fewer
    than k candidates give all; an empty table gives an empty result; other columns are ignored.
    """
    return search(rows, is_query, k, _points, _probe, "long", id_col, vec_col)
