"""Operator 10: approximate nearest neighbours by stable projections.

Unit vectors are projected on a few Gaussian directions; the ratio of the squared projected to the squared true distance
is then chi-square with as many degrees of freedom. A kd-tree over the projections of a shard gives neighbours by rising
projected distance; each is verified on the original vectors, until a point as near as the k-th found so far would by now
have appeared with the wished probability. Only neighbours are missed that way, never made up: scores are exact.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .vectors import Best, Shard, best_first, search


@lru_cache
def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


@lru_cache
def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows whose squares leave the range of doubles, brought to a largest component of 1."""
    with np.errstate(over="ignore", under="ignore"):
        norms = _norms(vectors)
    odd = ~((norms > 1e-140) & (norms < 1e140))
    if odd.any():
        vectors = vectors.copy()
        vectors[odd] /= np.abs(vectors[odd]).max(1, keepdims=True)
    return vectors


def nearest(rows: DataFrame, is_query, k: int = 5, m: int = 8, p: float = 0.97, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id_col>, score (double)``: the k nearest rows found of each query by cosine, ties to the smaller id.

    Every row is indexed and can be found; each true neighbour is found with a probability of at least ``p``. ``m``
    directions (an even number) hold for all shards, from ``seed``, so reruns agree. Vectors that are null, empty, zero
    or hold null or non-finite components take no part, nor do rows without an id; vectors of other dimensions than the
    query's are no candidates; copies tie; repeated candidate rows are ranked each; fewer than k candidates give all; an
    empty table gives an empty result; other columns are ignored.
    """
    enough = chi_square_quantile(p, m)

    def points_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.any(vectors != 0, axis=1)
        kept = _scaled(vectors[some])
        return some, (kept / _norms(kept)[:, None]) @ directions(vectors.shape[1], m, seed)

    def probe(shard: Shard, q_ids: np.ndarray, queries: np.ndarray, bests: list[Best]) -> None:
        vectors, queries = _scaled(shard.vectors), _scaled(queries)
        lengths, norms = _norms(vectors), _norms(queries)
        for q, norm, own, best in zip(queries, norms, q_ids.tolist(), bests, strict=True):
            if norm == 0:
                continue
            at = (q / norm) @ directions(len(q), m, seed)
            gap = np.maximum(np.maximum(shard.lo - at, at - shard.hi), 0)
            bounds = -(gap * gap).sum(1)

            def visit(a: int, b: int, q=q, norm=norm, own=own, best=best) -> None:
                cosines = (vectors[a:b] * q).sum(1) / (lengths[a:b] * norm)  # one order of summation for all rows: copies tie
                other = shard.ids[a:b] != own
                best.add(cosines[other], shard.ids[a:b][other])

            def done(bound: float, best=best) -> bool:  # -bound: the squared projected distance reached
                return -bound > enough * max(2 - 2 * best.kth(), 0) + 1e-9

            best_first(shard, bounds, visit, lambda bound, node: False, done)

    return search(rows, is_query, k, points_of, probe, "double", id_col, vec_col)
