"""Gradient boosting over binned features, the models and their folds side by side: one Spark job a level of all their trees.

Rows lie in blocks with their features as bins of a byte, and with what each fit has predicted so far. A job sums, by fit, node, feature and bin, the
rows, residuals and curvatures; what it returns is bounded by the bins, not by the rows. Trees are chosen from the sums, as in the reference:
residuals of the squared error or of the log-likelihood, the split that lessens their variation most, leaves by the mean or by one Newton step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import sigmoid
from ..session import dropped, shared_dir, shared_path

#: Bins of a feature, cut at quantiles of all rows; rows of a partition; rounds between two checkpoints.
BINS, ROWS, EVERY = 64, 250_000, 10


@dataclass
class Fit:
    """What is fitted: the kind, and the fold that it does not see (or one that no row has)."""

    kind: str
    held: int


@dataclass
class Tree:
    """A heap: features, thresholds and leaves. A node that is not split sends all rows left."""

    f: list[int]
    bin: list[int]
    th: list[float]
    lf: list[float]


@dataclass
class Ensemble:
    kind: str
    init: float
    rate: float
    trees: list[Tree]
    featureImportances: DenseVector

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prediction for the vector ``x``; a classifier also gives both probabilities."""
        from .breeding import ensemble

        trees = F.array(*(F.struct(F.array(*map(F.lit, t.f)).alias("f"), F.array(*map(F.lit, t.th)).alias("th"), F.array(*map(F.lit, t.lf)).alias("lf")) for t in self.trees))
        summed = ensemble(vector_to_array("x"), trees, F.lit(self.init), F.lit(self.rate))
        if self.kind == "regressor":
            return rows.withColumn("prediction", summed)
        chance = sigmoid(summed)
        return rows.withColumn("probability", F.array(1 - chance, chance)).withColumn("prediction", (chance > 0.5).cast("double"))


def _packed(batches, cuts: list[list[float]]):
    """Rows of (features, score, poor, fold) as blocks of bytes."""
    import pyarrow as pa

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        bins = np.stack([np.searchsorted(cut, c).astype(np.uint8) for cut, c in zip(cuts, columns, strict=False)])
        values = (bins, columns[-3].astype(np.float64), columns[-2].astype(np.float64), columns[-1].astype(np.int8))
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["bins", "score", "poor", "fold"])


def _block(row, width: int, init: list[float]) -> tuple:
    score = np.frombuffer(row.score)
    told = np.repeat(np.array(init)[:, None], len(score), axis=1)
    return np.frombuffer(row.bins, np.uint8).reshape(width, -1), score, np.frombuffer(row.poor), np.frombuffer(row.fold, np.int8), told


def _nodes(bins: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """The place in its level that each row comes to."""
    at, each = np.zeros(bins.shape[1], np.intp), np.arange(bins.shape[1])
    f, cut = np.array(tree.f), np.array(tree.bin)
    for level in range(levels):
        heap = at + (2**level - 1)
        at = 2 * at + (bins[f[heap], each] > cut[heap])
    return at


def _grown(block: tuple, trees: list[Tree], depth: int, rate: float) -> tuple:
    """The block after a round: what the fits predict with their newest trees."""
    bins, score, poor, fold, told = block
    return bins, score, poor, fold, told + np.stack([rate * np.array(t.lf)[_nodes(bins, t, depth)] for t in trees])


def _sums(blocks, fits: list[Fit], trees: list[Tree], level: int, last: bool):
    """Of a partition: (fit, node, feature, bin) to rows, residuals and, on the last level, curvatures of the rows that the fit sees."""
    total = None
    for bins, score, poor, fold, told in blocks:
        places = 2**level
        if total is None:
            total = np.zeros((len(fits), places, len(bins), BINS, 3))
        wide = [b.astype(np.intp) for b in bins]
        for k, fit in enumerate(fits):
            seen = fold != fit.held
            if fit.kind == "regressor":
                residual, curve = score - told[k], None
            else:
                chance = 1 / (1 + np.exp(-told[k]))
                residual, curve = poor - chance, chance * (1 - chance) if last else None
            start = np.where(seen, _nodes(bins, trees[k], level), places) * BINS  # rows not seen lie beyond all nodes
            for f, b in enumerate(wide):
                cell = start + b
                for s, w in enumerate((None, residual, curve)):
                    if s < 2 or w is not None:
                        total[k, :, f, :, s] += np.bincount(cell, w, (places + 1) * BINS)[: places * BINS].reshape(places, BINS)
    if total is not None:
        yield total


def _start(blocks, fits: list[Fit]):
    """Of a partition: by fit the rows that it sees, and their sums of scores and of poor grades."""
    total = np.zeros((len(fits), 3))
    for _, score, poor, fold, _ in blocks:
        for k, fit in enumerate(fits):
            seen = fold != fit.held
            total[k] += seen.sum(), score[seen].sum(), poor[seen].sum()
    yield total


def _split(tree: Tree, kind: str, sums: np.ndarray, level: int, last: bool, cuts: list[list[float]], gains: np.ndarray) -> None:
    """Splits the nodes of a level where that lessens the variation of the residuals, and adds to the gain of each feature; on the last level sets the leaves."""
    left, whole = sums.cumsum(axis=2), sums.sum(axis=2, keepdims=True)  # (node, feature, bin, 3)
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[..., 1] ** 2 / whole[..., 0]
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, -np.inf)

    def leaf(s: np.ndarray) -> float:
        below = s[0] if kind == "regressor" else s[2]
        return float(s[1] / below) if below > 1e-12 else 0.0

    for node in range(len(sums)):
        heap = 2**level - 1 + node
        f, b = np.unravel_index(np.argmax(gain[node]), gain[node].shape)
        if gain[node, f, b] > 1e-9 and b < len(cuts[f]):
            tree.f[heap], tree.bin[heap], tree.th[heap] = int(f), int(b), float(cuts[f][b])
            gains[f] += gain[node, f, b]
        if last:
            done = tree.th[heap] != float("inf")
            tree.lf[2 * node] = leaf(left[node, f, b] if done else whole[node, 0, 0])
            tree.lf[2 * node + 1] = leaf(right[node, f, b] if done else whole[node, 0, 0])


def _told(blocks, kinds: list[str], folds: int):
    """Rows of (fold, score, poor, and what the fits that did not see the fold say)."""
    import pandas as pd

    for _, score, poor, fold, told in blocks:
        place, each = fold.astype(np.intp), np.arange(len(fold))
        said = [told[m * (folds + 1) + place, each] for m in range(len(kinds))]
        yield from pd.DataFrame({"fold": place, "score": score, "poor": poor.astype(np.intp), **dict(zip(kinds, said, strict=True))}).itertuples(index=False, name=None)


def boost(data: DataFrame, features, rows: int, rounds: int, depth: int, rate: float, folds: int) -> tuple[dict[str, Ensemble], DataFrame]:
    """A regressor of ``score`` and a classifier of ``poor``, fitted to all of ``data`` (features, score, poor, fold); and ``fold, score, poor, regressor,
    classifier``, what fits that did not see a row's fold say of it."""
    spark = data.sparkSession
    sc, kinds = spark.sparkContext, ["regressor", "classifier"]
    shared_dir(spark)
    fits = [Fit(kind, held) for kind in kinds for held in range(folds + 1)]  # the last of each kind sees all
    quantiles = data.agg(*(F.percentile_approx(f, F.array(*(F.lit(i / BINS) for i in range(1, BINS))), F.lit(10_000)).alias(f) for f in features)).first()
    cuts = [sorted(set(quantiles[f])) for f in features]
    parts = max(min(sc.defaultParallelism, 1 + rows // 5_000), 1 + rows // ROWS)
    packed = data.select(*(F.col(f).cast("double") for f in features), "score", "poor", "fold").repartition(parts)
    packed = packed.mapInArrow(partial(_packed, cuts=cuts), "bins binary, score binary, poor binary, fold binary").rdd
    summed = lambda rdd, f: rdd.mapPartitions(f).treeReduce(np.add, 1 if parts <= 48 else 2)

    def kept(rdd):
        return rdd.persist(StorageLevel.MEMORY_AND_DISK)

    base = kept(packed.map(partial(_block, width=len(features), init=[0.0] * len(fits))))
    counts = summed(base, partial(_start, fits=fits))
    init = []
    for fit, (n, score, poor) in zip(fits, counts, strict=True):
        share = min(max(poor / max(n, 1), 1e-9), 1 - 1e-9)
        init.append(float(score / max(n, 1)) if fit.kind == "regressor" else float(np.log(share / (1 - share))))
    start = np.array(init)[:, None]
    state = kept(base.map(lambda b: (*b[:4], b[4] + start)))
    old, grown, gains = [base], [[] for _ in fits], np.zeros((len(fits), len(features)))
    marked: list = []
    for r in range(rounds):
        if r % EVERY == EVERY - 1:
            state.checkpoint()
            marked.append(state)
        trees = [Tree([0] * (2**depth - 1), [BINS] * (2**depth - 1), [float("inf")] * (2**depth - 1), [0.0] * 2**depth) for _ in fits]
        for level in range(depth):
            sums = summed(state, partial(_sums, fits=fits, trees=trees, level=level, last=level == depth - 1))
            for k, fit in enumerate(fits):
                _split(trees[k], fit.kind, sums[k], level, level == depth - 1, cuts, gains[k])
        while old:
            old.pop().unpersist()
        while len(marked) > 1:
            dropped(spark, marked.pop(0).getCheckpointFile())
        for k, tree in enumerate(trees):
            grown[k].append(tree)
        old.append(state)
        state = kept(state.map(partial(_grown, trees=trees, depth=depth, rate=rate)))
    schema = "fold int, score double, poor int, regressor double, classifier double"
    path = shared_path(spark, "boosted")
    spark.createDataFrame(state.mapPartitions(partial(_told, kinds=kinds, folds=folds)), schema, verifySchema=False).write.parquet(path)
    for rdd in (*old, state):
        rdd.unpersist()
    for rdd in marked:
        dropped(spark, rdd.getCheckpointFile())
    made = {}
    for m, kind in enumerate(kinds):
        k = m * (folds + 1) + folds
        made[kind] = Ensemble(kind, init[k], rate, grown[k], Vectors.dense(gains[k] / (gains[k].sum() or 1.0)))
    return made, spark.read.schema(schema).parquet(path)
