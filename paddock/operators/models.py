"""Trained pairing models as JSON documents: written, read back, described, and brought into the form that ``ensemble`` scores.

A document holds both ensembles as nested trees, the medians, the figures of cross-validation, the importances and the
earnings by grade. It is of bounded size: so many trees of depth three.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scoring import RUNNER_GRADES, is_poor
from .breeding import FEATURES, ensemble, predictions

DEPTH = 3


def _node(depth: int) -> str:
    inner = f", f:int, th:double, l:{_node(depth - 1)}, r:{_node(depth - 1)}" if depth else ""
    return f"struct<leaf:double{inner}>"


_ENSEMBLE = f"struct<kind:string, init:double, learning_rate:double, trees:array<{_node(DEPTH)}>>"
DOCUMENT = (
    "trained_at string, n_samples long, features array<string>, medians map<string,double>, cv_r2_score double, cv_auc_poor double, feature_importances map<string,double>, "
    f"score_model {_ENSEMBLE}, poor_model {_ENSEMBLE}, grade_earnings map<string,struct<avg_earnings:double,n:long>>"
)


def parse_model(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents as typed columns; trees shallower than ``DEPTH`` have leaves higher up."""
    return documents.select(F.from_json(column, DOCUMENT).alias("m")).select("m.*")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The model document at ``path``, one row."""
    return parse_model(spark.read.text(path, wholetext=True))


def model_info(model: DataFrame) -> DataFrame:
    """What is told of a model: whether there is one, when it was trained on how many rows, its figures and importances."""
    return model.select(F.col("score_model").isNotNull().alias("available"), "trained_at", "n_samples", "cv_r2_score", "cv_auc_poor", "feature_importances")


def heaps(trees: Column) -> Column:
    """Nested trees in the form that ``ensemble`` takes: heaps of features, thresholds and leaves. A leaf higher up stands
    at all places below it."""

    def at(tree: Column, path: str) -> Column:
        for side in path:
            tree = tree[side]
        return tree

    def paths(n: int) -> list[str]:
        return [format(i, f"0{n}b").replace("0", "l").replace("1", "r") for i in range(2**n)] if n else [""]

    inner = [p for n in range(DEPTH) for p in paths(n)]

    def heap(tree: Column) -> Column:
        leaf = lambda p: F.coalesce(*(at(tree, p[:n])["leaf"] for n in range(DEPTH, -1, -1)))
        return F.struct(
            F.array(*(F.coalesce(at(tree, p)["f"], F.lit(0)) for p in inner)).alias("f"),
            F.array(*(F.coalesce(at(tree, p)["th"], F.lit(float("inf"))) for p in inner)).alias("th"),
            F.array(*(leaf(p) for p in paths(DEPTH))).alias("lf"),
        )

    return F.transform(trees, heap)


def score_pairs(pairs: DataFrame, model: DataFrame, fees: DataFrame) -> DataFrame:
    """``predictions`` of pairs with features by the model's own trees, medians and earnings; the model is one row."""
    one = model.select(F.col("medians").alias("__m"), *(F.struct(F.col(f"{k}.init").alias("init"), F.col(f"{k}.learning_rate").alias("rate"), heaps(F.col(f"{k}.trees")).alias("trees")).alias(f"__{k}") for k in ("score_model", "poor_model")))
    joined = pairs.join(F.broadcast(one))
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in FEATURES)), lambda x: x.isNotNull())
    joined = joined.withColumn("missing_data", missing).withColumns({f: F.coalesce(f, F.try_element_at("__m", F.lit(f)), F.lit(0.0)) for f in FEATURES})
    x = F.array(*FEATURES)
    sums = {k: ensemble(x, F.col(f"__{k}.trees"), F.col(f"__{k}.init"), F.col(f"__{k}.rate")) for k in ("score_model", "poor_model")}
    earnings = model.select(F.explode("grade_earnings").alias("grade", "e")).select("grade", "e.avg_earnings")
    return predictions(joined, sums["score_model"], sums["poor_model"], earnings, fees).drop("__m", "__score_model", "__poor_model")


def class_balance(rows: DataFrame) -> DataFrame:
    """One row: rows, how many of them have a poor grade, and their share in percent."""
    poor = is_poor(F.col("grade"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(poor), F.lit(0)).alias("n_poor"), F.round(F.avg(poor) * 100, 1).alias("poor_share"))


def importance_sides(model: DataFrame) -> DataFrame:
    """One row: the shares, in percent, of the importance of the sire's side and the dam's."""
    each = model.select(F.explode("feature_importances").alias("feature", "importance"))
    sire = F.startswith("feature", F.lit("s_")) | (F.col("feature") == "ss_time")
    total = F.sum("importance")
    return each.agg(F.round(F.sum(F.when(sire, F.col("importance")).otherwise(0.0)) / total * 100, 2).alias("sire_share"), F.round(F.sum(F.when(sire, 0.0).otherwise(F.col("importance"))) / total * 100, 2).alias("dam_share"))


def _tree(tree, node: int = 1) -> dict:
    """A trained tree as nested plain values; a node that is not split is a leaf."""
    inner = len(tree.f)
    if node > inner:
        return {"leaf": tree.lf[node - inner - 1]}
    if tree.th[node - 1] == float("inf"):
        return _tree(tree, 2 * node)
    return {"f": tree.f[node - 1], "th": tree.th[node - 1], "l": _tree(tree, 2 * node), "r": _tree(tree, 2 * node + 1)}


def _exported(model) -> dict:
    """An ensemble as ``init + rate * sum of leaves``; the classifier's sum is in log-odds."""
    return {"kind": model.kind, "init": model.init, "learning_rate": model.rate, "trees": [_tree(tree) for tree in model.trees]}


def document(regressor, classifier, figures: dict, medians: dict, earnings: DataFrame, trained_at: str) -> str:
    """The JSON document of trained models: what ``breeding.train`` gives, the medians, and the nine grades' earnings."""
    by_grade = {r["grade"]: {"avg_earnings": round(r["avg_earnings"] or 0.0, 2), "n": r["n"]} for r in earnings.collect()}  # a row a grade
    importances = dict(zip(FEATURES, (round(float(v), 4) for v in regressor.featureImportances.toArray()), strict=True))
    body = {
        "trained_at": trained_at, "n_samples": figures["n_samples"], "features": list(FEATURES), "medians": medians, "cv_r2_score": figures["cv_r2_score"], "cv_auc_poor": figures["cv_auc_poor"],
        "feature_importances": importances, "score_model": _exported(regressor), "poor_model": _exported(classifier), "grade_earnings": by_grade,
        "grade_thresholds": [*map(list, RUNNER_GRADES), [0, "F"]],
    }
    return json.dumps(body)


def write_model(spark: SparkSession, text: str, path: str) -> None:
    """The document as one file in the folder ``path``, of which ``read_model`` reads it."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
