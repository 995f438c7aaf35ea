"""Queries of the pairing model's life: documents, scoring, figures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as fs
from ..operators import breeding, models
from . import adapter as a
from .catalogue import BASE, FEATURE_SQL, _nested, sql, toy_trees
from .registry import query


def _scaled(tree):
    f, th, lf = tree
    return f, [50 + 100 * t for t in th], [20 * v for v in lf]


def _as_document(tree, node: int = 1) -> dict:
    f, th, lf = tree
    if node >= 8:
        return {"leaf": lf[node - 8]}
    return {"f": f[node - 1], "th": th[node - 1], "l": _as_document(tree, 2 * node), "r": _as_document(tree, 2 * node + 1)}


#: Importances by a rule, in the order of the features.
IMPORTANCES = {f: round((i % 5 + 1) / 40, 4) for i, f in enumerate(breeding.FEATURES)}
MIDDLE, INFO = 41.5, {"trained_at": "2001-08-01T00:00:00Z", "n_samples": 4321, "cv_r2_score": 0.31, "cv_auc_poor": 0.72}


def toy_document(spark: SparkSession) -> DataFrame:
    """A model document of small trees, of which one is a leaf alone."""
    trees = [*(_as_document(_scaled(t)) for t in toy_trees()), {"leaf": 2.5}]
    model = lambda kind, init: {"kind": kind, "init": init, "learning_rate": 0.08, "trees": trees}
    earnings = {g: {"avg_earnings": 1000.0 * w, "n": w} for g, w in fs.GRADE_WEIGHTS.items()}
    body = INFO | {"features": list(breeding.FEATURES), "medians": dict.fromkeys(breeding.FEATURES, MIDDLE), "feature_importances": IMPORTANCES, "score_model": model("regressor", 50.0), "poor_model": model("classifier", -1.0), "grade_earnings": earnings}
    return spark.createDataFrame([(json.dumps(body),)], "value string")


SUM_SQL = "(" + " + ".join(f"({_nested(_scaled(t))})" for t in toy_trees()) + " + 2.5)"
PAIR_SQL = f"""pairs AS (SELECT name AS stallion, stud_fee_eur AS fee, 'Customer#' || lpad((substr(name, 10)::INT + 1)::VARCHAR, 9, '0') AS mare FROM studs),
feats AS (SELECT p.*, {FEATURE_SQL}, ds.time_percentile::DOUBLE AS ds_time, ss.time_percentile::DOUBLE AS ss_time FROM pairs p JOIN ratings s ON s.name = p.stallion JOIN ratings m ON m.name = p.mare
LEFT JOIN family hm ON hm.name = p.mare LEFT JOIN ratings ds ON ds.name = hm.sire LEFT JOIN family hs ON hs.name = p.stallion LEFT JOIN ratings ss ON ss.name = hs.sire),
x AS (SELECT stallion, mare, fee, ({" + ".join(f"({f} IS NULL)::INT" for f in breeding.FEATURES)})::INT AS n_missing, [{", ".join(f"coalesce({f}, {MIDDLE})" for f in breeding.FEATURES)}] AS x FROM feats),
sums AS (SELECT stallion, mare, fee, n_missing, greatest(0, least(100, 50 + 0.08::DOUBLE * {SUM_SQL})) AS score, 1 / (1 + exp(-(-1 + 0.08::DOUBLE * {SUM_SQL}))) AS poor FROM x),
graded AS (SELECT *, CASE {" ".join(f"WHEN score >= {s} THEN '{g}'" for s, g in fs.RUNNER_GRADES)} ELSE 'F' END AS grade FROM sums),
earned AS (SELECT *, 1000.0::DOUBLE * CASE grade {" ".join(f"WHEN '{g}' THEN {w}" for g, w in fs.GRADE_WEIGHTS.items())} END AS earnings FROM graded)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    mare = F.concat(F.lit("Customer#"), F.lpad((F.substring("name", 10, 9).cast("int") + 1).cast("string"), 9, "0"))
    return breeding.pair_features(a.studs(spark, sf).select(F.col("name").alias("stallion"), mare.alias("mare")), a.ratings(spark, sf), a.family(spark, sf), "stallion", "mare")


@query(f"""WITH {BASE}, {PAIR_SQL} SELECT stallion, mare, floor(score * 10 + 0.5) / 10 AS predicted_score, grade AS predicted_grade, floor(poor * 1000 + 0.5) / 1000 AS poor_foal_probability, earnings AS expected_earnings, fee AS stud_fee,
CASE WHEN fee > 0 THEN floor((earnings - fee) / fee * 100 + 0.5) / 100 END AS roi_estimate, n_missing FROM earned""")
def predict_pairs(spark, sf):
    """All studs with the mares of the next key: features, imputation, scoring by a model document, grade, earnings and return."""
    scored = models.score_pairs(_pairs(spark, sf), models.parse_model(toy_document(spark)), a.studs(spark, sf))
    return scored.select("stallion", "mare", "predicted_score", "predicted_grade", "poor_foal_probability", "expected_earnings", "stud_fee", "roi_estimate", F.size("missing_data").alias("n_missing"))


TRAINING = f"(SELECT f.* FROM ratings f JOIN family h ON h.name = f.name JOIN ratings s ON s.name = h.sire JOIN ratings m ON upper(m.name) = upper(trim(h.dam)))"


@query(sql(f"SELECT true AS available, '{a.AS_OF}T00:00:00Z' AS trained_at, (SELECT count(*) FROM {TRAINING}) AS n_samples, true AS has_r2, true AS has_auc, {len(breeding.FEATURES)} AS n_features"))
def model_info(spark, sf):
    """What is told of the model trained on the given tables; that there is none, if they have too few rows."""
    info = models.model_info(a.model(spark, sf))
    told = info.select("available", "trained_at", "n_samples", F.col("cv_r2_score").isNotNull().alias("has_r2"), F.col("cv_auc_poor").between(0, 1).alias("has_auc"), F.size("feature_importances").alias("n_features"))
    return told.agg(F.coalesce(F.max("available"), F.lit(False)).alias("available"), *(F.max(c).alias(c) for c in told.columns[1:]))


@query()
def importance_sides(spark, sf):
    """Of the trained model, how much the sire's side tells and how much the dam's."""
    return models.importance_sides(a.model(spark, sf))


@query()
def predict_trained(spark, sf):
    """All studs with the mares of the next key, scored by the model trained on the given tables, read back from its document."""
    return models.score_pairs(_pairs(spark, sf), a.model(spark, sf), a.studs(spark, sf)).select("stallion", "mare", "predicted_score", "predicted_grade", "poor_foal_probability", "expected_earnings", "stud_fee", "roi_estimate", F.size("missing_data").alias("n_missing"))


@query(sql(f"SELECT grade, round(avg(career_earnings), 2) AS avg_earnings, count(*) AS n FROM ratings GROUP BY grade"))
def model_earnings(spark, sf):
    """Earnings by grade as the trained document has them."""
    return a.model(spark, sf).select(F.explode("grade_earnings").alias("grade", "e")).select("grade", F.round("e.avg_earnings", 2).alias("avg_earnings"), "e.n")


@query(sql("""SELECT count(*) AS n, count(*) FILTER (f.grade IN ('D', 'E', 'F')) AS n_poor, round(avg((f.grade IN ('D', 'E', 'F'))::INT) * 100, 1) AS poor_share
FROM ratings f JOIN family h ON h.name = f.name JOIN ratings s ON s.name = h.sire JOIN ratings m ON upper(m.name) = upper(trim(h.dam))"""))
def class_balance(spark, sf):
    return models.class_balance(breeding.training_rows(a.ratings(spark, sf), a.family(spark, sf)))
