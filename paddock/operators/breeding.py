"""Features, training and scoring of the pairing model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import plain_key
from ..functions.scoring import clamp, half_up, roi, runner_grade, sigmoid
from .pedigree import parents_of

#: The order of the features.
FEATURES = ("s_time", "s_earn", "s_win", "s_score", "s_races", "m_time", "m_earn", "m_win", "m_score", "m_races", "ds_time", "ss_time")
_SIDE = {"time": "time_percentile", "earn": "earn_percentile", "win": "win_rate", "score": "score", "races": "career_races"}


def _sides(ratings: DataFrame, horses: DataFrame, unrated: bool = False) -> DataFrame:
    """``__key``, the five features of each rated horse and ``up_time``, the time of its own sire; with ``unrated``, also who has only the latter."""
    rated = ratings.select(plain_key(F.col("name")).alias("__key"), *(F.col(c).cast("double").alias(n) for n, c in _SIDE.items()))
    times = rated.select(F.col("__key").alias("__up"), F.col("time").alias("up_time"))
    known = parents_of(horses).select("__key", plain_key(F.col("sire")).alias("__up"))
    up = _merged(known, times, "__up").select("__key", "up_time")  # only those with a rated sire: others get no row, so they don't meet in one task
    return _merged(rated, up, "__key", "full" if unrated else "left")


def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow alike. Narrow columns in Parquet look small enough to broadcast, but then each task holds the other table whole, and can't spill it."""
    return left.join(right.hint("merge"), on, how)


def pair_features(pairs: DataFrame, ratings: DataFrame, horses: DataFrame, sire: str = "sire", dam: str = "dam", how: str = "inner") -> DataFrame:
    """``pairs`` with the twelve features of their sire and dam, looked up by plain key. Ratings that share a name fan out, as in a join by name."""
    sides, out = _sides(ratings, horses, unrated=how != "inner"), pairs
    for parent, short, up in ((sire, "s", "ss_time"), (dam, "m", "ds_time")):
        side = sides.select("__key", *(F.col(n).alias(f"{short}_{n}") for n in _SIDE), F.col("up_time").alias(up))
        out = _merged(out.withColumn("__key", plain_key(F.col(parent))), side, "__key", how).drop("__key")
    return out.select(*pairs.columns, *FEATURES)


def training_rows(ratings: DataFrame, horses: DataFrame) -> DataFrame:
    """``name, grade, score`` and the features of every rated horse with rated parents."""
    foals = ratings.filter("score is not null and grade is not null").select("name", "grade", "score")
    known = horses.select("name", "sire", "dam")
    return pair_features(_merged(foals, known, "name"), ratings, horses).drop("sire", "dam")


def medians(rows: DataFrame, features=FEATURES) -> DataFrame:
    """One row: the exact median of each feature over its non-null values, 0 if there is none."""
    return rows.agg(*(F.coalesce(F.percentile(f, 0.5), F.lit(0.0)).alias(f) for f in features))


def imputed(rows: DataFrame, middle: DataFrame, features=FEATURES) -> DataFrame:
    """Nulls filled from the one row of medians; ``missing_data`` lists the features that were null."""
    m = middle.select(*(F.col(f).alias(f"__{f}") for f in features))
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in features)), lambda x: x.isNotNull())
    joined = rows.join(F.broadcast(m)).withColumn("missing_data", missing)
    return joined.withColumns({f: F.coalesce(f, f"__{f}") for f in features}).drop(*(f"__{f}" for f in features))


def ensemble(x: Column, trees: Column, init: Column, rate: Column, depth: int = 3) -> Column:
    """``init + rate * sum of leaves``. ``x`` is the feature array; a tree is a heap: struct(f array<int>, th array<double>,
    lf array<double>) with node 1 at place 0 and leaves numbered from the left. A value equal to a threshold goes left."""

    def leaf(t: Column) -> Column:
        at = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda node, _: node * 2 + F.when(F.get(x, F.get(t["f"], node - 1)) <= F.get(t["th"], node - 1), 0).otherwise(1))
        return F.get(t["lf"], at - F.lit(2**depth))

    return init + rate * F.aggregate(trees, F.lit(0.0), lambda a, t: a + leaf(t))


def predictions(pairs: DataFrame, score: Column, poor: Column, grade_earnings: DataFrame, fees: DataFrame) -> DataFrame:
    """Score, grade, poor-foal probability, expected earnings, fee and return of each pair, from two ensemble sums."""
    graded_ = pairs.withColumn("__score", clamp(score)).withColumn("predicted_grade", runner_grade(F.col("__score")))
    earned = grade_earnings.select(F.col("grade").alias("predicted_grade"), F.col("avg_earnings").alias("expected_earnings"))
    fee = fees.select(plain_key(F.col("name")).alias("__fee_key"), F.col("stud_fee_eur").alias("stud_fee"))
    joined = graded_.join(earned, "predicted_grade", "left").join(fee, plain_key(F.col("stallion")) == F.col("__fee_key"), "left")
    return joined.withColumns({"predicted_score": half_up(F.col("__score"), 1), "poor_foal_probability": half_up(sigmoid(poor), 3), "roi_estimate": roi(F.col("expected_earnings"), F.col("stud_fee"))}).drop("__score", "__fee_key")


def grade_earnings(ratings: DataFrame) -> DataFrame:
    return ratings.filter("grade is not null").groupBy("grade").agg(F.avg("career_earnings").alias("avg_earnings"), F.count(F.lit(1)).alias("n"))


def train(rows: DataFrame, features=FEATURES, rounds: int = 150, depth: int = 3, rate: float = 0.08, seed: int = 42, least: int = 100, folds: int = 5):
    """Boosted regression of the score and classification of poor grades, with cross-validated R2 and area under the curve.

    Returns (regressor, classifier, {"cv_r2_score", "cv_auc_poor", "n_samples"}), or None with fewer than ``least`` rows.
    Both models and their folds grow side by side, a job a level. A row's fold goes by its hash: equal rows are never on both
    sides, and a lost executor changes no fold. Figures are means over the folds that have one.
    """
    from ..functions.scoring import is_poor
    from .boosting import boost
    from .figures import area_under_curve, r2

    filled = imputed(rows, medians(rows, features), features).withColumn("poor", is_poor(F.col("grade")).cast("double"))
    fold = F.pmod(F.xxhash64(F.lit(seed), *features, "score"), F.lit(folds)).cast("int").alias("fold")
    data = filled.select(*features, "score", "poor", fold).persist()
    try:
        n = data.count()
        if n < least:
            return None
        made, told = boost(data, features, n, rounds, depth, rate, folds)
        mean = lambda df, c: df.agg(F.avg(c)).first()[0]
        figures = {"cv_r2_score": mean(r2(told, "score", "regressor", ["fold"]), "r2"), "cv_auc_poor": mean(area_under_curve(told, "poor", "classifier", ["fold"]), "auc"), "n_samples": n}
    finally:
        data.unpersist()
    return made["regressor"], made["classifier"], figures
