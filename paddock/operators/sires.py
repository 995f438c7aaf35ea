"""Ratings of sires, their thresholds and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.names import plain_key
from ..functions.scoring import GRADE_WEIGHTS, SIRE_PERCENTILES, STATIC_SIRE_GRADES, grade_weight, graded, rounded, volume_multiplier
from .ranges import running


def ranking_rollup(rows: DataFrame) -> DataFrame:
    """``name, vp_id, vp_total_offspring, vp_total_earnings_eur, vp_avg_earnings_eur`` of ranking rows by age: sums, the mean of
    ``media``, and the id of the row with most offspring, the first in ``ord`` on a tie."""
    return rows.groupBy("name").agg(
        F.max_by("vp_id", F.struct(F.col("prodotti"), -F.col("ord"))).alias("vp_id"),
        F.sum("prodotti").alias("vp_total_offspring"),
        F.sum("somme_vinte").alias("vp_total_earnings_eur"),
        rounded(F.avg("media")).alias("vp_avg_earnings_eur"),
    )


def ordinal_rank(rolled: DataFrame) -> DataFrame:
    """Rank by earnings, each rank once; equal earnings by name. Ranks run on over ranges of rows, so no task sorts all."""
    ranked = running(rolled, [], [F.desc("vp_total_earnings_eur"), F.asc("name")], {"__upto": F.lit(1)})
    return ranked.withColumn("vp_rank", F.col("__upto").cast("int")).drop("__upto", "__upto_all")


def competition_rank(rolled: DataFrame) -> DataFrame:
    """Rank by earnings, equal earnings sharing the best: one more than the rows of higher earnings, which are counted by their distinct values."""
    counts = rolled.groupBy(F.col("vp_total_earnings_eur").alias("__e")).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, [], [F.desc("__e")], {"__upto": F.col("__n")})
    ranks = upto.select("__e", (F.col("__upto") - F.col("__n") + 1).cast("int").alias("vp_rank"))
    return rolled.join(ranks, rolled["vp_total_earnings_eur"].eqNullSafe(ranks["__e"])).drop("__e")


def running_progeny(horses: DataFrame, races: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """``sire, n_in_corsa``: distinct names of progeny with a race since ``days`` before ``as_of``; sires by plain key."""
    recent = races.filter(F.col("race_date") >= F.date_sub(as_of, days)).select(F.col("horse_name").alias("name")).distinct()
    own = horses.join(recent, "name", "left_semi").select(plain_key(F.col("sire")).alias("sire"), "name")
    return own.filter("sire <> ''").groupBy("sire").agg(F.countDistinct("name").alias("n_in_corsa"))


def sire_stats(rated: DataFrame, rankings: DataFrame, running: DataFrame, mode: str = "dynamic", with_grade: bool = True) -> DataFrame:
    """One row a sire of rated progeny; sires meet their rankings by plain key, the upper case without blanks at the ends.

    The mean of grade weights and the share of top grades divide by the progeny rated; the volume multiplier goes by the
    larger of those and the ranking's offspring, or in the static mode by those alone. ``avg_score`` is the mean times the
    multiplier. The boost is up to five points for earnings relative to the best ranked sire.
    """
    count = lambda g: F.count_if(F.col("grade") == g)
    keyed = rated.withColumn("sire", plain_key(F.col("sire"))).filter("sire <> ''")
    grouped = keyed.groupBy("sire").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(grade_weight(F.col("grade"))).alias("__weight"),
        *(count(g).alias(f"n_{g}") for g in GRADE_WEIGHTS),
        rounded(F.coalesce(F.avg("career_earnings"), F.lit(0.0))).alias("avg_earnings"),
    )
    top = rankings.agg(F.coalesce(F.nullif(F.max("vp_total_earnings_eur"), F.lit(0)), F.lit(1)).alias("__top"))  # one row
    first = F.max(F.struct(F.col("vp_total_earnings_eur").alias("e"), F.col("vp_total_offspring").alias("o")))  # spellings of one name are one sire
    ranked = rankings.groupBy(plain_key(F.col("name")).alias("__name")).agg(first.alias("__r")).select("__name", F.col("__r.o").alias("__offspring"), F.col("__r.e").alias("__earned"))
    joined = grouped.join(ranked, grouped["sire"] == ranked["__name"], "left").join(F.broadcast(top)).join(running, "sire", "left")
    total = F.greatest(F.coalesce("__offspring", F.lit(0)), F.col("__n"))
    score = rounded(F.col("__weight") / F.col("__n") * volume_multiplier(total if mode == "dynamic" else F.col("__n")))
    boost = rounded(F.coalesce(F.col("__earned") / F.col("__top") * 5.0, F.lit(0.0)))
    stats = joined.withColumns({"n_figli_totali": total, "avg_score": score, "vp_boost": boost}).withColumn("final_score", rounded(F.least(F.col("avg_score") + F.col("vp_boost"), F.lit(100.0))))
    out = stats.select(
        "sire",
        F.col("n_figli_totali").cast("long").alias("n_figli_totali"),
        F.coalesce("n_in_corsa", F.lit(0)).alias("n_in_corsa"),
        "avg_score",
        *(f"n_{g}" for g in GRADE_WEIGHTS),
        rounded((F.col("n_SSS") + F.col("n_SS") + F.col("n_S")) * 100.0 / F.col("__n")).alias("pct_top_S"),
        "avg_earnings",
        "vp_boost",
        "final_score",
    )
    if not with_grade:
        return out
    if mode == "static":
        return out.withColumn("grade", F.when(F.col("final_score") > 0, graded(F.col("final_score"), STATIC_SIRE_GRADES)).otherwise("N/A"))
    return grade_sires(out)


def nearest_rank_thresholds(rows: DataFrame, score: str) -> DataFrame:
    """One row with a column a grade: the score at place ``min(floor(p/100 n), n-1)`` from 0 in rising order; F begins at 0.

    Nothing is interpolated. Places are found on the counts of distinct scores, so the rows themselves are not sorted.
    """
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select("s", F.sum("n").over(Window.orderBy("s")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = lambda p: F.least(F.floor(F.lit(p / 100) * F.col("total")), F.col("total") - 1)
    return upto.agg(*(F.min(F.when(F.col("upto") > place(p), F.col("s"))).alias(g) for p, g in SIRE_PERCENTILES))


def grade_sires(stats: DataFrame) -> DataFrame:
    """Adds ``grade`` by thresholds taken from the final scores; N/A for scores of 0 and less."""
    limits = nearest_rank_thresholds(stats, "final_score").select(*(F.col(g).alias(f"__{g}") for _, g in SIRE_PERCENTILES))
    joined = stats.join(F.broadcast(limits))  # one row
    grade = graded(F.col("final_score"), [(F.col(f"__{g}"), g) for _, g in SIRE_PERCENTILES])
    return joined.withColumn("grade", F.when(F.col("final_score") > 0, grade).otherwise("N/A")).drop(*(f"__{g}" for _, g in SIRE_PERCENTILES))
