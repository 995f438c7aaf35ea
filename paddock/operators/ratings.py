"""Percentiles, scores and grades of runners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.names import canonical_name, plain_key
from ..functions.scoring import composite, rounded, runner_grade, win_rate
from .ranges import running


def share_of_all(rows: DataFrame, value: str, out: str, eligible: Column, higher_is_better: bool = True) -> DataFrame:
    """Adds ``out``: the share, in percent, of the eligible rows whose value is no better; 0 for rows not eligible.

    This is a cumulative distribution over all rows without a window over all rows: it depends on the counts of distinct
    values only, which are accumulated in cells of nearly equal values (positive ones) and joined back. ``rows`` is read
    twice and should be a stored table.
    """
    good = F.coalesce(eligible & (F.col(value) > 0), F.lit(False))
    counts = rows.filter(good).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__cell", F.floor(F.log2("__v") * 512))
    inside = Window.partitionBy("__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell: some thousands at most
    cells = counts.groupBy("__cell").agg(F.sum("__n").alias("__m"))
    offsets = cells.select("__cell", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(Window.partitionBy()).alias("__all"))
    upto = counts.withColumn("__in", F.sum("__n").over(inside)).join(F.broadcast(offsets), "__cell")
    reached = F.col("__before") + F.col("__in")
    share = reached if higher_is_better else F.col("__all") - reached + F.col("__n")
    shares = upto.select("__v", rounded(share * 100.0 / F.col("__all")).alias("__share"))
    joined = rows.join(shares, rows[value] == shares["__v"], "left")
    return joined.withColumn(out, F.when(good, F.coalesce("__share", F.lit(0.0))).otherwise(0.0)).drop("__v", "__share")


def share_of_year(rows: DataFrame, value: str, out: str, eligible: Column, year: str = "birth_year", higher_is_better: bool = True) -> DataFrame:
    """The same within a year of birth, the missing year being one: an option, not the default.

    Counts of the distinct (year, value) are accumulated over ranges, so a year with all rows is no task of its own.
    """
    good = F.coalesce(eligible & (F.col(value) > 0), F.lit(False))
    counts = rows.filter(good).groupBy(F.col(year).alias("__y"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col("__v").asc() if higher_is_better else F.col("__v").desc()
    upto = running(counts, ["__y"], [order], {"__upto": F.col("__n")})
    shares = upto.select("__y", "__v", rounded(F.col("__upto") * 100.0 / F.col("__upto_all")).alias("__share"))
    joined = rows.join(shares, rows[year].eqNullSafe(shares["__y"]) & (rows[value] == shares["__v"]), "left")
    return joined.withColumn(out, F.when(good, F.coalesce("__share", F.lit(0.0))).otherwise(0.0)).drop("__y", "__v", "__share")


def raced() -> Column:
    """Runners with a placed run: only they are compared and rated."""
    return F.coalesce(F.col("career_races") > 0, F.lit(False))


def rate(horses: DataFrame, mode: str = "performance") -> DataFrame:
    """Rating rows of horses with career columns and ``record_seconds``.

    Horses with a placed run make up the universe of the percentiles; those of them without a year of birth get no row of
    their own. The score weighs the unrounded win rate; only the stored one is rounded. Sires are stored under their
    canonical name. ``horses`` is read more than once and should be a stored table, as careers are.
    """
    base = horses.filter(raced()).withColumn("__rate", win_rate(F.col("career_wins"), F.col("career_races")))
    base = share_of_all(base, "career_earnings", "earn_percentile", F.lit(True))
    times = share_of_all(base, "record_seconds", "time_percentile", F.lit(True), higher_is_better=False)
    scored = times.withColumn("score", composite(F.col("earn_percentile"), F.col("time_percentile"), F.col("__rate")))
    scored = scored.withColumn("grade", runner_grade(F.col("score"))).withColumn("win_rate", rounded(F.col("__rate"))).withColumn("rating_mode", F.lit(mode))
    scored = scored.withColumn("sire", F.nullif(canonical_name(F.col("sire")), F.lit("")))
    return within_sire(scored.filter("birth_year is not null")).drop("__rate")


def within_sire(rated: DataFrame, sire: str = "sire", score: str = "score") -> DataFrame:
    """Adds ``sire_percentile``: the share of the sire's progeny that score no better, in percent; 0 without a sire.

    Sires are known by their plain key. Works on the counts of each (sire, score), so a sire with very many runners is a
    row a distinct score.
    """
    key = plain_key(F.col(sire))
    counts = rated.filter((key != "") & F.col(score).isNotNull()).groupBy(key.alias("__sire"), F.col(score).alias("__score")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("__sire").orderBy("__score").rowsBetween(Window.unboundedPreceding, 0)
    shares = counts.select("__sire", "__score", rounded(F.sum("__n").over(upto) * 100.0 / F.sum("__n").over(Window.partitionBy("__sire"))).alias("__share"))
    joined = rated.join(shares, (key == shares["__sire"]) & (rated[score] == shares["__score"]), "left")
    return joined.withColumn("sire_percentile", F.coalesce("__share", F.lit(0.0))).drop("__sire", "__score", "__share")
