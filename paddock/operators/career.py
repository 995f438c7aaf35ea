"""Career aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import canonical_name
from ..functions.parsing import km_seconds


def _sums() -> list[Column]:
    placed = F.col("placement").isNotNull()
    return [
        F.count_if(placed).alias("career_races"),
        F.count_if(F.col("placement") == 1).alias("career_wins"),
        F.sum(F.when(placed, F.coalesce("prize_net", F.lit(0.0))).otherwise(0.0)).alias("career_earnings"),
    ]


def career_stats(races: DataFrame, key: str = "horse_name") -> DataFrame:
    """Races, wins and earnings over placed runs only: a run without a placing counts neither as a race nor by its prize."""
    return races.groupBy(key).agg(*_sums())


def _fastest(order: str) -> Column:
    """Of the runs with a time the fastest, the first in ``order`` on a tie: struct(seconds, order, text)."""
    seconds = km_seconds(F.col("time_km"))
    return F.min(F.when(seconds.isNotNull(), F.struct(seconds.alias("s"), F.col(order).alias("o"), F.col("time_km").alias("t"))))


def best_time(races: DataFrame, key: str = "horse_name", order: str = "id") -> DataFrame:
    """The text of the fastest time over all runs, the first in ``order`` on a tie, and its seconds."""
    best = races.groupBy(key).agg(_fastest(order).alias("b")).filter("b is not null")
    return best.select(key, F.col("b.t").alias("record_career"), F.col("b.s").alias("record_seconds"))


def careers(horses: DataFrame, races: DataFrame, order: str = "id") -> DataFrame:
    """Horses with their career columns; without placed runs those are 0, without times the record is null.

    Runs are aggregated once, before the join; horses and runs meet by canonical name.
    """
    run = races.groupBy(canonical_name(F.col("horse_name")).alias("__name")).agg(*_sums(), _fastest(order).alias("__b"))
    known = horses.drop("career_races", "career_wins", "career_earnings", "record_career", "record_seconds")
    joined = known.join(run, canonical_name(known["name"]) == run["__name"], "left")
    joined = joined.withColumns({"record_career": F.col("__b.t"), "record_seconds": F.col("__b.s")}).drop("__name", "__b")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("career_races", "career_wins", "career_earnings")})
