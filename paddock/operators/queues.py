"""Work queues of the incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def active_queue(horses: DataFrame, races: DataFrame, as_of: Column, days: int = 180, limit: int | None = 3000) -> DataFrame:
    """Horses with a race since ``days`` before ``as_of``, the longest unvisited first."""
    recent = races.filter(F.col("race_date") >= F.date_sub(as_of, days)).select(F.col("horse_name").alias("name"))
    due = horses.join(recent, "name", "left_semi").orderBy(F.col("last_updated").asc_nulls_first(), "name", "birth_year")
    return due.limit(limit) if limit else due


def rearm(horses: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Done horses whose last visit is older than ``days`` become pending again, as do those never visited."""
    stale = (F.col("backfill_status") == "done") & (F.col("last_backfill_at").isNull() | (F.col("last_backfill_at") < F.date_sub(as_of, days)))
    return horses.withColumn("backfill_status", F.when(stale, "pending").otherwise(F.col("backfill_status")))


def backfill_queue(horses: DataFrame, as_of: Column, days: int = 180, limit: int | None = 250) -> DataFrame:
    pending = rearm(horses, as_of, days).filter("backfill_status = 'pending'").orderBy(F.col("last_backfill_at").asc_nulls_first(), "name", "birth_year")
    return pending.limit(limit) if limit else pending


def missing_meetings(meetings: DataFrame, races: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Meetings with fewer than ``least`` runner rows stored, and ``n``, how many."""
    stored = races.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return meetings.join(stored, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)
