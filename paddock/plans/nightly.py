"""The nightly batch as one chain of pure steps: merge, careers, ratings, sire ratings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.names import plain_key
from ..operators.career import careers
from ..operators.merge import insert_if_absent, insert_stubs, keyed_update
from ..operators.queues import missing_meetings
from ..operators.ratings import rate
from ..operators.sires import running_progeny, sire_stats
from ..session import shared_path
from ..sources.pages import career_profiles, career_races, result_rows

#: Races before this day are not taken in.
FIRST_DAY = "2012-01-01"


@dataclass
class Nightly:
    horses: DataFrame
    races: DataFrame
    ratings: DataFrame | None
    sires: DataFrame | None
    counters: DataFrame


def nightly(horses: DataFrame, races: DataFrame, incoming: DataFrame, rankings: DataFrame, as_of: Column, mode: str = "full", first_day: str = FIRST_DAY, root: str | None = None) -> Nightly:
    """``results`` merges new races and their horses, ``maintenance`` recomputes, ``full`` does both.

    ``incoming`` has the columns of races. Merged tables are written below ``root`` (the shared folder, if there is none), and what is derived
    goes on from there. The counters are observed while they are written: nothing is read to be counted. Derived tables are
    recomputed whole and meant to be overwritten; ``results`` leaves them out (None).
    """
    if mode not in ("results", "maintenance", "full"):
        raise ValueError(f"unknown mode {mode}")
    spark, known = horses.sparkSession, F.coalesce("__known", F.lit(False))
    root = root or shared_path(spark, "nightly")
    horses, races = (df.withColumn("__known", F.lit(True)) for df in (horses, races))
    if mode != "maintenance":
        dated = incoming.filter(F.col("race_date") >= F.lit(first_day).cast("date"))
        races = insert_if_absent(races, dated, ["horse_name", "race_date"], [F.col("race_code").asc_nulls_last(), F.col("id").asc_nulls_last()])
        horses = insert_stubs(horses, dated.select(F.col("horse_name").alias("name")), ["name"], {"birth_year": F.lit(None).cast("int")})
    seen, counts = {}, []
    for name, df in (("horses", horses), ("races", races)):
        watch = Observation(f"nightly-{name}")
        df.observe(watch, F.count(F.lit(1)).alias(name), F.count_if(known).alias(f"{name}_before")).drop("__known").write.mode("overwrite").parquet(f"{root}/{name}")
        seen[name] = spark.read.schema(df.drop("__known").schema).parquet(f"{root}/{name}")
        counts.append(watch.get)
    counters = spark.createDataFrame([tuple(v for c in counts for v in (c[k] for k in sorted(c)))], ", ".join(f"{k} long" for c in counts for k in sorted(c)))
    if mode == "results":
        return Nightly(seen["horses"], seen["races"], None, None, counters)
    rated = careers(seen["horses"], seen["races"])
    ratings = rate(rated)
    stats = sire_stats(ratings, rankings, running_progeny(rated, seen["races"], as_of))
    return Nightly(rated, seen["races"], ratings, stats, counters)


KEYS = ["horse_name", "race_date"]


def missing_results(races: DataFrame, meetings: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    """Races with those of meetings that lack runners, read from their result pages (url, html), and inserted if absent.

    ``meetings`` is what ``pages.meetings`` finds; meetings and stored races meet by day and track, in any spelling of it.
    """
    wanted = meetings.select(F.col("data").alias("race_date"), plain_key(F.col("ippodromo")).alias("track"), "sigla", "url")
    stored = races.select(F.col("race_date").cast("string").alias("race_date"), plain_key(F.col("track")).alias("track"))
    gaps = missing_meetings(wanted, stored, ["race_date", "track"], least)
    rows = result_rows(gaps.join(pages, "url"))
    found = rows.select(F.col("name").alias("horse_name"), F.col("race_date").cast("date").alias("race_date"), "track", "placement", "time_km", "distance", "driver", F.col("prize").alias("prize_net"), "race_code")
    return insert_if_absent(races, found, KEYS, [F.col("race_code").asc_nulls_last()])


def full_careers(horses: DataFrame, races: DataFrame, pages: DataFrame, as_of: Column, first_day: str = FIRST_DAY) -> tuple[DataFrame, DataFrame]:
    """Horses and races after career pages (name, html) were read: known fields of the profiles win over stored ones, races
    since ``first_day`` are inserted if absent, and careers are computed anew."""
    profiles = career_profiles(pages, as_of).groupBy("name").agg(*(F.max(c).alias(c) for c in ("sex", "country", "birth_year", "sire", "dam")))
    merged = keyed_update(horses, profiles, ["name"], overwrite=False)
    dated = career_races(pages).filter(F.col("race_date") >= F.lit(first_day).cast("date"))
    inserted = insert_if_absent(races, dated, KEYS, [F.col("race_code").asc_nulls_last()])
    return careers(merged, inserted, order="race_code"), inserted
