"""Careers in parts: new races recompute the parts of the horses that got some, and leave the files of all others as they are.

Races, horses and careers lie in folders by a hash of the horse's canonical name. What new races are is found by an anti-join with the parts
that they fall in; careers of those parts are computed anew and take the place of the old ones, and then the races are added.
A run that is cut off in between is repeated as a whole: until the races are added they are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import canonical_name
from ..operators.career import careers
from ..operators.merge import new_rows

PARTS = 32
KEYS = ["horse_name", "race_date"]


def part_of(name: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(canonical_name(name)), F.lit(parts)).cast("int")


def _put(df: DataFrame, path: str, mode: str) -> None:
    """With ``overwrite`` the parts that ``df`` has rows of, and no others."""
    df.repartition("part").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _get(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if wanted is None else rows.filter(F.col("part").isin(wanted))


def start(horses: DataFrame, races: DataFrame, root: str, parts: int = PARTS) -> None:
    """Everything, computed once. Horses without a name have no careers and are left out, as they are by ``merge_races``."""
    h, r = horses.filter("name is not null").withColumn("part", part_of(F.col("name"), parts)), races.withColumn("part", part_of(F.col("horse_name"), parts))
    _put(h, f"{root}/horses", "overwrite")
    _put(r, f"{root}/races", "overwrite")
    _put(careers(h, r.drop("part")), f"{root}/careers", "overwrite")


def merge_races(spark: SparkSession, root: str, incoming: DataFrame, order: list[Column], parts: int = PARTS) -> list[int]:
    """Adds the races that are not known by horse and day, one of each, and recomputes the careers of their parts, which it returns."""
    arrived = incoming.withColumn("part", part_of(F.col("horse_name"), parts))
    reached = sorted(r[0] for r in arrived.select("part").distinct().collect())  # at most ``parts``
    if not reached:
        return []
    stored = _get(spark, f"{root}/races", reached)
    fresh = new_rows(stored, arrived, KEYS, order).select(*stored.columns)
    touched = sorted(r[0] for r in fresh.select("part").distinct().collect())
    if touched:
        known = _get(spark, f"{root}/races", touched).drop("part").unionByName(fresh.drop("part"))
        _put(careers(_get(spark, f"{root}/horses", touched), known), f"{root}/careers", "overwrite")
        _put(fresh, f"{root}/races", "append")
    return touched


def stored_careers(spark: SparkSession, root: str) -> DataFrame:
    return _get(spark, f"{root}/careers").drop("part")


def stored_races(spark: SparkSession, root: str) -> DataFrame:
    return _get(spark, f"{root}/races").drop("part")
