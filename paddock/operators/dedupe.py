"""Duplicate rows and duplicate entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.names import canonical_name
from .merge import one_per_key, rename_values


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number ``c``; nulls are a key like any other."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")


def keep_best(rows: DataFrame, keys: list[str], score: str, row_id: str) -> DataFrame:
    """Of each key the row with the highest score, then the highest row id."""
    return one_per_key(rows, keys, [F.col(score).desc_nulls_last(), F.col(row_id).desc()])


def canonical_variants(entities: DataFrame, counts: DataFrame, name: str = "name", year: str = "birth_year") -> DataFrame:
    """(variant, canonical) for the spellings of one canonical name and year: an exact match wins, else the spelling with
    most races, then the smaller spelling. Entities without a year are left alone."""
    spelled = entities.filter(F.col(year).isNotNull()).select(F.col(name).alias("variant"), F.col(year).alias("__year"), canonical_name(F.col(name)).alias("__key")).distinct()
    known = spelled.join(counts.select(F.col(counts.columns[0]).alias("variant"), F.col(counts.columns[1]).alias("__races")), "variant", "left")
    group = Window.partitionBy("__key", "__year")
    best = F.first("variant").over(group.orderBy((F.col("variant") == F.col("__key")).desc(), F.coalesce("__races", F.lit(0)).desc(), F.col("variant")))
    return known.withColumn("canonical", best).filter("variant <> canonical").select("variant", "canonical").distinct()


def merge_variants(entities: DataFrame, races: DataFrame, entity_key: list[str], race_key: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Entities and races with variants repointed to their canonical name and what then repeats dropped."""
    counts = races.groupBy("horse_name").agg(F.count(F.lit(1)).alias("races"))
    names = canonical_variants(entities, counts)
    merged = one_per_key(rename_values(races, "horse_name", names), race_key, order)
    return rename_values(entities, "name", names).dropDuplicates(entity_key), merged
