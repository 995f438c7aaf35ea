"""Pedigrees of two generations by self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import plain_key, truthy

ANCESTORS = ("sire", "dam", "sire_sire", "sire_dam", "dam_sire", "dam_dam")


def parents_of(horses: DataFrame) -> DataFrame:
    """``__key, sire, dam``: one row a name, by plain key. Of rows that share a name the one with more parents known, then the last in order."""
    known = F.when(F.col("sire").isNotNull(), 1).otherwise(0) + F.when(F.col("dam").isNotNull(), 1).otherwise(0)
    best = horses.groupBy(plain_key(F.col("name")).alias("__key")).agg(F.max(F.struct(known.alias("known"), "sire", "dam")).alias("b"))
    return best.select("__key", "b.sire", "b.dam")


def grandparents(horses: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Adds the parents of sire and dam, looked up by plain key in ``parents`` (or the horses); rows never multiply."""
    known = parents_of(parents if parents is not None else horses)
    s = known.select(F.col("__key").alias("__s"), F.col("sire").alias("sire_sire"), F.col("dam").alias("sire_dam"))
    d = known.select(F.col("__key").alias("__d"), F.col("sire").alias("dam_sire"), F.col("dam").alias("dam_dam"))
    named = lambda c: F.nullif(plain_key(F.col(c)), F.lit(""))
    return horses.join(s, named("sire") == F.col("__s"), "left").join(d, named("dam") == F.col("__d"), "left").drop("__s", "__d")


UP = """
WITH RECURSIVE up (name, ancestor, path, met) AS (
  SELECT DISTINCT name, name, '', array(key) FROM {asked}
  UNION ALL
  SELECT up.name, e.parent, concat(up.path, e.side), array_append(up.met, e.parent_key)
  FROM up JOIN {edges} e ON e.child = element_at(up.met, -1)
  WHERE length(up.path) < {depth} AND NOT array_contains(up.met, e.parent_key))
SELECT name, path, ancestor FROM up WHERE path <> ''
"""


def ancestors(horses: DataFrame, depth: int, asked: DataFrame | None = None) -> DataFrame:
    """``name, path, ancestor``: all known ancestors of ``asked`` (or of all) up to so many generations; ``path`` leads to them, 'sd' being the sire's dam.

    By a recursive query that joins a generation at a time. Parents are looked up by plain key as in ``grandparents``. An ancestor that stands
    in its own line ends that line, so a cycle in the data ends too; one that stands in several lines has a row for each.
    """
    if depth < 1:
        raise ValueError("at least one generation")
    spark = horses.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the depth bounds it
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(100, depth + 2)))
    side = lambda c, s: parents_of(horses).select(F.col("__key").alias("child"), F.col(c).alias("parent"), plain_key(F.col(c)).alias("parent_key"), F.lit(s).alias("side"))
    edges = side("sire", "s").unionByName(side("dam", "d")).filter("parent_key <> ''")
    names = (asked if asked is not None else horses).select("name", plain_key(F.col("name")).alias("key")).filter("name is not null")
    return spark.sql(UP, asked=names, edges=edges, depth=depth)


def with_fallback(pedigree: DataFrame, fallback: DataFrame, key: str = "name") -> DataFrame:
    """Ancestors of ``pedigree``, from ``fallback`` (one row a name) where null or empty, field by field."""
    other = fallback.select(plain_key(F.col(key)).alias("__key"), *(F.col(c).alias(f"__{c}") for c in ANCESTORS))
    joined = pedigree.join(other, plain_key(pedigree[key]) == other["__key"], "left")
    return joined.withColumns({c: truthy(F.col(c), F.col(f"__{c}")) for c in ANCESTORS}).drop("__key", *(f"__{c}" for c in ANCESTORS))


def parents_latest(horses: DataFrame) -> DataFrame:
    """``name, birth_year``: each sire and dam with the latest year of a foal."""
    both = horses.select(F.explode(F.array("sire", "dam")).alias("name"), "birth_year")
    return both.filter("name is not null and name <> ''").groupBy("name").agg(F.max("birth_year").alias("birth_year"))


def incomplete(horses: DataFrame) -> DataFrame:
    return horses.filter("sire is null or dam is null").select("name", "birth_year")


def complete_names(pedigree: DataFrame) -> DataFrame:
    """Names of whom all four grandparents are known."""
    return pedigree.filter("sire_sire is not null and sire_dam is not null and dam_sire is not null and dam_dam is not null").select("name").distinct()


def parents_to_complete(horses: DataFrame, pedigree: DataFrame) -> DataFrame:
    return parents_latest(horses).join(complete_names(pedigree), "name", "left_anti")


def ancestor_names(horses: DataFrame) -> DataFrame:
    """``name, ancestors``: up to six distinct ancestors, by plain key."""
    up = F.array(*(F.nullif(plain_key(F.col(c)), F.lit("")) for c in ANCESTORS))
    return grandparents(horses).select("name", F.array_distinct(F.filter(up, lambda x: x.isNotNull())).alias("ancestors"))


def already_complete(horses: DataFrame, pedigree: DataFrame) -> DataFrame:
    """One row, ``n``: how many of the parents have all four grandparents."""
    return parents_latest(horses).join(complete_names(pedigree), "name", "left_semi").agg(F.count(F.lit(1)).alias("n"))
