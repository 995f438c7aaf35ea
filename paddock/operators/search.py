"""Substring search over names by a stored table of their grams: what a term can match is looked up, and then verified.

A gram is a run of two or three characters of a name in lower case. ``<path>/grams`` has (gram, row) in folders by the gram's hash, and
``<path>/rows`` the rows in folders by their number. A term's grams name the folders to read; the rows that have all of them
are the candidates, which alone are read and compared with the term. The table of grams is many times as long as that of rows; it is
written by the first search that has a gram to look up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import exists

#: Folders of either table, and the parts that the rows of a gram are cut into while they are written: a frequent one is no task of its own.
FOLDERS, PARTS = 64, 16


@dataclass
class Index:
    path: str
    column: str


def _folder(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


def build(rows: DataFrame, column: str, path: str) -> Index:
    """Indexes ``column`` of all rows, which are stored with all their columns. Null names and those of one character are stored and never found by grams."""
    spark = rows.sparkSession
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    numbered.write.parquet(f"{path}/numbered")  # the numbers must not change between the two tables
    numbered = spark.read.parquet(f"{path}/numbered")
    numbered.withColumn("__folder", _folder(F.col("__row"))).repartition(FOLDERS, "__folder").write.partitionBy("__folder").parquet(f"{path}/rows")
    return Index(path, column)


def _grams(spark: SparkSession, index: Index) -> DataFrame:
    """The table of grams, written if it is not there yet. Rows go by hash: ranges would need all grams made twice, to find their bounds."""
    path = f"{index.path}/grams"
    if not exists(spark, f"{path}/_SUCCESS"):
        low = F.lower(index.column)

        def runs(k: int) -> Column:
            starts = F.when(F.length(low) >= k, F.sequence(F.lit(1), F.length(low) - (k - 1)))
            return F.coalesce(F.transform(starts, lambda i: F.substring(low, i, F.lit(k))), F.array().cast("array<string>"))

        grams = F.array_distinct(F.concat(runs(2), runs(3)))
        posted = spark.read.parquet(f"{index.path}/numbered").select(F.explode(grams).alias("gram"), "__row").withColumn("__folder", _folder(F.col("gram")))
        posted.repartition("__folder", F.pmod("__row", F.lit(PARTS))).sortWithinPartitions("__folder", "gram").write.mode("overwrite").partitionBy("__folder").parquet(path)
    return spark.read.parquet(path)


def grams_of(term: str) -> list[str] | None:
    """The grams that whatever matches the term has; null if there are none, or escapes make it hard to tell.

    ``%`` and ``_`` are wildcards, so grams come from the pieces between them: three characters each, or the two of a shorter piece.
    """
    if "\\" in term:
        return None
    found = set()
    for piece in re.split("[%_]", term.lower()):
        size = 3 if len(piece) >= 3 else 2
        found |= {piece[i : i + size] for i in range(len(piece) - size + 1)}
    return sorted(found) or None


def search(spark: SparkSession, index: Index, term: str) -> DataFrame:
    """The rows whose name has the term as a part, without regard to case; the term's own wildcards work.

    Terms under two characters find nothing. Terms of wildcards and single characters alone, and those with a backslash, have no gram to
    look up: all rows are compared with them.
    """
    rows = spark.read.parquet(f"{index.path}/rows")
    hit = F.col(index.column).ilike(f"%{term}%")
    if len(term) < 2:
        return rows.filter(F.lit(False)).drop("__row", "__folder")
    grams = grams_of(term)
    if grams is None:
        return rows.filter(hit).drop("__row", "__folder")
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    posted = _grams(spark, index).filter(F.col("__folder").isin(folders) & F.col("gram").isin(grams))
    candidates = posted.groupBy("__row").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(grams)).select("__row")
    some = sorted(r[0] for r in candidates.select(_folder(F.col("__row"))).distinct().collect())  # at most FOLDERS
    read = rows.filter(reduce(lambda a, b: a | b, (F.col("__folder") == f for f in some), F.lit(False)))
    return read.join(candidates, "__row", "left_semi").filter(hit).drop("__row", "__folder")
