"""Rows in one order over many tasks: running sums, and pages of any number, without a task that sees all rows.

Rows are range-sorted into partitions, which are written with the number of their partition. What precedes a partition is
known from the counts of those before it, a row a partition; inside a partition a window does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import shared_path


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds, for each name in ``sums``, the sum over the rows of the same ``keys`` up to and including this one, and ``<name>_all``, that of all of
    them. ``order`` should be unique within a key; null keys are keys. A key with all rows is spread over as many tasks as any."""
    named = rows.withColumns({f"__v_{n}": c for n, c in sums.items()})
    path = shared_path(rows.sparkSession, "ranges")
    (named.repartitionByRange(parts, *keys, *order) if parts else named.repartitionByRange(*keys, *order)).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    totals = ranged.groupBy("__range", *keys).agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))  # a row a partition and a key in it
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.col(k).alias(f"__k_{k}") for k in keys), *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums), *(F.sum(f"__t_{n}").over(of_key).alias(f"{n}_all") for n in sums))
    on = [ranged["__range"] == offsets["__range"], *(ranged[k].eqNullSafe(offsets[f"__k_{k}"]) for k in keys)]
    inside = Window.partitionBy(ranged["__range"], *(ranged[k] for k in keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.withColumns({f"__i_{n}": F.sum(f"__v_{n}").over(inside) for n in sums}).join(offsets, on)
    return joined.select(*(ranged[c] for c in rows.columns), *((F.col(f"__o_{n}") + F.col(f"__i_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


@dataclass
class Ranked:
    """A stored order of rows: ``<path>/rows``, a folder a range, and ``<path>/counts``, the rows of each range by facets."""

    path: str
    order: list[tuple[str, bool]]
    facets: list[str]


def _sort(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]


def store_ranked(rows: DataFrame, path: str, order: list[tuple[str, bool]], facets: list[str], parts: int | None = None) -> Ranked:
    """Writes rows in ``order`` (column, whether rising; nulls last; unique as a whole), to be read by ``page``, in so many ranges or else as many as their size calls for."""
    sort = _sort(order)
    (rows.repartitionByRange(parts, *sort) if parts else rows.repartitionByRange(*sort)).sortWithinPartitions(*sort).withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/rows").groupBy("__range", *facets).agg(F.count(F.lit(1)).alias("__n")).write.parquet(f"{path}/counts")
    return Ranked(path, order, facets)


def page(spark: SparkSession, stored: Ranked, page: int = 1, limit: int = 25, facets: dict[str, object] | None = None, test: Column | None = None) -> DataFrame:
    """The rows of a page among those with these ``facets`` that pass ``test``, with ``rank`` (from 1) and ``total`` among them, and ``pages``.

    Only the ranges that the page lies in are read. Facets are counted in the stored counts; an own ``test`` has to count the rows
    that pass it first. Pages beyond the last, and of less than one, are empty; a limit is at least one.
    """
    limit, sort, rows = max(1, limit), _sort(stored.order), spark.read.parquet(f"{stored.path}/rows")
    asked = [F.col(k).eqNullSafe(F.lit(v)) for k, v in (facets or {}).items()] + ([] if test is None else [test])

    def kept(df: DataFrame, tests: list[Column]) -> DataFrame:
        for t in tests:
            df = df.filter(t)
        return df

    if test is None:
        counts = kept(spark.read.parquet(f"{stored.path}/counts"), asked).groupBy("__range").agg(F.sum("__n").alias("n"))
    else:
        counts = kept(rows, asked).groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    first, last, upto, wanted = (page - 1) * limit, page * limit, 0, {}
    for r in sorted(counts.collect()):  # a row a range
        if upto < last and upto + r["n"] > first >= 0:
            wanted[r["__range"]] = upto
        upto += r["n"]
    before = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)) if wanted else F.create_map(F.lit(0), F.lit(0))
    shown = kept(rows.filter(F.col("__range").isin(*wanted) if wanted else F.lit(False)), asked)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*sort)) + before[F.col("__range")]
    ranked = shown.withColumn("rank", rank).filter((F.col("rank") > first) & (F.col("rank") <= last)).drop("__range")
    return ranked.withColumns({"total": F.lit(upto).cast("long"), "pages": F.lit(-(-upto // limit)).cast("long")}).orderBy("rank")
