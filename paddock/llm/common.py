"""What the training-data operators share: the shared folder, staged tables and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import dropped, shared_dir, shared_path  # noqa: F401  shared_dir is part of what operators share

#: Folders staged so far and not deleted yet.
_FOLDERS: list[str] = []


def written(df: DataFrame, kind: str = "stage") -> tuple[DataFrame, str]:
    """``df`` written as Parquet into the shared folder and read again, and its folder, which goes when the process ends."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written and read again: lineage ends there, and a lost executor costs a read instead of a recomputation.
    The folder goes when the process ends, or before with ``release``."""
    out, path = written(df, "paddock")
    _FOLDERS.append(path)
    return out


def release(docs: DataFrame) -> None:
    """Deletes what was staged before ``docs``, if ``docs`` is read from files of its own, so that nothing staged is needed any more."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    files = docs.inputFiles()
    if files and "InMemoryRelation" not in plan and not any("/paddock-" in f for f in files):
        while _FOLDERS:
            dropped(docs.sparkSession, _FOLDERS.pop())


def unstaged(*frames: DataFrame) -> None:
    """Deletes what was staged as these frames, when nothing reads them any more."""
    names = {file.split("/")[-2] for df in frames for file in df.inputFiles()}
    for path in [p for p in _FOLDERS if p.rsplit("/", 1)[1] in names]:
        _FOLDERS.remove(path)
        dropped(frames[0].sparkSession, path)


#: Spark's setting that removes a query's shuffle files when it ends. Else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made inside go as each of them ends. The session's own setting holds again afterwards."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def tasks(spark: SparkSession) -> int:
    """The shuffle width of the session, which its owner sets in proportion to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, keys: list[str], cell: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before this one by (``cell``, ``order``).

    No window spans a whole key: each (keys, cell) is summed first, the few cell totals are accumulated, and rows are
    numbered only inside their cell. The caller chooses ``cell`` monotone in the wished order and fine enough for a task.
    Keys are compared null-safely through the caller: pass non-null keys.
    """
    totals = df.groupBy(*keys, cell).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, cell, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*keys, cell])
        .withColumn(out, (F.col("__offset") + F.col("__inside")))
        .drop("__offset", "__inside")
    )


def range_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum over the rows that come before this one in ``order``, which should be unique.

    Rows are range-sorted into partitions, whose totals are accumulated; inside a partition a window does the rest.
    """
    ranged = staged(df.withColumns({f"__v_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = ranged.groupBy("__range").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__t_{n}").over(upto), F.lit(0)).alias(f"__o_{n}") for n in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), "__range")
    return joined.select(*df.columns, *((F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) + F.col(f"__o_{n}")).alias(n) for n in sums))
