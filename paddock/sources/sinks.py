"""Results as files. Everything is written by the tasks that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, its first column led by a byte-order mark for spreadsheets that need one."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A full recomputation takes the place of the table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def snapshot(df: DataFrame, path: str, version: str) -> None:
    """A copy under its version, so that readers keep theirs."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
