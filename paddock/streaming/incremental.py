"""Races that arrive as files or messages, merged batch by batch with the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.merge import new_rows
from ..session import exists


def ingest(stream: DataFrame, table: str, checkpoint: str, watermark: str = "7 days", time_col: str = "arrived_at"):
    """Appends unseen races to the Parquet folder ``table``, a part a batch; a batch that is run again overwrites its part.

    Repeats within the watermark are dropped by the stream itself, older ones by the anti-join with the table. Returns
    the query's writer, to be started by the caller.
    """

    def merge(batch: DataFrame, number: int) -> None:
        # reads the keys of the whole table; ``keyed.append_inserted`` keeps them as state instead
        spark = batch.sparkSession
        path = f"{table}/batch={number}"
        known = batch.limit(0)
        if exists(spark, table):
            known = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(table).filter(F.col("batch") != number)
        rows = new_rows(known, batch, ["horse_name", "race_date"], [F.col("race_code").asc_nulls_last(), F.col("id").asc_nulls_last()])
        rows.select(*batch.columns).write.mode("overwrite").parquet(path)

    once = stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["horse_name", "race_date", "race_code"])
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
