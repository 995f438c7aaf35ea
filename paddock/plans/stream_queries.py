"""Queries over streams: the events are replayed in nights, and the outcome is that of a batch."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..session import shared_path, table
from ..streaming import keyed
from .registry import query

NIGHTS = 3


def _replayed(spark: SparkSession, sf: str, run) -> None:
    """Every third event arrives, the stream takes what there is and stops, and so on; its state stays in the checkpoint."""
    events, arrivals = table(spark, sf, "events").withColumn("day", F.to_date("ts")), shared_path(spark, "arrivals")
    for night in range(NIGHTS):
        events.filter(F.col("event_id") % NIGHTS == night).write.mode("append").parquet(arrivals)
        run(spark.readStream.schema(events.schema).parquet(arrivals)).start().awaitTermination()


@query(f"SELECT event_id, user_id, event_type, ts::DATE::VARCHAR AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id % {NIGHTS}, event_id) = 1")
def stream_inserts(spark, sf):
    """Insert-if-absent over three nights: the first event of each user, type and day stays."""
    out, checkpoint = shared_path(spark, "inserted"), shared_path(spark, "checkpoint")
    _replayed(spark, sf, lambda stream: keyed.append_inserted(stream, out, checkpoint, ["user_id", "event_type", "day"], ["event_id"]))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", F.col("day").cast("string").alias("day"))


@query("SELECT user_id, count(*)::DOUBLE AS events, count(*) FILTER (event_type = 'click')::DOUBLE AS clicks, round(sum(value), 2) AS value FROM events GROUP BY user_id")
def stream_totals(spark, sf):
    """Careers as they grow: a user's sums over all nights, the last of those given out."""
    out, checkpoint = shared_path(spark, "totals"), shared_path(spark, "checkpoint")
    sums = {"events": "1", "clicks": "cast(event_type = 'click' as int)", "value": "value"}

    def run(stream):
        def keep(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")  # run again, it overwrites its part

        return keyed.totalled(stream, ["user_id"], sums).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True)

    _replayed(spark, sf, run)
    last = F.max_by(F.struct(*sums), "batch")
    found = spark.read.parquet(out).groupBy("user_id").agg(last.alias("t"))
    return found.select("user_id", "t.events", "t.clicks", F.round("t.value", 2).alias("value"))
