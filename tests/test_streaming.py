"""Streams with keyed state against batches."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paddock.operators import merge
from paddock.plans import catalogue
from paddock.streaming import keyed

from .compare import same

KINDS = "horse string, day string, id long, x string"


@pytest.mark.parametrize("name", ["stream_inserts", "stream_totals"])
def test_query(spark, name):
    same(spark, catalogue.QUERIES, catalogue.ORACLES, name)


class Arrivals:
    """Batches of rows, each taken by one run of the stream."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.out, self.checkpoint, self.before = spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", Counter()

    def take(self, rows, **more):
        """The rows that the run appends."""
        self.spark.createDataFrame(rows, KINDS).repartition(3).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(KINDS).parquet(self.source)
        run = keyed.append_inserted(stream, self.out, self.checkpoint, ["horse", "day"], ["id"], **more).start()
        run.awaitTermination()
        assert all(x["sources"][0]["description"].endswith("/in]") and len(x["sources"]) == 1 for x in run.recentProgress)  # the table is no source
        after = Counter(tuple(r) for r in self.spark.read.schema(KINDS).parquet(self.out).collect())
        fresh, self.before = after - self.before, after
        return sorted(fresh.elements(), key=str)


def test_inserted_is_what_the_batch_inserts(spark, tmp_path):
    """Repeats within a batch and of earlier ones, null keys, a hot key, an empty batch, keys known before the start."""
    first = [("a", "1", 3, "p"), ("a", "1", 2, "q"), (None, "1", 4, "r"), (None, "1", 1, "s"), ("k", "1", 9, "known"), ("b", None, 5, None)] + [("hot", "1", 100 + i, "h") for i in range(500)]
    nights = [first, [("a", "1", 1, "late"), ("c", "2", 6, "t"), (None, "1", 0, "u"), ("hot", "1", 1, "h")], [], [("hot", "2", 7, "v"), ("c", "2", 0, "w")]]
    table = spark.createDataFrame([("k", "1", 0, "known")], KINDS)
    arrivals = Arrivals(spark, tmp_path)
    for rows in nights:
        night = spark.createDataFrame(rows, KINDS)
        wanted = merge.new_rows(table, night, ["horse", "day"], [F.col("id")]).select(*night.columns)
        fresh = sorted((tuple(r) for r in wanted.collect()), key=str)
        assert arrivals.take(rows, known=spark.createDataFrame([("k", "1", 0, "known")], KINDS)) == fresh
        table = spark.createDataFrame([tuple(r) for r in table.collect()] + fresh, KINDS)


def test_what_expires_counts_as_new(spark, tmp_path):
    """By the rows' own times: a day after its last row a key is forgotten, once the watermark is there."""
    kinds, expire, found = "horse string, at timestamp, id long", timedelta(days=1), []
    day = lambda n: datetime(2024, 1, n)
    for rows in ([("a", day(1), 1), ("b", day(1), 2)], [("b", day(2), 3), ("c", day(8), 4)], [("a", day(9), 5), ("c", day(8), 6)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed.inserted(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), ["horse"], ["id"], time="at", expire=expire)
        run = stream.writeStream.foreachBatch(lambda batch, _: found.extend(r.id for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(90)
    assert sorted(found) == [1, 2, 4, 5]
    with pytest.raises(ValueError):
        keyed.inserted(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), ["horse"], ["id"], expire=expire)


def test_totals(spark, tmp_path):
    source, found, sums = f"{tmp_path}/in", [], {"n": "1", "ids": "id"}
    for rows in ([("a", "1", 3, "p"), ("a", "1", 2, "q"), (None, "1", None, "r")], [("a", "2", 5, "p"), ("b", "1", 1, "")]):
        spark.createDataFrame(rows, KINDS).write.mode("append").parquet(source)
        stream = keyed.totalled(spark.readStream.schema(KINDS).parquet(source), ["horse"], sums)
        stream.writeStream.foreachBatch(lambda batch, _: found.append(Counter(map(tuple, batch.collect())))).option("checkpointLocation", f"{tmp_path}/c").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert [f for f in found if f] == [Counter([("a", 2.0, 5.0), (None, 1.0, 0.0)]), Counter([("a", 3.0, 10.0), ("b", 1.0, 1.0)])]
