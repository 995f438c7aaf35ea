"""Merges of streams by keyed state: what is known of each key is kept by Spark, so no batch reads the table that it appends to.

State is partitioned by key, kept in RocksDB and checkpointed with the stream: a lost executor's share is loaded elsewhere. Before the
shuffle each Arrow batch keeps one row a key (``inserted``) or one sum (``totalled``), so a key with a third of all rows is a row a batch.
A call to the state costs a round trip, so ``inserted`` keeps keys by buckets, as digests of 16 bytes, and asks once a bucket.
With ``expire`` a key is forgotten once the watermark is so far beyond its last row's time: its next row counts as new. Without it nothing is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bytes of a key's digest.
DIGEST = 16
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first(rows: pd.DataFrame, keys: list[str], order: list[str]) -> pd.DataFrame:
    return rows.sort_values(order, kind="stable", na_position="last").drop_duplicates(keys)


class SeenKeys(StatefulProcessor):
    """Gives out the first row of each key of a bucket that has not been seen, or not for ``expire_ms`` by the column ``time``."""

    def __init__(self, columns: list[str], order: list[str], time: str | None, expire_ms: int):
        self.columns, self.order, self.time, self.expire_ms = columns, order, time, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "keys binary, times binary")

    def _known(self) -> dict[bytes, int]:
        found = self.seen.get()
        if found is None or found[0] is None:
            return {}
        keys = bytes(found[0])
        return dict(zip((keys[i : i + DIGEST] for i in range(0, len(keys), DIGEST)), np.frombuffer(bytes(found[1]), np.int64).tolist(), strict=True))

    def _keep(self, known: dict[bytes, int]) -> None:
        self.seen.update((b"".join(known), np.fromiter(known.values(), np.int64, len(known)).tobytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, arrived = self._known(), pd.concat(list(rows)).set_axis(self.columns, axis=1)  # Spark renames columns that begin with an underscore
        if self.time:
            over = timerValues.getCurrentWatermarkInMs() - self.expire_ms
            known = {k: t for k, t in known.items() if t >= over}
        keys = arrived["__key"].map(bytes)
        new = np.array([k not in known for k in keys], bool)
        fresh = _first(arrived.assign(**{"__key": keys})[new], ["__key"], self.order)
        at = arrived[self.time].map(lambda t: 0 if pd.isna(t) else int(t.timestamp() * 1000)) if self.time else [0] * len(keys)
        for k, t in zip(keys, at, strict=True):
            known[k] = max(t, known.get(k, 0))
        self._keep(known)
        yield fresh.drop(columns=["__key", "__bucket"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = self._known()
        for keys in initialState["keys"]:
            known.update(dict.fromkeys(map(bytes, keys), 0))
        self._keep(known)

    def close(self) -> None:
        pass


class Totals(StatefulProcessor):
    """Gives out a key's sums over all its rows so far, whenever rows come."""

    def __init__(self, keys: list[str], sums: list[str]):
        self.keys, self.sums = keys, sums

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", ", ".join(f"`{c}` double" for c in self.sums))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = list(self.total.get()) if self.total.exists() else [0.0] * len(self.sums)
        for some in rows:
            total = [t + float(some[c].sum()) for t, c in zip(total, self.sums, strict=True)]
        self.total.update(tuple(total))
        yield pd.DataFrame([[*key, *total]], columns=[*self.keys, *self.sums])

    def close(self) -> None:
        pass


def _digested(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds ``__key``, a digest of the keys as text, and its bucket."""
    digest = F.unhex(F.md5(F.to_json(F.array(*(F.col(k).cast("string") for k in keys))).cast("binary")))
    return rows.withColumn("__key", digest).withColumn("__bucket", F.pmod(F.crc32("__key"), F.lit(buckets)).cast("int"))


def inserted(stream: DataFrame, keys: list[str], order: list[str], known: DataFrame | None = None, time: str | None = None, expire: timedelta | None = None, buckets: int = 1024) -> DataFrame:
    """Of a stream's rows the first of each key, whatever batch they come in: insert-if-absent.

    Of rows of one batch the first in ``order`` counts, nulls last. ``known`` has keys that are there before the stream starts; it is read once,
    when there is no checkpoint. Null keys are keys; repeats, late ones too, give nothing; an empty batch gives nothing. ``expire`` goes by the
    timestamps in ``time``; as Spark has it, rows that are later than the watermark, by ``expire``, are not taken then. A bucket's keys are
    held at once, 24 bytes each, and written anew when some arrive: ``buckets`` should grow with the number of keys, and stays as it is for a checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if (time is None) != (expire is None):
        raise ValueError("what expires needs a time")
    digested = _digested(stream, keys, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([*dict.fromkeys(["__key", *order])]).to_pandas()
            firsts = set(_first(rows, ["__key"], order).index.tolist())
            if time:  # the last time of a key counts too
                firsts |= set(batch.select(["__key", time]).to_pandas().sort_values(time).drop_duplicates("__key", keep="last").index.tolist())
            yield batch.take(pa.array(sorted(firsts), pa.int64()))

    rows = digested.mapInArrow(run, digested.schema)
    if expire:
        rows = rows.withWatermark(time, f"{int(expire.total_seconds() * 1000)} milliseconds")
    start = None
    if known is not None:
        start = _digested(known.select(*keys).distinct(), keys, buckets).groupBy("__bucket").agg(F.collect_list("__key").alias("keys")).groupBy("__bucket")
    processor = SeenKeys(digested.columns, order, time, int(expire.total_seconds() * 1000) if expire else 0)
    return rows.groupBy("__bucket").transformWithStateInPandas(processor, stream.schema, "Append", "EventTime" if expire else "None", initialState=start)


def totalled(stream: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``<keys>`` and a double for each of ``sums`` (name: SQL expression): a key's sums over all batches so far, for each key that got rows. Nulls count 0."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    values = stream.select(*keys, *(F.coalesce(F.expr(e).cast("double"), F.lit(0.0)).alias(n) for n, e in sums.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(keys).aggregate([(n, "sum") for n in sums])
            columns = [found.column(k) for k in keys] + [found.column(f"{n}_sum") for n in sums]
            yield from pa.Table.from_arrays(columns, schema=batch.schema).combine_chunks().to_batches()

    kinds = ", ".join([f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys] + [f"`{n}` double" for n in sums])
    return values.mapInArrow(run, values.schema).groupBy(*keys).transformWithStateInPandas(Totals(keys, list(sums)), kinds, "Update", "None")


def append_inserted(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], **more):
    """The writer, to be started by the caller, that appends ``inserted`` to the Parquet folder ``table``, each row exactly once."""
    rows = inserted(stream, keys, order, **more)
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
