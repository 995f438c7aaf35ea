"""Incremental merge without a table format: insert-if-absent, replace, coalescing upsert, keyed updates and deletes.

Keys are compared null-safely where a key may be null. All of them are idempotent: applied twice they equal once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def one_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be unique within a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def new_rows(old: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose key is not known yet, one a key: what an insert-if-absent appends."""
    fresh = one_per_key(incoming, keys, order)
    return fresh.join(old.select(*keys).distinct().alias("o"), reduce(lambda a, b: a & b, (fresh[k].eqNullSafe(F.col(f"o.{k}")) for k in keys)), "left_anti")


def insert_if_absent(old: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return old.unionByName(new_rows(old, incoming, keys, order), allowMissingColumns=True)


def insert_stubs(old: DataFrame, incoming: DataFrame, keys: list[str], stub: dict[str, Column]) -> DataFrame:
    """Adds a row of defaults for each key that is not known; keys are compared null-safely."""
    asked = incoming.select(*keys).distinct()
    stubs = asked.join(old.select(*keys).alias("o"), reduce(lambda a, b: a & b, (asked[k].eqNullSafe(F.col(f"o.{k}")) for k in keys)), "left_anti")
    return old.unionByName(stubs.withColumns(stub), allowMissingColumns=True)


def known_or_new(old: DataFrame, incoming: DataFrame, key: str, year: str) -> DataFrame:
    """``<key>, is_new, <year>``: for each incoming key whether a stub has to be made, and the latest year that is known for it."""
    known = old.groupBy(F.col(key).alias("__key")).agg(F.max(year).alias(year), F.lit(False).alias("is_new"))
    asked = incoming.select(key).distinct()
    return asked.join(known, asked[key].eqNullSafe(known["__key"]), "left").select(key, F.coalesce("is_new", F.lit(True)).alias("is_new"), year)


def replace_upsert(old: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows take the place of those with their key."""
    return old.join(incoming, same_key(old, incoming, keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def coalesce_upsert(old: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values win where they are not null; rows unknown so far are added."""
    o, n = old.alias("o"), incoming.alias("n")
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    return o.join(n, on, "full_outer").select(*(F.coalesce(*([F.col(f"n.{c}")] if c in incoming.columns else []), F.col(f"o.{c}")).alias(c) for c in old.columns))


def keyed_update(rows: DataFrame, changes: DataFrame, keys: list[str], overwrite: bool = True, by: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Columns of ``changes`` (one row a key) set in the rows with its key; without ``overwrite`` only where it has a value.

    Keys are compared as ``by`` makes them, such as normalised names."""
    r, c = rows.alias("r"), changes.withColumn("__hit", F.lit(True)).alias("c")
    on = reduce(lambda a, b: a & b, (by(F.col(f"r.{k}")).eqNullSafe(by(F.col(f"c.{k}"))) for k in keys))
    changed = [x for x in changes.columns if x not in keys]

    def value(x: str) -> Column:
        if x not in changed:
            return F.col(f"r.{x}")
        new = F.when(F.col("c.__hit"), F.col(f"c.{x}")).otherwise(F.col(f"r.{x}")) if overwrite else F.coalesce(F.col(f"c.{x}"), F.col(f"r.{x}"))
        return new.alias(x)

    return r.join(c, on, "left").select(*(value(x) for x in rows.columns))


def delete_keys(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(keys_of, same_key(rows, keys_of, keys), "left_anti")


def rename_values(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Repoints ``column`` by a table (variant, canonical)."""
    return rows.join(names, rows[column] == names["variant"], "left").withColumn(column, F.coalesce("canonical", column)).drop("variant", "canonical")


def set_status(rows: DataFrame, condition: Column, status: Column, at: Column) -> DataFrame:
    """Sets ``backfill_status`` and ``last_backfill_at`` where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({"backfill_status": F.when(hit, status).otherwise(F.col("backfill_status")), "last_backfill_at": F.when(hit, at).otherwise(F.col("last_backfill_at"))})
