"""Operator 4: mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time, the words of its source up to and including it over the source's
target; documents are then range-sorted by finish time over all sources and the schedule is truncated at the total
budget. A source whose target exceeds its size goes round again, up to ``most`` times.

Within a source and a round, finish times rise with the shuffled place. So what the truncation keeps of them is all up to
one place, and a table of these places, a row a source, tells each document what is taken of it: texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import prefix_sums, range_sums, staged, tasks

WORD = r"[^\x20\x09-\x0D]+"


def _source(c: Column) -> Column:
    return F.concat(F.lit("="), c.cast("string"))


def content(rows: DataFrame, columns: list[str]) -> Column:
    """A 64-bit hash of these columns."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return F.xxhash64(*(F.to_json(F.col(f"`{c}`")) if isinstance(kinds[c], T.MapType) else F.col(f"`{c}`") for c in columns))


def _place(seed: int, turn: int | Column, lone: Column) -> Column:
    """The shuffled place of a row in a round: by its id alone, and where ids are no names, by content and copy too."""
    more = F.when(~lone, F.concat_ws(":", F.col("__key"), F.col("__copy")))
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("__id").cast("string"), (F.lit(turn) if isinstance(turn, int) else turn).cast("string"), more).cast("binary"))


def sizes(docs: DataFrame, key: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``__id, __source, size, __key, __row``: the words of each whole text, and a hash of the columns ``key``."""
    return staged(
        docs.select(
            F.col(id_col).alias("__id"),
            _source(F.col(source_col)).alias("__source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            content(docs, key).alias("__key"),
        ).withColumn("__row", F.monotonically_increasing_id())
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``__source, source_size, target``: one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words; no target exceeds
    ``most`` times its source's size, and what is above goes to the others by weight: the level at which all of it is
    placed is found on the table of sources, range-sorted by their names and then by how soon they are full.
    """
    by_source = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("__source").asc_nulls_last()
    placed = range_sums(by_source, [by_name], {"__at": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = placed.select("__source", "source_size", weight.alias("__w"), (F.col("source_size") * F.lit(float(most))).alias("__cap"))
    filled = range_sums(weighed, [(F.col("__cap") / F.col("__w")).asc(), by_name], {"__filled": F.col("__cap"), "__used": F.col("__w")})
    total = filled.agg((F.sum("source_size") * F.lit(float(share))).alias("__budget"), F.sum("__w").alias("__all"))  # one row
    levels = filled.join(F.broadcast(total)).withColumn("__level", (F.col("__budget") - F.col("__filled")) / (F.col("__all") - F.col("__used")))
    # the first level that its own source can still take is the lowest of those that can be taken
    open_ = F.when(F.col("__level") * F.col("__w") <= F.col("__cap") * (1 + 1e-12), F.struct((F.col("__cap") / F.col("__w")).alias("full"), F.col("__level").alias("level")))
    reached = levels.agg(F.coalesce(F.min(open_)["level"], F.lit(0.0)).alias("__reached"))  # one row
    return filled.join(F.broadcast(reached)).select("__source", "source_size", F.least("__cap", F.col("__reached") * F.col("__w")).alias("target"))


@dataclass
class Schedule:
    """``rows``: those of ``sizes`` with ``__lone`` and ``__copy``; ``aims``: ``__source, source_size, target, __cuts``, the last
    place taken in each round; ``shared``: the ids that several rows have."""

    rows: DataFrame
    aims: DataFrame
    shared: DataFrame


def schedule(docs: DataFrame, key: list[str], weights: tuple[float, ...], most: int, share: float, seed: int, id_col: str, text_col: str, source_col: str) -> Schedule:
    """The truncated schedule. A source is never one task, nor are rows that share an id or have none: places come from
    hashes, rows lie in cells by their place, cell totals are accumulated, and only cells are sorted."""
    cells = 4 * tasks(docs.sparkSession)
    sized = sizes(docs, key, id_col, text_col, source_col)
    shared = staged(sized.filter("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__id"))
    # copies of a row are numbered; which copy gets which number is all the same, as nothing tells them apart
    alike = sized.filter("__id is null").unionByName(sized.join(shared, "__id", "left_semi").select(*sized.columns))
    alike = alike.select("__key", "__row", F.shiftright("__row", 33).alias("__part"), F.lit(1).cast("long").alias("__one"))
    copies = prefix_sums(alike, ["__key"], "__part", [F.col("__row")], "__one", "__copy").select("__row", "__copy")
    rows = sized.join(staged(copies), "__row", "left").withColumn("__lone", F.col("__copy").isNull())
    aims = staged(targets(sized, weights, float(most), share))

    met = rows.join(aims, rows["__source"].eqNullSafe(aims["__source"])).drop(aims["__source"]).filter((F.col("size") > 0) & (F.col("target") > 0))
    rounds = F.least(F.lit(most), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    turns = met.withColumn("__turn", F.explode(F.sequence(F.lit(0), rounds - 1))).withColumn("__place", _place(seed, F.col("__turn"), F.col("__lone")))
    share_of = F.conv(F.substring("__place", 1, 7), 16, 10).cast("long") / F.lit(16**7)
    turns = turns.select("size", "target", "source_size", F.coalesce("__source", F.lit("-")).alias("__s"), "__turn", "__place", F.floor(share_of * cells).cast("int").alias("__cell"))
    turns = prefix_sums(turns, ["__s", "__turn"], "__cell", [F.col("__place")], "size", "__before")
    finish = (F.col("__turn") * F.col("source_size") + F.col("__before") + F.col("size")) / F.col("target")
    timed = turns.select("size", "__s", "__turn", "__place", finish.alias("__finish"), F.lit(0).alias("__all"))
    timed = timed.withColumn("__cell", F.floor(F.col("__finish") * cells).cast("int"))
    timed = prefix_sums(timed, ["__all"], "__cell", [F.col("__finish"), F.col("__s"), F.col("__place")], "size", "__before")
    budget = aims.agg((F.sum("source_size") * F.lit(float(share))).alias("__budget"))  # one row
    kept = timed.join(F.broadcast(budget), F.col("__before") + F.col("size") <= F.col("__budget"))
    cuts = kept.groupBy("__s", "__turn").agg(F.max("__place").alias("__cut")).groupBy("__s").agg(F.map_from_entries(F.collect_list(F.struct("__turn", "__cut"))).alias("__cuts"))
    aims = aims.join(cuts, F.coalesce(aims["__source"], F.lit("-")) == cuts["__s"], "left").drop("__s")
    return Schedule(rows, staged(aims), shared)


def _times(seed: int, most: int, lone: Column) -> Column:
    """In how many rounds a row is taken."""
    taken = F.lit(0)
    for turn in range(most):
        taken = taken + F.when(_place(seed, turn, lone) <= F.try_element_at("__cuts", F.lit(turn)), 1).otherwise(0)
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, share: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: its id, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` words, a multiple of ``size``.

    Orders depend on ids and ``seed`` alone, and for rows that share an id or have none on their text and source too, so
    reruns agree whatever order the rows come in. Null and empty texts have size 0 and take 0; a null source is a source
    of its own, the last; repeated rows are scheduled each on its own; an empty table gives an empty result; other
    columns are ignored.
    """
    plan = schedule(docs, [id_col, text_col, source_col], weights, most, share, seed, id_col, text_col, source_col)
    joined = plan.rows.join(plan.aims, plan.rows["__source"].eqNullSafe(plan.aims["__source"]))
    taken = F.when(F.col("size") > 0, F.col("size") * _times(seed, most, F.col("__lone"))).otherwise(0).cast("long")
    return joined.select(F.col("__id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def repeat(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, share: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with its own columns.

    Rows are met with the small table of sources where they lie. Rows that share an id or have none are told apart by all
    their columns; copies alike in all of them are one row for which the times of all copies are added up.
    """
    plan = schedule(docs, docs.columns, weights, most, share, seed, id_col, text_col, source_col)
    some = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(id_col).alias("__id"), _source(F.col(source_col)).alias("__source"), some.alias("__some"))
    met = lambda rows: rows.join(plan.aims, rows["__source"].eqNullSafe(plan.aims["__source"]))
    no_key = {"__key": F.lit(None).cast("long"), "__copy": F.lit(None).cast("long")}
    lone = named.filter("__id is not null and __some").join(plan.shared, "__id", "left_anti").withColumns(no_key)
    lone = met(lone).select("__doc", _times(seed, most, F.lit(True)).alias("__times"))
    totals = met(plan.rows.filter("not __lone and size > 0")).groupBy("__key").agg(F.sum(_times(seed, most, F.lit(False))).cast("int").alias("__times"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(id_col).alias("__id"), content(docs, docs.columns).alias("__key"))
    alike = keyed.filter("__id is null").unionByName(keyed.join(plan.shared, "__id", "left_semi").select(*keyed.columns))
    alike = alike.dropDuplicates(["__key"]).join(totals, "__key").select("__doc", "__times")
    out = lone.unionByName(alike).filter("__times > 0")
    return out.select("__doc", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select("__doc.*")
