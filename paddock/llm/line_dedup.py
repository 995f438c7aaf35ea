"""Operator 2: line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

#: The share of a host's pages above which a line is boilerplate: text that a host writes anew is seldom on one page in fifty.
RATIO = 0.02


def _line(c: Column) -> Column:
    """A line as it is compared: without blanks, tabs and carriage returns at its ends."""
    return F.btrim(c, F.lit(" \t\r"))


def _key(c: Column) -> Column:
    """Hash of a compared line; null for a blank one, which is never boilerplate."""
    return F.when(_line(c) != "", F.xxhash64(_line(c)))


def _host(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``__host, __key``: the keys of the lines that more than ``ratio`` of a host's pages contain, at least ``min_pages``.

    Copies of a page within a host are one page: else a document with some copies would be boilerplate on all of its lines.
    First the copies are merged, each task's own before the shuffle, by a hash of the whole text; only the keys of the lines
    travel, eight bytes each. Then a page counts once for a line, and counts are partially aggregated before the shuffle by (host, line), so a
    line on all pages is a row a task there.
    """
    pages = docs.select(_host(F.col(host_col)).alias("__host"), F.col(text_col).cast("string").alias("__text"))
    keys = F.array_distinct(F.filter(F.transform(F.split("__text", "\n", -1), _key), lambda k: k.isNotNull()))
    copies = pages.select("__host", F.xxhash64("__text").alias("__page"), F.octet_length("__text").alias("__size"), keys.alias("__keys"))
    single = staged(copies.groupBy("__host", "__page", "__size").agg(F.first("__keys").alias("__keys")).select("__host", "__keys"))
    totals = single.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    found = single.select("__host", F.explode("__keys").alias("__key")).groupBy("__host", "__key").agg(F.count(F.lit(1)).alias("__n"))
    common = found.filter(F.col("__n") >= min_pages).join(totals, "__host").filter(F.col("__n") > ratio * F.col("__pages"))
    return common.select("__host", "__key")


def dedup_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without the boilerplate lines of each host, and ``lines_dropped``, how many went (int).

    The first scan counts, the second rewrites; the documents themselves are never shuffled unless the table of hosts
    outgrows Spark's broadcast threshold, and then Spark splits a hot host. Rows are kept even if nothing is left of
    their text. Null texts stay null with 0 dropped; empty texts and blank lines stay; a null host is a host of its
    own; copies of a text within a host, repeated rows included, count as one page, and all of them are rewritten; a host's line needs ``min_pages`` pages, so small hosts lose
    nothing; an empty table gives an empty result; an input column called ``lines_dropped`` is replaced.
    """
    boiler = boilerplate(docs, ratio, min_pages, host_col, text_col)
    # a host has fewer than (mean distinct lines a page) / ratio such lines: the map is bounded by the length of pages, not by their number
    boiler = staged(boiler.groupBy("__host").agg(F.map_from_entries(F.collect_list(F.struct("__key", F.lit(True)))).alias("__boiler")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), _host(F.col(host_col)).alias("__host"), F.split(F.col(text_col), "\n", -1).alias("__lines"))
    kept = F.filter("__lines", lambda x: F.try_element_at("__boiler", F.coalesce(_key(x), F.lit(0))).isNull() | _key(x).isNull())
    out = rows.join(boiler, "__host", "left").withColumn("__kept", F.when(F.col("__boiler").isNotNull(), kept).otherwise(F.col("__lines")))
    text = F.array_join("__kept", "\n").alias(text_col)
    dropped = F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).alias("lines_dropped")
    return out.select(*(text if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns if c != "lines_dropped"), dropped)
