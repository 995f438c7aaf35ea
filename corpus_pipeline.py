"""The corpus pipeline: language ID, line dedup, near duplicates, mixing and packing, each on what the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of ``documents``. Stages decide on narrow rows: line dedup and mixing meet the
documents with a small table of sources where they lie; language ID and near duplicates join the ids that change or go,
which Spark sends to the documents while they are few, and else it shuffles the documents once. What a stage has staged is
deleted when the next one begins.

Null and empty texts: rejected by the first stage, as they hold no letters. Repeated rows: one stays at the third stage.
Rows that share an id or have none but differ are documents of their own. Empty tables: empty results. Extra columns are
carried along to the last stage, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paddock.llm import jaccard, language_id, line_dedup, mixing, packing
from paddock.llm.common import dropped, release, staged, tidy, unstaged, written


def _keyed(docs: DataFrame) -> DataFrame:
    """``__doc, __key``: each row and a key by its content, which all its copies share."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), mixing.content(docs, docs.columns).alias("__key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in whose text a language is found, and writes that language in ``lang``.

    The text model is fitted on the labelled documents; without any label nothing can be told and all stay.
    """
    release(docs)
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    rows = _keyed(docs).select(F.struct("__key", F.col("__doc.lang").alias("lang")).alias("id"), F.col("__doc.text").alias("text"), F.col("__doc.source").alias("source"))
    found = language_id.identify(rows, model, host_col="source", id_col="id")
    changed = found.filter(~F.col("accepted") | ~F.col("language").eqNullSafe(F.col("id.lang")))
    changed = staged(changed.groupBy("id.__key").agg(F.max("accepted").alias("__accepted"), F.min("language").alias("__language")))
    out = _keyed(docs).join(changed, "__key", "left").filter(F.coalesce("__accepted", F.lit(True)))
    return out.select(*(F.coalesce("__language", "__doc.lang").alias("lang") if c == "lang" else F.col(f"__doc.`{c}`") for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; documents stay."""
    release(docs)
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


#: Added to the hashes that stand for ids which are no names: beyond the ids of documents.
BEYOND = 1 << 62


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates.

    An id that several rows have stays with one of them, that of the least content; their other rows, and rows without an
    id, go under a hash of their content. So rows are compared by their texts alone, and copies alike in all columns
    are one document.
    """
    release(docs)
    with tidy(spark):
        whole = _keyed(docs).withColumn("__id", F.col("__doc.doc_id").cast("long"))
        shared = staged(whole.filter("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__least")).filter("__n > 1").drop("__n"))
        joined = whole.join(shared, "__id", "left")
        lone = F.col("__id").isNotNull() & F.col("__least").isNull()
        node = F.when(lone | (F.col("__key") == F.col("__least")), F.col("__id")).otherwise(F.col("__key").bitwiseAND(F.lit(BEYOND // 2 - 1)) + F.lit(BEYOND))
        named = joined.select("__doc", node.alias("__node"), lone.alias("__lone"))
        groups = jaccard.jaccard_components(named.select("__node", F.col("__doc.text").alias("text")), id_col="__node")
        gone = staged(groups.filter("__node <> component_id").select("__node").distinct())
        unstaged(groups)
        kept = named.join(gone, "__node", "left_anti")
        return kept.filter("__lone").unionByName(kept.filter("not __lone").dropDuplicates(["__node"])).select("__doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it does not take go."""
    release(docs)
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 ids."""
    release(docs)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: The stages hash, fit and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        old = path
        docs, path = written(stage(spark, docs, sf_dir))
        if old:
            dropped(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)
