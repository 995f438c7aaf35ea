"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import jaccard
from paddock.llm.common import written

from ..compare import SF
from .test_operators import awkward, docs_of


def staged(spark, docs):
    """Each stage's rows, written and read again as the next one's."""
    out = [written(docs)[0]]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF))[0])
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, told, lined, single, mixed, packed = staged(spark, docs)
    for frame in (told, lined, single, mixed):
        assert frame.columns == start.columns and frame.schema.fields[0].dataType == start.schema.fields[0].dataType
    clean = start.filter("n_chars > 200 and lang is not null")
    assert told.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    assert Counter(r[0] for r in lined.select("doc_id").collect()) == Counter(r[0] for r in told.select("doc_id").collect())
    groups = jaccard.jaccard_components(lined)
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").distinct().collect()}
    assert single.groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in mixed.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_odd_rows(spark):
    docs = docs_of(spark, awkward())
    for frame in staged(spark, docs)[1:]:
        frame.count()
    for frame in staged(spark, docs.limit(0)):
        assert frame.count() == 0


def test_rows_that_share_an_id(spark):
    """Unlike texts under one id, or under none, all stay; copies and near copies go, whatever order the rows come in."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(100))
    rows = [(1, text("a"), "en", "s"), (1, text("b"), "en", "s"), (2, text("c"), "en", "s"), (2, text("c"), "en", "s"), (None, text("d"), "en", "s"), (None, text("e"), "en", "s"), (3, text("b") + " x", "en", "s"), (4, text("f"), "en", "s")]
    found = []
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.near_duplicates(spark, written(docs_of(spark, order))[0], SF)
        assert kept.columns == docs_of(spark, rows).columns
        found.append(Counter((r.doc_id, r.text) for r in kept.collect()))
    assert found[0] == found[1]
    assert set(found[0].values()) == {1}
    assert {t[:2] for _, t in found[0]} == {"a0", "b0", "c0", "d0", "e0", "f0"} and len(found[0]) == 6


def test_a_copy_of_each_document_survives(spark):
    """Six copies of a text in a source of 106: one of them comes out, whole."""
    text = lambda k: "\n".join(" ".join(f"{k}{i}{j}" for j in "abcdefgh") for i in range(12))
    rows = [(i, text(f"p{i}x"), "en", "s") for i in range(100)] + [(500 + i, text("copied"), "en", "s") for i in range(6)]
    docs = written(docs_of(spark, rows))[0]
    lined = written(corpus_pipeline.lines(spark, docs, SF))[0]
    single = written(corpus_pipeline.near_duplicates(spark, lined, SF))[0]
    mixed = corpus_pipeline.mixture(spark, single, SF).select("doc_id", "text").distinct().collect()
    assert {r.doc_id: r.text for r in mixed} == {i: t for i, t, *_ in rows[:101]}
