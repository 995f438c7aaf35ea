"""What near-duplicate detection keeps on disk, and which tokens it deals out."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import common, jaccard
from paddock.llm.common import written

from ..compare import SF
from .test_operators import awkward, docs_of


def shuffled(spark):
    """The shuffle files there are."""
    return {f.name for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}


@pytest.mark.parametrize("run", [jaccard.jaccard_components, lambda d: corpus_pipeline.near_duplicates(d.sparkSession, d, SF)])
def test_steps_leave_no_files(spark, run):
    """Shuffle files and staged tables of a step go when it is done, not when the driver collects its garbage."""
    docs = written(docs_of(spark, awkward()))[0]
    files, folders, setting = shuffled(spark), set(common._FOLDERS), spark.conf.get(common.CLEANUP)
    found = run(docs)
    assert not shuffled(spark) - files
    assert len(set(common._FOLDERS) - folders) <= 8  # what the result reads, and tables of a few rows
    assert spark.conf.get(common.CLEANUP) == setting
    assert found.count() > 0


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_shared_tokens(spark, monkeypatch, held):
    """Those first tokens that occur elsewhere and no others, however many there are and however few a task gathers."""
    monkeypatch.setattr(jaccard, "DEALT", held)
    rows = [r for r in awkward() if r[0] is not None]
    sets = [(i, jaccard._WORDS.shingles(t or "", 5)) for i, t, _, _ in rows]
    firsts = [(i, len(s), jaccard._first(s, 80).astype("int64").tolist()) for i, s in sets]
    often = Counter(t for _, _, f in firsts for t in f)
    wanted = Counter((t, i, n) for i, n, f in firsts for t in f if often[t] > 1)
    got = jaccard._shared_tokens(docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text"), 5, 80).collect()
    assert Counter((r.token, r.id, r.n) for r in got) == wanted
