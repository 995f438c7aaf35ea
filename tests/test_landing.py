"""Landed pages: what is written comes back, and what could not be reached is told from what is empty."""

import pytest
from pyspark.sql import functions as F

from paddock.plans import catalogue
from paddock.sources import landing

from .compare import same

PAGES = "page_id long, url string, html string"


def test_query(spark):
    same(spark, catalogue.QUERIES, catalogue.ORACLES, "landed_pages")


@pytest.mark.parametrize(("roll", "batch", "opened"), [(32 << 20, 8 << 20, 16), (10, 5, 1)])
def test_round_trip(spark, tmp_path, monkeypatch, roll, batch, opened):
    """Whatever rolls; null and empty pages, many folders, ids and addresses that are missing."""
    for name, value in (("ROLL", roll), ("BATCH", batch), ("OPEN", opened)):
        monkeypatch.setattr(landing, name, value)
    rows = [(i, f"http://h{i % 5}/é", None if i % 3 == 0 else "" if i % 3 == 1 else f"<p>ü\n{i}</p>") for i in range(60)] + [(None, None, "x")]
    path = f"file://{tmp_path}/landed"
    landing.land(spark.createDataFrame(rows, PAGES).repartition(3), path, F.concat(F.lit("d="), F.col("page_id") % 5))
    got = landing.landed(spark, path, 100)
    assert got.columns == ["folder", "page_id", "url", "attempts", "html"]
    assert sorted(map(str, ((r.page_id, r.url, r.html) for r in got.collect()))) == sorted(map(str, rows))
    assert {r.folder for r in got.collect()} == {f"d={k}" for k in range(5)} | {""}


def test_folders_are_planned(spark, tmp_path):
    """A hot folder is read in several partitions; a filter on folders keeps the files of others out."""
    path = f"file://{tmp_path}/landed"
    rows = [(i, "u", "x" * 1000) for i in range(400)]
    landing.land(spark.createDataFrame(rows, PAGES).repartition(8), path, F.when(F.col("page_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("page_id") % 4)))
    reader = landing.LandedPages({"path": path, "partition_bytes": "20000"}).reader(None)
    every = reader.partitions()
    assert len([p for p in every if any(f == "hot" for f, _ in p.pairs)]) > 3
    assert list(reader.pushFilters([landing.EqualTo(("folder",), "hot"), landing.EqualTo(("page_id",), 3)])) == [landing.EqualTo(("page_id",), 3)]
    assert {f for p in reader.partitions() for f, _ in p.pairs} == {"hot"} and sum(len(p.pairs) for p in reader.partitions()) == sum(f == "hot" for p in every for f, _ in p.pairs)
    hot = landing.landed(spark, path).filter("folder = 'hot' and page_id < 100")
    assert hot.count() == 34


def test_commit_is_whole(spark, tmp_path):
    """A job that fails leaves nothing; one with overwrite takes the place of all."""
    path = f"file://{tmp_path}/landed"
    good = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], PAGES)
    landing.land(good, path, F.lit("f"))
    bad = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("y").cast("string").alias("html"))
    with pytest.raises(Exception, match="lost"):
        landing.land(bad.repartition(4), path, F.lit("f"))
    assert sorted(r.page_id for r in landing.landed(spark, path).collect()) == [1, 2]
    assert not [p for p in (tmp_path / "landed").iterdir() if p.name.startswith("_job")]
    landing.land(good.filter("page_id = 2"), path, F.lit("g"), mode="overwrite")
    assert [tuple(r) for r in landing.landed(spark, path).collect()] == [("g", 2, "b", 1, None)]


def test_fetch_again(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    page = lambda *rows: spark.createDataFrame(list(rows), PAGES)
    landing.land(page((1, "a", None), (2, "b", "x"), (3, "c", None)), path, F.lit("1"))
    landing.land(page((1, "a", None), (3, "c", "late")), path, F.lit("2"))
    got = landing.landed(spark, path)
    assert [tuple(r) for r in landing.to_fetch_again(got).collect()] == [(1, "a", 2)]
    assert landing.to_fetch_again(got, 2).count() == 0
    assert sorted(tuple(r) for r in landing.latest(got).collect() if r.page_id > 1) == [(2, "b", 1, "x"), (3, "c", 2, "late")]
    found = landing.found_on(landing.latest(got), spark.createDataFrame([(3,), (3,)], "page_id long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, False, None), (2, True, 0), (3, True, 2)]


def test_nothing_landed(spark, tmp_path):
    assert landing.landed(spark, f"file://{tmp_path}/none").count() == 0
