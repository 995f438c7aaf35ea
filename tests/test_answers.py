"""Stored orders, indexes, ancestors, figures: against plain Python, at sizes and with values that the tables do not have."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paddock.operators import figures, pedigree, ranges, ratings, search
from paddock.plans import catalogue, nightly

from .compare import SF

NAMES = ["Varenne", "VARENNE II", "Ideale Luis", "à la Fête", "Ourasi", "a", "", "ab", None, "50% off_x", "Sharif di Iesolo", "Iesolo"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(i, n, i % 3) for i, n in enumerate(NAMES * 2)] + [(1000 + i, f"horse {i:04d}", 0) for i in range(300)]
    return rows, search.build(spark.createDataFrame(rows, "id int, name string, more int").repartition(3), "name", f"file://{tmp_path_factory.mktemp('index')}")


def like(term, name):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.lower())
    return name is not None and re.search(pattern, name.lower(), re.DOTALL) is not None


@pytest.mark.parametrize("term", ["varenne", "IESOLO", "ii", "è", "fêt", "re%ii", "_arenne", "e l", "50%", "%%", "a_", "horse 01", "0299", "nobody", "b", "", "o%9", "e di ies", "f_x"])
def test_search(spark, index, term):
    rows, made = index
    got = search.search(spark, made, term)
    assert got.columns == ["id", "name", "more"]
    assert sorted(r.id for r in got.collect()) == [i for i, n, _ in rows if len(term) >= 2 and like(term, n)]


def test_search_reads_few_folders(spark, index):
    plan = search.search(spark, index[1], "horse 0123")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(__folder" in plan or "PartitionFilters: [isnotnull(__folder" in plan
    assert "__folder#" in plan and "gram IN" in plan or "gram#" in plan
    none = search.search(spark, index[1], "no such name")
    assert none.count() == 0


def test_grams_are_written_when_looked_up(spark, tmp_path):
    """A search without a gram needs the rows alone; the first with one writes the grams, and a second finds them."""
    from pathlib import Path

    made = search.build(spark.createDataFrame([(i, f"horse {i:04d}") for i in range(50)], "id int, name string"), "name", f"file://{tmp_path}/index")
    assert search.search(spark, made, "0%4").count() == sum("4" in f"{i:04d}"[1:] for i in range(50)) and not Path(tmp_path, "index/grams").exists()
    for _ in range(2):
        assert [r.id for r in search.search(spark, made, "e 0017").collect()] == [17]
    assert spark.read.parquet(f"file://{tmp_path}/index/grams").filter("gram = 'hor'").count() == 50


@pytest.mark.parametrize(("page", "limit"), [(1, 7), (3, 7), (40, 25), (1000, 1), (0, 5), (41, 25), (10_000, 3)])
def test_pages(spark, tmp_path, page, limit):
    r = random.Random(9)
    rows = [(f"n{i}", r.choice([None, 1.0, 2.0, 2.5]), r.choice(["x", "y", None])) for i in range(1000)]
    frame = spark.createDataFrame(rows, "name string, score double, kind string").repartition(4)
    stored = ranges.store_ranked(frame, f"file://{tmp_path}/ranked", [("score", False), ("name", True)], ["kind"], 7)
    for facets, test in (({}, None), ({"kind": "x"}, None), ({"kind": None}, None), ({}, F.col("name").endswith("7"))):
        kept = [x for x in rows if all(x[2] == v for v in facets.values()) and (test is None or x[0].endswith("7"))]
        kept.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        wanted = [(x[0], i + 1, len(kept), -(-len(kept) // limit)) for i, x in enumerate(kept)][max(0, (page - 1) * limit) : max(0, page * limit)] if page > 0 else []
        got = ranges.page(spark, stored, page, limit, facets, test)
        assert [(x["name"], x["rank"], x["total"], x["pages"]) for x in got.collect()] == wanted


def test_a_page_reads_its_ranges(spark, tmp_path):
    stored = ranges.store_ranked(spark.range(20_000).withColumn("k", F.col("id") % 2), f"file://{tmp_path}/ranked", [("id", True)], ["k"], 8)
    deep = ranges.page(spark, stored, 390, 50)
    every = {f.split("__range=")[1].split("/")[0] for f in spark.read.parquet(f"{stored.path}/rows").inputFiles()}
    asked = re.findall(r"PartitionFilters: \[isnotnull\(__range#\d+\), \(__range#\d+ = (\d+)\)\]", deep._jdf.queryExecution().executedPlan().toString())
    assert len(every) == 8 and len(set(asked)) == 1
    assert [r.id for r in deep.collect()] == list(range(19_450, 19_500))


@pytest.mark.parametrize("years", [[2001], [None], [2000, 2001, None]])
def test_running_and_years(spark, years):
    """One year with all rows, the missing one too, and ties."""
    r = random.Random(3)
    rows = [(i, r.choice(years), r.choice([None, -1.0, 0.0, 1.0, 2.0, 3.5, float(i)])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, birth_year int, v double")
    for higher in (True, False):
        got = {x.id: x.p for x in ratings.share_of_year(frame, "v", "p", F.lit(True), higher_is_better=higher).collect()}
        for i, y, v in rows:
            same = [w for _, z, w in rows if z == y and w is not None and w > 0]
            wanted = round(100 * sum(w <= v if higher else w >= v for w in same) / len(same) + 1e-9, 2) if v is not None and v > 0 else 0
            assert got[i] == pytest.approx(wanted, abs=0.011)
    summed = ranges.running(frame.select("birth_year", "id"), ["birth_year"], [F.col("id")], {"n": F.lit(1), "s": F.col("id").cast("long")}, 5)
    for x in summed.collect():
        mine = [i for i, y, _ in rows if y == x.birth_year]
        assert (x.n, x.s, x.n_all) == (sum(i <= x.id for i in mine), sum(i for i in mine if i <= x.id), len(mine))
    assert ranges.running(frame.limit(0), ["birth_year"], [F.col("id")], {"n": F.lit(1)}).count() == 0


def test_ancestors(spark):
    """To the depth asked, through other spellings, and out of cycles; a depth of two is what ``grandparents`` finds."""
    rows = [("A", " b", "C"), ("B", "D", None), ("C", "D", "E"), ("D", "F", ""), ("F", "A", "G"), ("X", "X", None), (None, "A", "B")]
    horses = spark.createDataFrame(rows, "name string, sire string, dam string")
    got = Counter((r.name, r.path, r.ancestor) for r in pedigree.ancestors(horses, 9).collect())
    mine = {(p, a) for n, p, a in got if n == "A"}
    assert mine == {("s", " b"), ("d", "C"), ("ss", "D"), ("ds", "D"), ("dd", "E"), ("sss", "F"), ("dss", "F"), ("sssd", "G"), ("dssd", "G")}
    assert not [1 for n, *_ in got if n == "X"] and max(got.values()) == 1
    two = {(r.name, r.path): r.ancestor for r in pedigree.ancestors(horses, 2).collect()}
    places = {"sire": "s", "dam": "d", "sire_sire": "ss", "sire_dam": "sd", "dam_sire": "ds", "dam_dam": "dd"}
    for r in pedigree.grandparents(horses.filter("name is not null and name <> 'X'")).collect():
        for c, p in places.items():
            assert (r[c] or None) == two.get((r["name"], p))
    some = pedigree.ancestors(horses, 1, horses.filter("name = 'C'"))
    assert sorted(tuple(r) for r in some.collect()) == [("C", "d", "E"), ("C", "s", "D")]
    with pytest.raises(ValueError):
        pedigree.ancestors(horses, 0)


def test_figures_are_the_evaluators(spark):
    """With ties, nulls, and one label alone."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator

    r = random.Random(5)
    rows = [(float(r.random() < 0.4), r.choice([0.1, 0.2, r.random()]), r.gauss(0, 1), r.gauss(0, 1)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "label double, score double, y double, p double").repartition(5)
    area = figures.area_under_curve(frame, "label", "score").first()
    assert area.n == 2000 and area.auc == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(frame), abs=1e-9)
    told = figures.r2(frame, "y", "p").first()
    assert told.n == 2000 and told.r2 == pytest.approx(RegressionEvaluator(labelCol="y", predictionCol="p", metricName="r2").evaluate(frame), abs=1e-9)
    odd = spark.createDataFrame([("a", 1.0, 0.5), ("a", 1.0, 0.6), ("b", 0.0, None), ("b", None, 0.1), ("c", 0.0, 0.5), ("c", 1.0, 0.5)], "k string, label double, score double")
    assert {r.k: r.auc for r in figures.area_under_curve(odd, "label", "score", ["k"]).collect()} == {"a": None, "c": 0.5}
    assert {r.k: r.r2 for r in figures.r2(odd, "label", "score", ["k"]).collect()} == {"a": None, "c": 0.0}


def test_nightly_counts_while_it_writes(spark, tmp_path):
    """Each mode; the merged tables are where they were to be written."""
    from paddock.plans import adapter as a

    horses, races = a.horses(spark, SF), a.races(spark, SF)
    old_h, old_r, new = horses.filter("key % 4 <> 1"), races.filter("id % 3 = 0"), races.filter("id % 3 <> 0")
    for mode in ("results", "maintenance", "full"):
        root = f"file://{tmp_path}/{mode}"
        done = nightly.nightly(old_h, old_r, new, a.rankings(spark, SF), F.lit(a.AS_OF).cast("date"), mode, "1995-06-01", root)
        counted = done.counters.first()
        assert (counted.horses_before, counted.races_before) == (old_h.count(), old_r.count())
        assert (counted.horses, counted.races) == (spark.read.parquet(f"{root}/horses").count(), spark.read.parquet(f"{root}/races").count())
        assert (counted.races > counted.races_before) == (mode != "maintenance") and (done.ratings is None) == (mode == "results")
        assert "__known" not in done.races.columns
    with pytest.raises(ValueError):
        nightly.nightly(old_h, old_r, new, new, F.lit(None), "none")
    assert catalogue.QUERIES["nightly_counters"]
