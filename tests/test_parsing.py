"""Parsers, chains, model documents, streaming and sinks on small fixtures."""

import base64
import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from paddock.functions import names, parsing, scoring
from paddock.operators import breeding, career, merge, models, pedigree, ratings
from paddock.plans import nightly
from paddock.sources import pages, schemas, sinks
from paddock.streaming import incremental


def values(spark, texts, make):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("t"))).collect()]


CASES = [
    (parsing.km_seconds, {"1'14\"6": 74.6, "1.14.6": 74.6, "13.3": 73.3, "13": 73.0, "1'14\"65": 80.5, "r.p.": None, "": None, None: None}),
    (names.canonical_name, {"muscle  hill": "MUSCLE HILL", "a​b": "A B", "a b ": "A B", "": "", None: None}),
    (parsing.iso_date, {"5/3/2024": "2024-03-05", "2024-3-5": "2024-03-05", "05-03-2024": "2024-03-05", "junk": None, None: None}),
    (parsing.lenient_number, {"2.150,50": 0.0, "1.500": 1.5, "x": 0.0, None: 0.0}),
    (parsing.local_number, {"2.150,50": 2150.5, "": 0.0, "x": 0.0}),
    (parsing.placement, {"3°": 3, "3º": None, "3": None, "rit.": None}),
    (lambda c: parsing.placement(c, parsing.RESULT_MARK), {"3º": 3, "3°": None}),
    (parsing.is_money, {"2.150,50": True, "7": False, "A": False, None: False}),
    (parsing.quoted_time, {"1.14.6": "1'14\"6", "14.6": None, "": None}),
    (parsing.placed_time, {"1.14.6": "1.14.6", "rit.": None, "": None}),
    (lambda c: names.race_code(F.lit("d"), c, F.lit("T"), F.lit("4")), {"77": "d_77", "": "d_T_4", None: "d_T_4"}),
    (lambda c: scoring.runner_grade(c.cast("double")), {"97": "SSS", "96.99": "SS", "90": "SS", "80": "S", "65": "A", "50": "B", "35": "C", "20": "D", "10": "E", "9.99": "F"}),
    (lambda c: scoring.volume_multiplier(c.cast("int")), {"1": 0.4, "2": 0.55, "3": 0.65, "4": 0.75, "5": 0.85, "9": 0.85, "10": 0.92, "19": 0.92, "20": 0.97, "49": 0.97, "50": 1.0, "0": 0.85}),
    (lambda c: scoring.half_up(c.cast("double")), {"-2.5": -2.0, "2.5": 3.0}),
    (lambda c: parsing.url_value(c, "k"), {"x?k=a+b%20c&l=1": "a b c", "x?l=1": None, "": None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_values(spark, case):
    make, wanted = CASES[case]
    got = values(spark, list(wanted), make)
    assert got == [pytest.approx(w) if isinstance(w, float) else w for w in wanted.values()]


def test_marker_and_parents(spark):
    texts = {
        "INCREDIBLE RUN f.i.3 UP FRONT LARRY / ANGELIQUE carriera1004972,40": (("F", "ITA", 3), ("UP FRONT LARRY", "ANGELIQUE")),
        "X (m.e.12) some text PADRE BI / a3 / MADRE D'OR cat.mc": (("M", "EST", 12), ("PADRE BI", "MADRE D'OR")),
        "f.i.3 " + "x" * 210 + " LATE / NAME now": (("F", "ITA", 3), (None, None)),
        "xm.i.5 m.i.123 nothing": ((None, None, None), (None, None)),
        "": ((None, None, None), (None, None)),
        None: ((None, None, None), (None, None)),
    }
    assert [tuple(r) for r in values(spark, list(texts), parsing.sex_country_age)] == [w for w, _ in texts.values()]
    assert [tuple(r) for r in values(spark, list(texts), parsing.parents)] == [w for _, w in texts.values()]


def test_profiles_read_a_page_once(spark):
    """The text of a page is made once, not anew for each field and element that looks at it."""
    frame = spark.createDataFrame([("a", "<p>X m.i.3 SIRE A / DAM B</p> carriera")], "name string, html string")
    read = pages.career_profiles(frame, F.lit("2024-06-01").cast("date"))
    assert tuple(read.first()) == ("A", "M", "ITA", 2021, "SIRE A", "DAM B")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("(?s)<[^>]*>") == 1


def test_bare_tags_are_not_searched(monkeypatch):
    """Attributes are looked for only in tags that go on after their name."""
    asked, look = [], pages._attributes
    monkeypatch.setattr(pages, "_attributes", lambda html, at, known: asked.append(at) or look(html, at, known))
    read = pages._Rows("<table><tr><td>1</td><td class='a'>2</td><td/></tr></table>")
    assert read.found[0][4] == ["1", "2", ""] and read.found[0][5] == [[], ["a"], []] and len(asked) == 2


def test_header_races(spark):
    """The first table alone, each page by itself though names repeat."""
    html = "<table><tr><th>Data</th><th>Pista</th><th>Pos</th><th>Premio</th></tr><tr><td>5/3/2024</td><td>Roma</td><td>2</td><td>100,5</td></tr><tr><td>no</td><td>x</td><td>y</td></tr></table><table><tr><td>6/3/2024</td><td>a</td><td>b</td></tr></table>"
    got = pages.header_races(spark.createDataFrame([("n", html), ("n", html), ("m", ""), ("m", None)], "name string, html string")).collect()
    assert [(r.horse_name, r.race_date, r.track, r.placement, r.prize_net) for r in got] == [("N", "2024-03-05", "Roma", 2, 100.5)] * 2


def test_links(spark):
    html = '<a href="horse.php?anno=2015">foo bar</a><a href="/cavallo/x">Baz (2011)</a><a href="http://q/cavallo">z</a><a href="http://q/Cavallo/y">Foo Bar</a><a>none</a>'
    got = {tuple(r) for r in pages.horse_links(spark.createDataFrame([(1, html), (2, html)], "page_id int, html string"), "http://h/").collect()}
    assert got == {("FOO BAR", 2015, "http://h/horse.php?anno=2015"), ("BAZ (2011)", 2011, "http://h/cavallo/x"), ("FOO BAR", None, "http://q/Cavallo/y")}
    index = '<a id="link_risultati" href="r.php?data=2024-03-05&amp;sigla=RM&amp;ippodromo=ROMA+CAP%20X">z</a><a href="r.php?data=2024-03-05">other</a><a id="link_risultati" href="r.php">none</a>'
    got = [tuple(r) for r in pages.meetings(spark.createDataFrame([(index,)], "html string"), "http://h/").collect()]
    assert got == [("2024-03-05", "RM", "ROMA CAP X", "", "http://h/hRis.php?data=2024-03-05&sigla=RM&ippodromo=ROMA+CAP%20X")]


def test_pedigree_pages(spark):
    script = lambda s: f'<script src="data:text/javascript;base64,{base64.b64encode(s.encode()).decode()}"></script>'
    call = "populateTableWithJSON( [{\"p\":{\"nome\":\"sire  one\"}},{\"m\":{\"nome\":\"dam\"}},{\"mp\":{\"nome\":\"\"}}] , 'cavallo')"
    got = pages.pedigree_pages(spark.createDataFrame([("a", '<script src="data:text/javascript;base64,!!"></script>' + script("x()") + script(call)), ("b", ""), ("c", None)], "name string, html string")).collect()
    assert [(r.name, r.sire, r.dam, r.dam_dam) for r in got] == [("a", "SIRE ONE", "DAM", None), ("b", None, None, None), ("c", None, None, None)]


def test_nationality_and_flag(spark):
    frame = spark.createDataFrame([("swe", "x"), (None, "Muscle Hill"), ("", "nobody"), ("XX", "x"), (None, None), ("SF", None)], "n string, m string")
    got = [tuple(r) for r in frame.select(names.nationality(F.col("n"), F.col("m")), names.flag(F.col("n"), F.col("m")), names.country_name(F.col("n"))).collect()]
    assert got == [("SWE", "🇸🇪", "Svezia"), ("USA", "🇺🇸", None), ("ITA", "🇮🇹", ""), ("XX", "", "XX"), ("ITA", "🇮🇹", None), ("SF", "🇫🇮", "Finlandia")]


def test_universe_of_ratings(spark):
    """A runner without placed runs is neither compared nor rated; one without a year of birth is compared."""
    rows = [("a", 2000, "s", 2, 1, 100.0, 75.0), ("b", 2000, " S", 0, 0, 0.0, 70.0), ("c", None, "S ", 1, 0, 50.0, 74.0)]
    got = ratings.rate(spark.createDataFrame(rows, "name string, birth_year int, sire string, career_races int, career_wins int, career_earnings double, record_seconds double")).collect()
    assert [(r.name, r.earn_percentile, r.time_percentile, r.sire, r.sire_percentile) for r in got] == [("a", 100.0, 50.0, "S", 100.0)]


def test_names_meet_in_any_spelling(spark):
    horses = spark.createDataFrame([("A", "b ", " C", 2000), ("B", "d", None, 1990), ("c", None, "e", 1991), ("C", None, None, 1970)], "name string, sire string, dam string, birth_year int")
    got = {r.name: (r.sire_sire, r.dam_dam) for r in pedigree.grandparents(horses).collect()}
    assert got == {"A": ("d", "e"), "B": (None, None), "c": (None, None), "C": (None, None)}
    runs = spark.createDataFrame([(1, "a  ", 1, "1.14.6", 10.0), (2, " A", None, "1.13.0", 9.0)], "id int, horse_name string, placement int, time_km string, prize_net double")
    one = career.careers(horses.filter("name = 'A'"), runs).first()
    assert (one.career_races, one.career_wins, one.career_earnings, one.record_career, one.record_seconds) == (1, 1, 10.0, "1.13.0", 73.0)


def test_keyed_updates(spark):
    rows = spark.createDataFrame([("A b", 1, "x"), ("c", 2, "y"), (None, 3, "z")], "name string, n int, t string")
    changes = spark.createDataFrame([("a  B", 10, None), ("nobody", 9, "q")], "name string, n int, t string")
    assert {tuple(r) for r in merge.keyed_update(rows, changes, ["name"], overwrite=False, by=names.canonical_name).collect()} == {("A b", 10, "x"), ("c", 2, "y"), (None, 3, "z")}
    assert {tuple(r) for r in merge.keyed_update(rows, changes, ["name"], by=names.canonical_name).collect()} == {("A b", 10, None), ("c", 2, "y"), (None, 3, "z")}
    queue = spark.createDataFrame([("a", "pending", None), ("b", "done", "2000-01-01")], "name string, backfill_status string, last_backfill_at string")
    assert {tuple(r) for r in merge.set_status(queue, F.col("name") == "a", F.lit("done"), F.lit("2001-01-01")).collect()} == {("a", "done", "2001-01-01"), ("b", "done", "2000-01-01")}


RACES = "horse_name string, race_date date, track string, placement int, time_km string, distance int, driver string, prize_net double, race_code string"
DAY = datetime.date(2024, 1, 1)


def test_missing_results(spark):
    """A meeting with three runners stored is left alone, the runners of another are read and inserted."""
    have = spark.createDataFrame([(f"H{i}", DAY, "Roma ", 1, "", 0, "", 0.0, f"r{i}") for i in range(3)] + [("A", DAY, "TORINO", 1, "", 0, "", 0.0, "r9")], RACES)
    meetings = spark.createDataFrame([("2024-01-01", "RM", "ROMA", "", "u1"), ("2024-01-01", "TO", "Torino", "", "u2")], "data string, sigla string, ippodromo string, note_giorno string, url string")
    page = '<div id="dati_corsa"><table id="tabella_risultati"><tr><td class="piaz">1º</td><td class="nome_cav">a</td></tr><tr><td class="piaz">2º</td><td class="nome_cav">bb</td></tr></table></div>'
    page = page.replace(">a<", ">Aa<")
    after = nightly.missing_results(have, meetings, spark.createDataFrame([("u1", page), ("u2", page)], "url string, html string"))
    assert sorted((r.horse_name, r.track, r.placement) for r in after.collect() if r.race_code.startswith("2024")) == [("AA", "TORINO", 1), ("BB", "TORINO", 2)]
    assert after.count() == 6
    assert nightly.missing_results(after, meetings, spark.createDataFrame([("u2", page)], "url string, html string")).count() == 6


def test_full_careers(spark):
    horses = spark.createDataFrame([("A", None, "ITA", 2019, "OLD", None)], "name string, sex string, country string, birth_year int, sire string, dam string")
    row = '<tr><td><a href="g.php?data=%s&amp;ippod=to&amp;codice=%d">x</a></td><td></td><td>%s</td><td>1600</td><td>1.14.6</td><td></td><td>50</td></tr>'
    html = "A m.e.4 SIRE X / DAM Y carriera <table>" + row % ("2024-01-01", 7, "1°") + row % ("2023-01-01", 8, "2°") + row % ("2010-01-01", 9, "1°") + "</table>"
    have = spark.createDataFrame([("A", DAY, "TO", 1, "1.20.0", 0, "", 10.0, "old")], RACES)
    merged, races = nightly.full_careers(horses, have, spark.createDataFrame([(" a", html)], "name string, html string"), F.lit("2024-06-01").cast("date"))
    one = merged.first()
    assert (one.sex, one.country, one.birth_year, one.sire, one.dam, one.career_races, one.career_wins, one.career_earnings, one.record_career) == ("M", "EST", 2020, "SIRE X", "DAM Y", 2, 1, 60.0, "1'14\"6")
    assert races.count() == 2


def test_model_documents(spark, tmp_path):
    """Trained models, written as a document, read back and scored by columns, give what the models themselves predict."""
    rows = [(f"n{i}", "ABCDEF"[i % 6], float(i % 37), *(float((i * (k + 3)) % 101) for k in range(12))) for i in range(300)]
    frame = spark.createDataFrame(rows, "name string, grade string, score double, " + ", ".join(f"{f} double" for f in breeding.FEATURES))
    regressor, classifier, figures = breeding.train(frame, rounds=4, folds=2)
    middle = {f: 50.0 for f in breeding.FEATURES}
    earnings = spark.createDataFrame([("A", 100.0, 3), ("F", None, 1)], "grade string, avg_earnings double, n long")
    text = models.document(regressor, classifier, figures, middle, earnings, "2024-01-01T00:00:00Z")
    path = str(tmp_path / "model")
    models.write_model(spark, text, path)
    model = models.read_model(spark, path)
    info = models.model_info(model).first()
    assert info.available and info.n_samples == 300 and set(info.feature_importances) == set(breeding.FEATURES)
    sides = models.importance_sides(model).first()
    assert sides.sire_share + sides.dam_share == pytest.approx(100, abs=0.02)
    assert json.loads(text)["grade_thresholds"][0] == [97, "SSS"]
    one = model.select(*(F.struct(F.col(f"{k}.init").alias("i"), F.col(f"{k}.learning_rate").alias("r"), models.heaps(F.col(f"{k}.trees")).alias("t")).alias(k) for k in ("score_model", "poor_model")))
    x = F.array(*breeding.FEATURES)
    from pyspark.ml.feature import VectorAssembler

    features = VectorAssembler(inputCols=list(breeding.FEATURES), outputCol="x").transform(frame)
    ours = {r.name: (r.s, r.p) for r in frame.join(F.broadcast(one)).select("name", breeding.ensemble(x, F.col("score_model.t"), F.col("score_model.i"), F.col("score_model.r")).alias("s"), scoring.sigmoid(breeding.ensemble(x, F.col("poor_model.t"), F.col("poor_model.i"), F.col("poor_model.r"))).alias("p")).collect()}
    theirs = {r.name: r.prediction for r in regressor.transform(features).select("name", "prediction").collect()}
    chance = {r.name: float(r.probability[1]) for r in classifier.transform(features).select("name", "probability").collect()}
    assert ours == {n: (pytest.approx(theirs[n]), pytest.approx(chance[n])) for n in theirs}
    fees = spark.createDataFrame([("s", 10.0)], "name string, stud_fee_eur double")
    scored = models.score_pairs(frame.limit(5).drop("grade").withColumn("stallion", F.lit(" S")).withColumn("s_time", F.lit(None).cast("double")), model, fees).collect()
    assert len(scored) == 5 and all(r.missing_data == ["s_time"] and r.stud_fee == 10.0 for r in scored)


def test_streaming_ingest(spark, tmp_path):
    """Batches are merged once: repeats within a batch, of other batches, and of a batch that is run again change nothing."""
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    kinds = "horse_name string, race_date date, race_code string, id long, arrived_at timestamp"
    at = datetime.datetime(2024, 1, 2)

    def arrive(rows):
        spark.createDataFrame([(*r, at) for r in rows], kinds).coalesce(1).write.mode("append").parquet(source)
        incremental.ingest(spark.readStream.schema(kinds).parquet(source), table, str(tmp_path / "checkpoint")).start().awaitTermination()
        return sorted((r.horse_name, r.id) for r in spark.read.parquet(table).collect())

    assert arrive([("a", DAY, "x", 1), ("a", DAY, "y", 2), ("b", DAY, "x", 3)]) == [("a", 1), ("b", 3)]
    assert arrive([("a", DAY, "z", 4), ("c", DAY, None, 5)]) == [("a", 1), ("b", 3), ("c", 5)]
    assert arrive([("c", DAY, None, 6)]) == [("a", 1), ("b", 3), ("c", 5)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("è", None, 1), ("b", 2.5, 2)], "name string, x double, year int")
    sinks.write_csv(frame.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.splitlines()[0] == "﻿name,x,year" and "è" in text
    sinks.write_json(frame.coalesce(1), str(tmp_path / "json"))
    assert [json.loads(x) for x in next((tmp_path / "json").glob("part-*")).read_text().splitlines()][0] == {"name": "è", "x": None, "year": 1}
    assert json.loads(sinks.as_json(frame).first().json) == {"name": "è", "x": None, "year": 1}
    for _ in range(2):
        sinks.write_table(frame, str(tmp_path / "table"), ("year",))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    sinks.snapshot(frame, str(tmp_path / "versions"), "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.snapshot(frame, str(tmp_path / "versions"), "1")


def test_tables(spark):
    """Conforming casts or nulls, adds and drops; the seed stands in for an empty table; inline rows keep their order."""
    loose = spark.createDataFrame([("a", "2000", "x"), ("b", "soon", "y")], "name string, birth_year string, other string")
    got = schemas.conform(loose, "horses")
    assert got.columns == schemas.schema("horses").names and [r.birth_year for r in got.collect()] == [2000, None]
    one = schemas.inline_rankings(spark, [("B", "1", 3, 10, 2, 5, *[0] * 12), ("A", "2", 4, 20, 1, 6, *[0] * 12)])
    assert [(r.name, r.ord, r.first_letter) for r in one.orderBy("ord").collect()] == [("B", 0, "B"), ("A", 1, "A")]
    assert schemas.seeded(one.limit(0), one).count() == 2 and schemas.seeded(one.limit(1), one).count() == 1


def test_cells_of_several_classes(spark):
    """Any of a cell's classes names it; th cells don't."""
    row = lambda name, more: f'<tr><th class="nome_cav">X Y</th><td class="piaz{more}">2º</td><td class="nome_cav_u{more}">{name}</td><td class="{more} premio_u">1.000,5</td></tr>'
    html = '<div id="dati_corsa"><table id="tabella_risultati">' + row("one", "") + row("two", " bold") + "</table></div>"
    got = pages.result_rows(spark.createDataFrame([("2024-01-01", "t", "RM", html)], "race_date string, track string, sigla string, html string")).collect()
    assert [(r.name, r.placement, r.prize) for r in got] == [("ONE", 2, 1000.5), ("TWO", 2, 1000.5)]


def test_labels_without_a_sound_value(spark):
    """The first sound value after any place of any label counts."""
    html = "Nato nel mese di maggio. Anno di nascita: 1999 Padre di molti. Padre: VARENNE Madre: IDEA Anno Record: nessuno Record: 1'12\"5 Paese: ignoto Nazionalità: FRA"
    rows = [("a", html), ("b", "Padre: A1 Madre: lower Anno Nato nel 20x4 Nato nel 2011"), ("c", ""), ("d", None), ("e", "Padre: SOLO Padre: L'ALTRO B Anno Madre:  Anno")]
    got = {r.name: tuple(r)[1:] for r in pages.detail_profile(spark.createDataFrame(rows, "name string, html string")).collect()}
    assert got["a"] == (1999, None, "FRA", "VARENNE", "IDEA", "1'12\"5")
    assert got["b"] == (2011, None, None, None, None, None) and got["c"] == got["d"] == (None,) * 6
    assert got["e"] == (None, None, None, "L'ALTRO B", None, None)


def test_career_rows_led_by_a_th(spark):
    cells = '<td><a href="?data=2024-01-02&amp;ippod=rm&amp;codice=7">x</a></td><td>RM</td><td>3\u00b0</td><td>1600</td><td>1.14.2</td><td></td><td>100</td>'
    html = f'<table><tr><th><a href="?data=1999-01-01">n</a></th>{cells}</tr><tr>{cells}</tr><tr><th>a</th><th>b</th><th>c</th><th>d</th><th>e</th><td><a href="?data=2024-01-03">x</a></td></tr></table>'
    got = pages.career_races(spark.createDataFrame([("n", html)], "name string, html string")).collect()
    assert [(str(r.race_date), r.placement, r.distance, r.time_km, r.prize_net) for r in got] == [("2024-01-02", 3, 1600, "1'14\"2", 100.0)] * 2


def test_tokens():
    """Quotes, cases, references, scripts, and what is never closed."""
    html = "<!DOCTYPE x>a &lt; <B Id='q\">' CLASS=x&amp;y checked>b</b><br/>1 < 2<script>if (a<b) '</p>'</SCRIPT>c<!-- <p> -->d</ x>e<?f?><p title=\"g"
    assert list(pages._tokens(html)) == [
        ("text", "a < ", {}), ("start", "b", {"id": 'q">', "class": "x&y", "checked": ""}), ("text", "b", {}), ("end", "b", {}), ("start", "br", {}), ("end", "br", {}), ("text", "1 < 2", {}),
        ("start", "script", {}), ("end", "script", {}), ("text", "c", {}), ("text", "d", {}), ("text", "e", {}),
    ]


@pytest.mark.parametrize("part", ["<", "<!--", "<!", "<?", "<a ", "</", "</a ", "<![", "&", "<a b='", "<a b=\"'", "<script>", "<td class=", "<![CDATA[", "< a='\" ", "<style></"])
def test_markup_that_is_never_closed(spark, part):
    """A page of 5 MB in time by its length, and no page ends the job."""
    page = "<table><tr><td>1</td></tr></table> word " + part * (5_000_000 // len(part))
    began = time.monotonic()
    assert pages._Rows(page).found[0][4] == ["1"]
    assert spark.createDataFrame([(page,)], "html string").select(F.substring(pages.page_text(F.col("html")), 1, 6)).first()[0] == "1 word"
    assert time.monotonic() - began < 20
