"""Queries over pages: the tables are written as the pages that the parsers know, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing as fp
from ..session import shared_path, table
from ..sources import landing, pages
from . import adapter as a
from .registry import query

CAREER_ROW = '<tr>%s<td><a href="g.php?data=%s&amp;ippod=rm&amp;codice=%d&amp;n_corsa=%d">x</a></td><td>2^RM</td><td>%d%s</td><td>%d m</td><td>1.%d.%d</td><td></td><td>%d</td></tr>'


def career_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page a customer with its orders for races: the marker and the parents, then the table, of which some rows are led by a th."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    row = F.format_string(CAREER_ROW, F.when(k % 4 == 1, '<th><a href="#">n</a></th>').otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd"), k, k % 9, k % 12 + 1, F.when(k % 5 < 4, fp.CAREER_MARK).otherwise(""), 1600 + k % 7 * 100, 10 + k % 9, k % 10, F.floor("o_totalprice"))
    rows = o.select("o_custkey", row.alias("tr")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("tr")), "").alias("rows"))
    c, n = table(spark, sf, "customer"), F.col("c_custkey")
    head = F.format_string("<h1>X</h1> <p>HORSE %s.%s.%d</p><p>SIRE D'OR %d / DAM %d</p> carriera 10", F.when(n % 2 == 0, "f").otherwise("m"), F.when(n % 3 == 0, "e").otherwise("i"), n % 15 + 2, F.col("c_nationkey"), n)
    return c.join(rows, "c_custkey", "left").select(F.concat(F.lower("c_name"), F.lit(" ")).alias("name"), F.concat(head, F.lit("<table>"), F.coalesce("rows", F.lit("")), F.lit("</table>")).alias("html"))


@query("""SELECT upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CASE WHEN c_custkey % 3 = 0 THEN 'EST' ELSE 'ITA' END AS country, (2001 - (c_custkey % 15 + 2))::INT AS birth_year,
'SIRE D''OR ' || c_nationkey AS sire, 'DAM ' || c_custkey AS dam FROM customer""")
def career_page_profiles(spark, sf):
    return pages.career_profiles(career_pages(spark, sf), F.lit(a.AS_OF).cast("date"))


@query("""SELECT upper(c_name) AS horse_name, o_orderdate::DATE::VARCHAR AS race_date, 'RM' AS track, CASE WHEN o_orderkey % 5 < 4 THEN (o_orderkey % 12 + 1)::INT END AS placement, '1''' || (10 + o_orderkey % 9) || '"' || (o_orderkey % 10) AS time_km,
(1600 + o_orderkey % 7 * 100)::INT AS distance, floor(o_totalprice)::DOUBLE AS prize_net, o_orderdate::DATE::VARCHAR || '_' || o_orderkey AS race_code FROM orders JOIN customer ON c_custkey = o_custkey""")
def career_page_races(spark, sf):
    return pages.career_races(career_pages(spark, sf)).select("horse_name", F.col("race_date").cast("string").alias("race_date"), "track", "placement", "time_km", "distance", "prize_net", "race_code")


@query("""SELECT upper(n_name) AS horse_name, strftime(o_orderdate, '%Y-%m-%d') AS race_date, n_name AS track, (o_orderkey % 9)::INT AS placement, (o_orderkey % 9) || 'x' AS placement_raw, (1600 + o_orderkey % 5)::INT AS distance,
o_orderpriority AS driver, floor(o_totalprice) + 0.5 AS prize_net, o_orderkey::VARCHAR AS race_code FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def header_table_races(spark, sf):
    """Pages that name their columns, many under one name, each with a second table that is not read."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("o_orderkey")
    row = F.format_string("<tr><td>%s</td><td>%s</td><td>%dx</td><td>%d</td><td>%s</td><td>%d,5</td><td>%d</td></tr>", F.date_format("o_orderdate", "d/M/yyyy"), "n_name", k % 9, 1600 + k % 5, "o_orderpriority", F.floor("o_totalprice"), k)
    made = o.groupBy(F.col("n_name").alias("name"), "o_custkey").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    head = "<table><tr><th>Data</th><th>Pista</th><th>Pos</th><th>Distanza</th><th>Guidatore</th><th>Premio</th><th>Codice</th></tr>"
    page = made.select("name", F.concat(F.lit(head), "rows", F.lit("</table><table><tr><td>Data</td></tr><tr><td>1/1/2020</td><td>a</td><td>b</td></tr></table>")).alias("html"))
    return pages.header_races(page).drop("time_km", "prize_gross")


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN (1990 + s_suppkey % 20)::INT END AS birth_year, CASE WHEN s_suppkey % 4 = 0 THEN 'M' WHEN s_suppkey % 4 = 1 THEN 'F' END AS sex, regexp_extract(n_name, '^[A-Z]{2,3}') AS country,
CASE WHEN n_name NOT SIMILAR TO '.*[^A-Z ].*' THEN n_name END AS sire, r_name AS dam, '1''' || (10 + s_suppkey % 9) || '"' || (s_suppkey % 10) AS record_career
FROM supplier JOIN (SELECT n_nationkey, n_regionkey, upper(replace(n_name, '_', ' ')) AS n_name FROM nation) ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def detail_profiles(spark, sf):
    nation = table(spark, sf, "nation").withColumn("n_name", F.upper(F.replace("n_name", F.lit("_"), F.lit(" "))))
    s = table(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("s_suppkey")
    born = F.when(k % 3 == 1, F.format_string("Nato nel %d", 1990 + k % 20)).when(k % 3 == 2, F.format_string("Anno di nascita: %d", 1990 + k % 20)).otherwise("")
    sex = F.when(k % 4 == 0, "uno Stallone,").when(k % 4 == 1, "Fattrice").otherwise("")
    said = "<p>Nato nel mese di maggio. Padre di molti, Madre di pochi. Paese: ignoto. Record: nessuno</p>"  # labels without a sound value
    page = F.format_string(said + "<p>%s</p><p>Paese: %s</p><b>%s</b><p>Padre: %s</p><p>Madre: %s</p> Anno <i>Record: 1'%d\"%d</i>", sex, "n_name", born, "n_name", "r_name", 10 + k % 9, k % 10)
    return pages.detail_profile(s.select(F.col("s_name").alias("name"), page.alias("html")))


@query("""SELECT *, 'http://h/hRis.php?data=' || data || '&sigla=' || sigla || '&ippodromo=' || replace(ippodromo, ' ', '+') || '&note_giorno=' || replace(note_giorno, ' ', '%20') AS url FROM
(SELECT strftime(DATE '2024-01-01' + n_nationkey::INT, '%Y-%m-%d') AS data, upper(left(n_name, 2)) AS sigla, n_name AS ippodromo, 'notte ' || n_nationkey AS note_giorno FROM nation)""")
def meeting_index(spark, sf):
    n = table(spark, sf, "nation")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyyy-MM-dd")
    link = '<a id="link_risultati" href="r.php?data=%s&amp;sigla=%s&amp;ippodromo=%s&amp;note_giorno=notte%%20%d">r</a><a href="r.php?data=2024-01-01">other</a>'
    link = F.format_string(link, day, F.upper(F.substring("n_name", 1, 2)), F.replace("n_name", F.lit(" "), F.lit("+")), "n_nationkey")
    return pages.meetings(n.agg(F.array_join(F.collect_list(link), "\n").alias("html")), "http://h/")


@query("""SELECT upper(s_name) AS name, (2000 + s_suppkey % 9)::INT AS birth_year, 'http://h/horse.php?anno=' || (2000 + s_suppkey % 9) AS url_detail FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT upper(s_name) || '(' || (2000 + s_suppkey % 9) || ')', (2000 + s_suppkey % 9)::INT, 'http://h/cavallo/' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0""")
def home_page_horses(spark, sf):
    """Each horse is linked to from two pages, in one of two forms; the first link counts."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    year = 2000 + k % 9
    link = lambda at, more: F.when(k % 2 == 0, F.format_string(f'<a href="{at}cavallo/%d{more}"> <b>%s</b> (%d)</a>', k, "s_name", year)).otherwise(F.format_string(f'<a href="{at}horse.php?anno=%d{more}">%s</a>', year, "s_name"))
    both = s.select((k % 7).alias("page_id"), link("/", "").alias("a")).unionByName(s.select((k % 7 + 100).alias("page_id"), link("http://later/", "&amp;x=1").alias("a")))
    return pages.horse_links(both.groupBy("page_id").agg(F.array_join(F.collect_list("a"), "<br>").alias("html")), "http://h/")


@query("SELECT s_name AS name, upper(n_name) AS sire, upper(s_name) AS dam, CASE WHEN s_suppkey % 2 = 0 THEN 'A B' END AS sire_sire, NULL::VARCHAR AS dam_dam FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def pedigree_documents(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    more = F.when(F.col("s_suppkey") % 2 == 0, ', {"pp": {"nome": "a  b "}}').otherwise("")
    call = F.format_string("x(); populateTableWithJSON( [{\"p\": {\"nome\": \"%s\"}}, {\"m\": {\"nome\": \"%s\"}}%s] , 'cavallo'); y();", F.lower("n_name"), F.lower("s_name"), more)
    script = lambda c: F.concat(F.lit('<script src="data:text/javascript;base64,'), F.base64(c.cast("binary")), F.lit('"></script>'))
    found = pages.pedigree_pages(s.select(F.col("s_name").alias("name"), F.concat(script(F.lit("other()")), script(call)).alias("html")))
    return found.select("name", "sire", "dam", "sire_sire", "dam_dam")


@query("SELECT p_brand AS name, coalesce(min(p_partkey) FILTER (p_size % 10 = 3), min(p_partkey))::VARCHAR AS codice FROM part GROUP BY p_brand")
def autocomplete_codes(spark, sf):
    """Of a name's hits the first with the same canonical name, else the first."""
    nome = F.when(F.col("p_size") % 10 == 3, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise("other")
    return pages.best_codes(table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("position"), nome.alias("nome"), F.col("p_partkey").cast("string").alias("codice")))


@query("""SELECT o_orderkey AS id, 'HORSE ' || o_custkey AS name, CASE WHEN k < 2 THEN (o_orderkey % 9 + 1)::INT END AS placement, CASE WHEN k < 2 THEN '1.1' || (o_orderkey % 9) || '.3' END AS time_km, (1600 + o_orderkey % 3 * 100)::INT AS distance,
o_orderpriority AS driver, CASE WHEN k = 1 THEN floor(o_totalprice) + 0.25 ELSE 0 END AS prize, k < 2 AS is_classified FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def result_row_cells(spark, sf):
    """The four layouts of pipe-delimited rows: placed without and with prizes, unplaced without and with."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    horse, driver, dist = F.format_string("horse %d", "o_custkey"), F.col("o_orderpriority"), (1600 + k % 3 * 100).cast("string")
    placed = lambda c: F.concat(F.lit("| "), F.concat_ws(" | ", F.format_string("%dº", k % 9 + 1), F.lit("4"), F.lit("x"), horse, F.format_string("1.1%d.3", k % 9), dist, c, driver), F.lit(" |"))
    money = F.concat(F.floor("o_totalprice").cast("string"), F.lit(",25"))
    bare = lambda *c: F.concat_ws("|", F.lit("4"), F.lit("x"), horse, F.lit("rit."), dist, *c)
    row = F.when(k % 4 == 0, placed(F.lit("F"))).when(k % 4 == 1, placed(money)).when(k % 4 == 2, bare(F.lit("AP"), driver, F.lit(" "))).otherwise(bare(driver))
    return o.select(k.alias("id"), fp.result_row(row).alias("r")).select("id", "r.*")


@query("""SELECT n_name AS track, c_custkey % 3 AS race, count(*) AS runners, count(*) FILTER (c_custkey % 9 < 6) AS placed, sum(CASE WHEN c_custkey % 9 < 6 THEN 2150.5 ELSE 0 END)::DOUBLE AS prizes, count(*) FILTER (c_custkey % 9 < 6) AS timed
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def result_pages(spark, sf):
    """Result pages of three races a nation, runners that did not finish included, read back and counted."""
    c, k = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")), F.col("c_custkey")
    cells = '<tr><th class="piaz">9º</th><td class="c1 piaz%s">%s</td><td class="nome_cav%s bold">%s</td><td class=" tempo%s  x">%s</td><td class="premio_u">%s</td></tr>'
    u, there = F.when(k % 2 == 0, "_u").otherwise(""), k % 9 < 6
    row = F.format_string(cells, u, F.when(there, F.concat(k % 9 + 1, F.lit("º"))).otherwise("rit."), u, "c_name", u, F.when(there, "1.14.6").otherwise("rit."), F.when(there, "2.150,50").otherwise(""))
    races = c.groupBy("n_name", (k % 3).alias("race")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    html = F.concat(F.lit('<div id="dati_corsa"><table id="tabella_risultati">'), "rows", F.lit("</table></div><table><tr><td>x</td></tr></table>"))
    made = races.select(F.lit("2024-01-01").alias("race_date"), F.concat("n_name", F.lit("/"), "race").alias("track"), F.lit("RM").alias("sigla"), html.alias("html"))
    parts = F.split("track", "/")
    read = pages.result_rows(made).groupBy(F.get(parts, F.lit(0)).alias("track"), F.get(parts, F.lit(1)).cast("long").alias("race"))
    return read.agg(F.count(F.lit(1)).alias("runners"), F.count("placement").alias("placed"), F.sum("prize").alias("prizes"), F.count("time_km").alias("timed"))


@query("""SELECT upper(c_name) AS name, (c_custkey % 9 + 1)::INT AS placement, '1.' || (10 + c_custkey % 9) || '.' || (c_custkey % 10) AS time_km, NULL::INT AS distance, '' AS driver, 2150.5::DOUBLE AS prize,
'2024-01-01_M' || (c_nationkey % 5) || '_R1' AS race_code, '2024-01-01' AS race_date, 'm' || (c_nationkey % 5) AS track FROM customer""")
def html_table_rows(spark, sf):
    """Result pages made of nations and customers, read back by the table function."""
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("m"), F.col("c_nationkey") % 5).alias("track"),
        F.format_string('<tr><td class="piaz_u">%dº</td><td class="nome_cav_u">%s</td><td class="tempo_u">1.%d.%d</td><td class="premio_u">2.150,50</td></tr>', F.col("c_custkey") % 9 + 1, F.col("c_name"), 10 + F.col("c_custkey") % 9, F.col("c_custkey") % 10).alias("tr"),
        (F.col("c_custkey") % 50).alias("part"),
    )
    made = rows.groupBy("track", "part").agg(F.concat(F.lit('<div id="dati_corsa"><table id="tabella_risultati">'), F.array_join(F.array_sort(F.collect_list("tr")), ""), F.lit("</table></div>")).alias("html"))
    return pages.result_rows(made.select(F.lit("2024-01-01").alias("race_date"), "track", F.upper("track").alias("sigla"), "html"))


@query("""SELECT page_id, page_id % 7 <> 3 OR page_id % 5 = 2 AS reached, CASE WHEN page_id % 7 <> 3 OR page_id % 5 = 2 THEN len(regexp_extract_all(html, 'href="([^"]*)"')) END AS n,
(CASE WHEN page_id % 7 <> 3 THEN 1 WHEN page_id % 2 = 0 THEN 3 ELSE 2 END)::BIGINT AS attempts FROM pages""")
def landed_pages(spark, sf):
    """All pages landed in a folder a host, some of them not reached at first; those that were asked for too seldom land again, some for good."""
    p, path = table(spark, sf, "pages"), shared_path(spark, "landed")
    host, k = F.regexp_extract("url", "//([^/:]+)", 1), F.col("page_id")
    landing.land(p, path, host, k % 7 != 3, F.when((k % 7 == 3) & (k % 2 == 0), 2).otherwise(1))
    again = landing.to_fetch_again(landing.landed(spark, path)).select("page_id")
    landing.land(p.join(again, "page_id"), path, F.concat(F.lit("again/"), host), k % 5 == 2)
    known = landing.latest(landing.landed(spark, path))
    counts = landing.found_on(known, pages.page_links(known))
    return counts.join(known.select("page_id", "attempts"), "page_id")
