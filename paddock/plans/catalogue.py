"""Every query of the engine over the driver's tables, with the oracle's SQL written independently of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names as fn, parsing as fp, scoring as fs
from ..operators import breeding, career, dedupe, figures, merge, pedigree, queues, ratings as rate_ops, sires as sire_ops
from ..session import shared_path, table
from ..sources import pages as page_ops, schemas
from . import adapter as a, answers, nightly as night, parts
from .registry import ORACLES, QUERIES, query

def as_of():
    return F.lit(a.AS_OF).cast("date")


NAME = "'Customer#' || lpad({}::VARCHAR, 9, '0')"
BASE = f"""
horses AS (SELECT c_name AS name, CASE WHEN c_custkey % 50 <> 7 THEN (2000 + c_custkey % 20)::INT END AS birth_year,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CASE WHEN c_custkey % 9 = 4 THEN ' Sire ' || c_nationkey || ' ' ELSE 'SIRE ' || c_nationkey END AS sire, c_custkey AS key FROM customer),
family AS (SELECT * REPLACE (CASE WHEN key >= 2 THEN {NAME.format("floor(key / 2)::BIGINT")} END AS sire), CASE WHEN key >= 3 THEN CASE WHEN key % 7 = 5 THEN upper({NAME.format("floor(key / 3)::BIGINT")}) || '  ' ELSE {NAME.format("floor(key / 3)::BIGINT")} END END AS dam FROM horses),
races AS (SELECT o_orderkey AS id, {NAME.format("o_custkey")} AS horse_name, o_orderdate::DATE AS race_date,
  CASE WHEN o_orderstatus <> 'F' AND o_custkey % 13 <> 4 THEN left(o_orderpriority, 1)::INT END AS placement,
  CASE o_orderkey % 4 WHEN 0 THEN '1''' || (10 + o_orderkey % 9) || '"' || (o_orderkey % 10) WHEN 1 THEN '1.' || (10 + o_orderkey % 9) || '.' || (o_orderkey % 10)
    WHEN 2 THEN (10 + o_orderkey % 9) || '.' || (o_orderkey % 10) ELSE 'r.p.' END AS time_km,
  CASE WHEN o_orderkey % 4 < 3 THEN 60 + 10 + o_orderkey % 9 + (o_orderkey % 10) / 10.0::DOUBLE END AS secs,
  o_totalprice AS prize_net, o_orderkey::VARCHAR AS race_code FROM orders),
stat AS (SELECT horse_name, count(placement) AS career_races, count(*) FILTER (placement = 1) AS career_wins,
  sum(CASE WHEN placement IS NOT NULL THEN coalesce(prize_net, 0) ELSE 0 END) AS career_earnings FROM races GROUP BY horse_name),
best AS (SELECT horse_name, time_km AS record_career, secs AS record_seconds FROM races WHERE secs IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY horse_name ORDER BY round(secs, 6), id) = 1),
careers AS (SELECT h.*, coalesce(career_races, 0) AS career_races, coalesce(career_wins, 0) AS career_wins, coalesce(career_earnings, 0) AS career_earnings, record_career, record_seconds
  FROM horses h LEFT JOIN stat s ON s.horse_name = h.name LEFT JOIN best b ON b.horse_name = h.name),
pct AS (SELECT *, CASE WHEN career_earnings > 0 THEN round(cume_dist() OVER (PARTITION BY career_earnings > 0 ORDER BY career_earnings) * 100 + 1e-9, 2) ELSE 0 END AS earn_percentile,
  CASE WHEN record_seconds > 0 THEN round(cume_dist() OVER (PARTITION BY record_seconds > 0 ORDER BY round(record_seconds, 6) DESC) * 100 + 1e-9, 2) ELSE 0 END AS time_percentile,
  CASE WHEN career_races > 0 THEN career_wins * 100.0::DOUBLE / career_races ELSE 0 END AS rate FROM careers WHERE career_races > 0),
scored AS (SELECT * REPLACE (upper(trim(sire)) AS sire), round(least(earn_percentile * 0.5::DOUBLE + time_percentile * 0.3::DOUBLE + rate * 0.2::DOUBLE, 100) + 1e-9, 2) AS score, round(rate + 1e-9, 2) AS win_rate FROM pct WHERE birth_year IS NOT NULL),
ratings AS (SELECT *, CASE WHEN score >= 97 THEN 'SSS' WHEN score >= 90 THEN 'SS' WHEN score >= 80 THEN 'S' WHEN score >= 65 THEN 'A' WHEN score >= 50 THEN 'B'
  WHEN score >= 35 THEN 'C' WHEN score >= 20 THEN 'D' WHEN score >= 10 THEN 'E' ELSE 'F' END AS grade,
  round(cume_dist() OVER (PARTITION BY sire ORDER BY score) * 100 + 1e-9, 2) AS sire_percentile, 'performance' AS rating_mode FROM scored),
ranking_rows AS (SELECT 'SIRE ' || (regexp_extract(p_brand, '([0-9]+)', 1)::INT - 1) AS name, p_partkey::VARCHAR AS vp_id, p_size AS prodotti, floor(p_retailprice)::BIGINT AS somme_vinte,
  floor(p_retailprice / p_size)::BIGINT AS media, p_partkey AS ord FROM part),
rolled AS (SELECT name, arg_max(vp_id, prodotti::BIGINT * 1000000000 - ord) AS vp_id, sum(prodotti)::BIGINT AS vp_total_offspring, sum(somme_vinte)::BIGINT AS vp_total_earnings_eur,
  round(avg(media) + 1e-9, 2) AS vp_avg_earnings_eur FROM ranking_rows GROUP BY name),
running AS (SELECT upper(trim(sire)) AS sire, count(DISTINCT name) AS n_in_corsa FROM horses WHERE name IN (SELECT horse_name FROM races WHERE race_date >= DATE '{a.AS_OF}' - 180) GROUP BY 1),
grouped AS (SELECT sire, count(*) AS n, sum(CASE grade WHEN 'SSS' THEN 100 WHEN 'SS' THEN 85 WHEN 'S' THEN 70 WHEN 'A' THEN 55 WHEN 'B' THEN 40 WHEN 'C' THEN 25 WHEN 'D' THEN 15 WHEN 'E' THEN 8 WHEN 'F' THEN 2 ELSE 0 END) AS weight,
  {", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g}" for g in fs.GRADE_WEIGHTS)}, round(avg(career_earnings) + 1e-9, 2) AS avg_earnings FROM ratings GROUP BY sire),
total AS (SELECT g.*, greatest(coalesce(r.vp_total_offspring, 0), n) AS offspring, round(coalesce(r.vp_total_earnings_eur / (SELECT max(vp_total_earnings_eur) FROM rolled) * 5, 0) + 1e-9, 2) AS vp_boost
  FROM grouped g LEFT JOIN rolled r ON r.name = g.sire),
sire_score AS (SELECT *, round(weight / n * CASE WHEN offspring = 1 THEN 0.4 WHEN offspring = 2 THEN 0.55 WHEN offspring = 3 THEN 0.65 WHEN offspring = 4 THEN 0.75 WHEN offspring <= 9 THEN 0.85
  WHEN offspring <= 19 THEN 0.92 WHEN offspring <= 49 THEN 0.97 ELSE 1 END::DOUBLE + 1e-9, 2) AS avg_score FROM total),
sire_final AS (SELECT *, round(least(avg_score + vp_boost, 100) + 1e-9, 2) AS final_score FROM sire_score),
places AS (SELECT list(final_score ORDER BY final_score) AS s, count(*) AS n FROM sire_final),
limits AS (SELECT {", ".join(f"s[least(floor({p} / 100.0::DOUBLE * n)::BIGINT, n - 1) + 1] AS {g}" for p, g in fs.SIRE_PERCENTILES)} FROM places),
stats AS (SELECT f.sire, f.offspring AS n_figli_totali, coalesce(u.n_in_corsa, 0) AS n_in_corsa, f.avg_score, {", ".join(f"n_{g}" for g in fs.GRADE_WEIGHTS)},
  round((n_SSS + n_SS + n_S) * 100.0::DOUBLE / f.n + 1e-9, 2) AS pct_top_S, f.avg_earnings, f.vp_boost, f.final_score,
  CASE WHEN final_score <= 0 THEN 'N/A' {" ".join(f"WHEN final_score >= l.{g} THEN '{g}'" for _, g in fs.SIRE_PERCENTILES)} ELSE 'F' END AS grade
  FROM sire_final f CROSS JOIN limits l LEFT JOIN running u ON u.sire = f.sire),
studs AS (SELECT {NAME.format("s_suppkey")} AS name, CASE WHEN s_suppkey % 11 <> 3 THEN s_acctbal END AS stud_fee_eur, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'retired' END AS stud_status, s_name AS stud_farm FROM supplier)
"""


def sql(body: str) -> str:
    return f"WITH {BASE} {body}"


def rounded_money(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles to cents: the order of addition differs between engines."""
    return df.withColumns({c: F.round(c, 2) for c in columns})


# careers and ratings


@query(sql("SELECT horse_name, career_races, career_wins, round(career_earnings, 2) AS career_earnings FROM stat"))
def career_stats(spark, sf):
    return rounded_money(career.career_stats(a.races(spark, sf)), "career_earnings")


@query(sql("SELECT horse_name, record_career, round(record_seconds, 6) AS record_seconds FROM best"))
def best_time_text(spark, sf):
    return career.best_time(a.races(spark, sf)).withColumn("record_seconds", F.round("record_seconds", 6))


@query("SELECT o_orderkey, left(o_orderpriority, 1)::INT AS n, CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority, 1)::INT END AS placement FROM orders")
def leading_int(spark, sf):
    o = table(spark, sf, "orders")
    marked = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.substring("o_orderpriority", 1, 1), F.lit(fp.CAREER_MARK))).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", fp.leading_int(F.col("o_orderpriority")).alias("n"), fp.placement(marked).alias("placement"))


@query(sql("SELECT id, time_km, round(secs, 6) AS seconds FROM races"))
def time_to_seconds(spark, sf):
    return a.races(spark, sf).select("id", "time_km", F.round(fp.km_seconds(F.col("time_km")), 6).alias("seconds"))


@query(sql("SELECT name, earn_percentile FROM pct"))
def earn_percentile(spark, sf):
    return rate_ops.share_of_all(a.careers(spark, sf).filter(rate_ops.raced()), "career_earnings", "earn_percentile", F.lit(True)).select("name", "earn_percentile")


@query(sql("SELECT name, time_percentile FROM pct"))
def time_percentile(spark, sf):
    return rate_ops.share_of_all(a.careers(spark, sf).filter(rate_ops.raced()), "record_seconds", "time_percentile", F.lit(True), False).select("name", "time_percentile")


@query(sql("SELECT name, CASE WHEN career_earnings > 0 THEN round(cume_dist() OVER (PARTITION BY birth_year, career_earnings > 0 ORDER BY career_earnings) * 100 + 1e-9, 2) ELSE 0 END AS earn_percentile FROM careers"))
def year_percentile(spark, sf):
    return rate_ops.share_of_year(a.careers(spark, sf), "career_earnings", "earn_percentile", F.lit(True)).select("name", "earn_percentile")


@query(sql("SELECT name, birth_year, earn_percentile, time_percentile, win_rate, score, grade FROM ratings"))
def horse_score_grade(spark, sf):
    return a.ratings(spark, sf).select("name", "birth_year", "earn_percentile", "time_percentile", "win_rate", "score", "grade")


@query(sql("SELECT name, sire, sire_percentile FROM ratings"))
def sire_percentile(spark, sf):
    return a.ratings(spark, sf).select("name", "sire", "sire_percentile")


@query(sql("SELECT grade, count(*) AS cnt FROM ratings GROUP BY grade"))
def grade_distribution(spark, sf):
    return a.ratings(spark, sf).groupBy("grade").agg(F.count(F.lit(1)).alias("cnt"))


@query(sql("""SELECT (i - 1)::INT AS position, g AS grade, count(r.name) AS cnt, round(count(r.name) * 100.0::DOUBLE / (SELECT count(*) FROM ratings) + 1e-9, 2) AS share
FROM (SELECT unnest(['SSS', 'SS', 'S', 'A', 'B', 'C', 'D', 'E', 'F']) AS g, unnest(range(1, 10)) AS i) o LEFT JOIN ratings r ON r.grade = o.g GROUP BY i, g"""))
def grade_share(spark, sf):
    return answers.histogram(a.ratings(spark, sf))


@query(sql("SELECT birth_year, name, grade, score, round(career_earnings, 2) AS career_earnings FROM ratings QUALIFY row_number() OVER (PARTITION BY birth_year ORDER BY score DESC, career_earnings DESC, name DESC) = 1"))
def top_by_group(spark, sf):
    return rounded_money(answers.best_of_year(a.ratings(spark, sf)), "career_earnings")


# sires


@query(sql("SELECT * FROM stats"))
def sire_stats(spark, sf):
    return a.stats(spark, sf)


@query(sql("SELECT * FROM limits"))
def sire_thresholds(spark, sf):
    return sire_ops.nearest_rank_thresholds(a.stats(spark, sf), "final_score")


@query(sql("""SELECT f.sire, round(weight / n * CASE WHEN n = 1 THEN 0.4 WHEN n = 2 THEN 0.55 WHEN n = 3 THEN 0.65 WHEN n = 4 THEN 0.75 WHEN n <= 9 THEN 0.85 WHEN n <= 19 THEN 0.92 WHEN n <= 49 THEN 0.97 ELSE 1 END::DOUBLE + 1e-9, 2) AS avg_score FROM sire_final f"""))
def sire_stats_static(spark, sf):
    running = sire_ops.running_progeny(a.horses(spark, sf), a.races(spark, sf), as_of())
    return sire_ops.sire_stats(a.ratings(spark, sf), a.rankings(spark, sf), running, mode="static").select("sire", "avg_score")


@query(sql("SELECT *, rank() OVER (ORDER BY vp_total_earnings_eur DESC)::INT AS vp_rank FROM rolled"))
def ranking_rollup(spark, sf):
    return a.rankings(spark, sf)


@query(sql("SELECT name, row_number() OVER (ORDER BY vp_total_earnings_eur DESC, name)::INT AS vp_rank FROM rolled"))
def ranking_rank(spark, sf):
    return sire_ops.ordinal_rank(sire_ops.ranking_rollup(a.ranking_rows(spark, sf))).select("name", "vp_rank")


@query(sql("SELECT * FROM running"))
def running_progeny(spark, sf):
    return sire_ops.running_progeny(a.horses(spark, sf), a.races(spark, sf), as_of())


# pedigrees

GRAND = "SELECT h.name, h.sire, h.dam, s.sire AS sire_sire, s.dam AS sire_dam, d.sire AS dam_sire, d.dam AS dam_dam FROM family h LEFT JOIN family s ON upper(trim(s.name)) = upper(trim(h.sire)) LEFT JOIN family d ON upper(trim(d.name)) = upper(trim(h.dam))"


@query(sql(GRAND))
def pedigree_two_gen(spark, sf):
    return pedigree.grandparents(a.family(spark, sf)).select("name", *pedigree.ANCESTORS)


# a cycle in the data ends its line: in the oracle as here, nobody stands twice in one
DEEP = """WITH RECURSIVE {base}, edges AS (SELECT upper(trim(name)) AS child, sire AS parent, 's' AS side FROM family WHERE sire IS NOT NULL UNION ALL SELECT upper(trim(name)), dam, 'd' FROM family WHERE dam IS NOT NULL),
up AS (SELECT name, name AS ancestor, '' AS path, [upper(trim(name))] AS met FROM family
  UNION ALL SELECT up.name, e.parent, up.path || e.side, list_append(up.met, upper(trim(e.parent))) FROM up JOIN edges e ON e.child = up.met[-1] WHERE length(up.path) < {depth} AND NOT list_contains(up.met, upper(trim(e.parent))))
SELECT name, path, ancestor FROM up WHERE path <> ''"""


@query(DEEP.format(base=BASE, depth=5))
def pedigree_five_gen(spark, sf):
    """All ancestors up to the fifth generation."""
    return pedigree.ancestors(a.family(spark, sf), 5)


@query(sql(f"SELECT p.name, {', '.join(f'''coalesce(nullif(CASE WHEN length(p.name) > 0 AND right(p.name, 1) = '3' THEN '' ELSE p.{c} END, ''), 'FB ' || p.name) AS {c}''' for c in pedigree.ANCESTORS)} FROM ({GRAND}) p"))
def pedigree_fallback(spark, sf):
    full = pedigree_two_gen(spark, sf)
    holes = full.withColumns({c: F.when(F.endswith("name", F.lit("3")), F.lit("")).otherwise(F.col(c)) for c in pedigree.ANCESTORS})
    other = full.select("name", *(F.concat(F.lit("FB "), "name").alias(c) for c in pedigree.ANCESTORS))
    return pedigree.with_fallback(holes, other).select("name", *pedigree.ANCESTORS)


@query(sql("SELECT name, max(birth_year) AS birth_year FROM (SELECT sire AS name, birth_year FROM family UNION ALL SELECT dam, birth_year FROM family) WHERE name IS NOT NULL AND name <> '' GROUP BY name"))
def parents_latest(spark, sf):
    return pedigree.parents_latest(a.family(spark, sf))


@query(sql(f"""SELECT name, max(birth_year) AS birth_year FROM (SELECT sire AS name, birth_year FROM family UNION ALL SELECT dam, birth_year FROM family) WHERE name IS NOT NULL
AND name NOT IN (SELECT name FROM ({GRAND}) WHERE sire_sire IS NOT NULL AND sire_dam IS NOT NULL AND dam_sire IS NOT NULL AND dam_dam IS NOT NULL) GROUP BY name"""))
def incomplete_parents(spark, sf):
    return pedigree.parents_to_complete(a.family(spark, sf), pedigree_two_gen(spark, sf))


@query(sql("SELECT name, birth_year FROM family WHERE sire IS NULL OR dam IS NULL"))
def incomplete_pedigree(spark, sf):
    return pedigree.incomplete(a.family(spark, sf))


@query(sql(f"SELECT name, list_sort(list_distinct(list_filter([upper(trim(sire)), upper(trim(dam)), upper(trim(sire_sire)), upper(trim(sire_dam)), upper(trim(dam_sire)), upper(trim(dam_dam))], lambda x: x IS NOT NULL)))::VARCHAR AS ancestors FROM ({GRAND})"))
def ancestor_names(spark, sf):
    named = pedigree.ancestor_names(a.family(spark, sf))
    return named.select("name", F.concat(F.lit("["), F.array_join(F.array_sort("ancestors"), ", "), F.lit("]")).alias("ancestors"))


# answers


@query(sql("SELECT h.name, h.birth_year, h.sire, h.sex, r.grade, r.score, r.rating_mode FROM horses h LEFT JOIN ratings r ON r.name = h.name AND r.birth_year = h.birth_year WHERE h.name ILIKE '%MER#00000001%' ORDER BY r.score DESC NULLS LAST, h.name, h.birth_year LIMIT 20"))
def search_name(spark, sf):
    return answers.search_horse(spark, a.horse_index(spark, sf), "MER#00000001")


@query(sql("SELECT DISTINCT sire AS name, n_figli_totali, n_in_corsa, avg_score, n_SSS, n_SS, n_S, pct_top_S FROM stats WHERE sire ILIKE '%ire 1%' ORDER BY avg_score DESC, name LIMIT 20"))
def search_sire(spark, sf):
    return answers.search_sire(spark, a.sire_index(spark, sf), "ire 1")


@query(sql("SELECT name, birth_year FROM horses WHERE name ILIKE '%0002%' AND sex = 'F' ORDER BY name, birth_year LIMIT 5"))
def suggestions(spark, sf):
    return answers.suggestions(spark, a.horse_index(spark, sf), "0002")


@query(sql("SELECT r.name, r.birth_year, r.score, r.grade, rank, total, ceil(total / 25.0)::BIGINT AS pages FROM (SELECT *, (row_number() OVER (ORDER BY score DESC, name, birth_year))::INT AS rank, count(*) OVER () AS total FROM ratings WHERE birth_year = 2011) r WHERE rank BETWEEN 26 AND 50"))
def leaderboard_page(spark, sf):
    return answers.leaderboard(spark, a.leaderboard(spark, sf), page=2, year=2011).select("name", "birth_year", "score", "grade", "rank", "total", "pages")


@query(sql("SELECT name, birth_year, score, rank, total FROM (SELECT *, (row_number() OVER (ORDER BY score DESC, name, birth_year))::INT AS rank, count(*) OVER () AS total FROM ratings) WHERE rank > 1000 AND rank <= 1050"))
def leaderboard_deep_page(spark, sf):
    """The 21st page of fifty: the ranges before it are counted, not read."""
    return answers.leaderboard(spark, a.leaderboard(spark, sf), page=21, limit=50).select("name", "birth_year", "score", "rank", "total")


@query(sql("SELECT name, birth_year, sex, score FROM (SELECT h.*, r.score FROM horses h LEFT JOIN ratings r ON r.name = h.name AND r.birth_year = h.birth_year) WHERE name ILIKE '%9%1' OR name ILIKE '%9%1%'"))
def search_wildcards(spark, sf):
    """A term of single characters and a wildcard, for which there is no gram: all names are compared."""
    from ..operators import search

    return search.search(spark, a.horse_index(spark, sf), "9%1").select("name", "birth_year", "sex", "score")


@query(sql("SELECT DISTINCT birth_year FROM ratings"))
def leaderboard_years(spark, sf):
    return answers.years(a.ratings(spark, sf))


@query(sql("SELECT id, race_date::VARCHAR AS race_date, placement, time_km, prize_net FROM races WHERE horse_name = 'Customer#000000005' ORDER BY races.race_date DESC, id DESC LIMIT 20"))
def profile_last_races(spark, sf):
    return answers.last_races(a.races(spark, sf), "Customer#000000005").select("id", F.col("race_date").cast("string").alias("race_date"), "placement", "time_km", "prize_net")


@query(sql(f"SELECT p.*, r.birth_year, r.score, r.grade FROM ({GRAND}) p JOIN horses h ON h.name = p.name LEFT JOIN ratings r ON r.name = p.name WHERE p.name = 'Customer#000000041' AND h.birth_year = 2001"))
def profile_head(spark, sf):
    one = answers.horse_profile(a.family(spark, sf), a.ratings(spark, sf), "Customer#000000041", 2001)
    return one.select("name", *pedigree.ANCESTORS, "birth_year", "score", "grade")


@query(sql("SELECT h.name, h.birth_year, r.grade, r.score FROM horses h LEFT JOIN ratings r ON r.name = h.name AND r.birth_year = h.birth_year WHERE upper(trim(h.sire)) = (SELECT upper(trim(sire)) FROM horses WHERE name = 'Customer#000000041') AND h.name <> 'Customer#000000041' ORDER BY r.score DESC NULLS LAST, h.name LIMIT 6"))
def profile_siblings(spark, sf):
    return answers.half_siblings(a.horses(spark, sf), a.ratings(spark, sf), "Customer#000000041", 2001)


@query(sql("""SELECT metric, a.v AS value1, b.v AS value2, coalesce(CASE WHEN metric = 'record_seconds' THEN a.v < b.v ELSE a.v > b.v END, false) AS wins1, coalesce(CASE WHEN metric = 'record_seconds' THEN b.v < a.v ELSE b.v > a.v END, false) AS wins2
FROM (SELECT unnest(['score', 'win_rate', 'record_seconds']) AS metric, unnest([score, win_rate, round(record_seconds, 6)]) AS v FROM ratings WHERE name = 'Customer#000000005') a
JOIN (SELECT unnest(['score', 'win_rate', 'record_seconds']) AS metric, unnest([score, win_rate, round(record_seconds, 6)]) AS v FROM ratings WHERE name = 'Customer#000000011') b USING (metric)"""))
def compare_pair(spark, sf):
    rated = a.ratings(spark, sf).withColumn("record_seconds", F.round("record_seconds", 6))
    return answers.compare(rated, ("Customer#000000005", None), ("Customer#000000011", 2011), ["score", "win_rate"], ["record_seconds"])


@query(sql("SELECT (SELECT count(*) FROM horses) AS horses, (SELECT count(*) FROM races) AS races, (SELECT count(DISTINCT sire) FROM stats) AS sires"))
def totals(spark, sf):
    return answers.totals(a.horses(spark, sf), a.races(spark, sf), a.stats(spark, sf))


@query(sql("""SELECT name, (SELECT count(*) FROM (SELECT 1 FROM ratings WHERE sire = 'SIRE 3' LIMIT 20)) AS n_children, round(max_earnings, 2) AS max_earnings, avg_win_rate, avg_score, final_score, pct_top_S FROM
(SELECT 'SIRE 3' AS name, max(career_earnings) AS max_earnings, round(avg(coalesce(win_rate, 0)) + 1e-9, 2) AS avg_win_rate FROM (SELECT * FROM ratings WHERE sire = 'SIRE 3' ORDER BY career_earnings DESC, name, birth_year LIMIT 20)) JOIN stats ON sire = name"""))
def sire_page(spark, sf):
    names, studs, horses, sheets = a.sire_tables(spark, sf)
    page = answers.sire_pages(names.filter("trim(name) = 'sire 3'"), a.stats(spark, sf), studs, a.ratings(spark, sf), horses, sheets)
    return page.select(F.col("sire").alias("name"), F.size("children").cast("long").alias("n_children"), F.round("max_earnings", 2).alias("max_earnings"), fs.rounded(F.col("avg_win_rate")).alias("avg_win_rate"), "avg_score", "final_score", "pct_top_S")


@query(sql(f"""SELECT coalesce(s.sire, q.k) AS sire, coalesce(s.n_figli_totali, 0) AS n_figli_totali, coalesce(s.n_in_corsa, 0) AS n_in_corsa, {", ".join(f"coalesce(s.n_{g}, 0) AS n_{g}" for g in fs.GRADE_WEIGHTS)}, s.avg_score, s.grade, s.final_score, s.pct_top_S, s.avg_earnings, coalesce(s.vp_boost, 0) AS vp_boost,
round(t.max_earnings, 2) AS max_earnings, round(t.avg_win_rate, 6) AS avg_win_rate, u.fee AS stud_fee_eur, u.n_name AS stud_farm, u.status AS stud_status, u.progeny AS progeny_earnings_2024, u.media AS media_in_corsa, u.tot AS tot_prod, coalesce(t.children, '') AS children, coalesce(d.grades, '') AS grade_distribution,
CASE WHEN o.sire IS NOT NULL THEN concat_ws('|', o.sire, o.dam, o.sire_sire, o.sire_dam, o.dam_sire, o.dam_dam) WHEN p.n % 2 = 1 THEN 'P' || p.n || '|' || p.n_name END AS pedigree,
CASE WHEN p.n % 2 = 1 AND p.n % 3 = 1 THEN 'FRA' WHEN u.country IS NOT NULL THEN u.country WHEN p.n % 3 = 0 THEN 'ITA' END AS nationality, s.sire IS NULL AND t.k IS NULL AS no_offspring_data, s.sire IS NOT NULL AS has_offspring_data
FROM (SELECT CASE WHEN n_nationkey = 7 THEN 'SIRE -1' ELSE 'SIRE ' || n_nationkey END AS k FROM nation) q LEFT JOIN (SELECT n_nationkey AS n, n_name, 'SIRE ' || n_nationkey AS k FROM nation) p ON p.k = q.k LEFT JOIN stats s ON s.sire = q.k
LEFT JOIN (SELECT 'SIRE ' || n_nationkey AS k, CASE WHEN n_nationkey % 6 <> 4 THEN n_nationkey * 100.0::DOUBLE END AS fee, n_name, 'active' AS status, CASE WHEN n_nationkey % 4 = 0 THEN left(n_name, 3) END AS country, n_nationkey * 1000.0::DOUBLE AS progeny, n_nationkey / 2.0::DOUBLE AS media, n_nationkey::INT AS tot FROM nation WHERE n_nationkey % 2 = 0) u ON u.k = q.k
LEFT JOIN (SELECT sire AS k, max(career_earnings) AS max_earnings, avg(coalesce(win_rate, 0)) AS avg_win_rate, string_agg(i || ':' || name || ':' || grade, ',' ORDER BY i) AS children FROM (SELECT *, row_number() OVER (PARTITION BY sire ORDER BY career_earnings DESC, name, birth_year) AS i FROM ratings) WHERE i <= 20 GROUP BY sire) t ON t.k = q.k
LEFT JOIN (SELECT sire AS k, string_agg(grade || ':' || c, ',' ORDER BY c DESC, grade) AS grades FROM (SELECT sire, grade, count(*) AS c FROM ratings GROUP BY ALL) GROUP BY sire) d ON d.k = q.k
LEFT JOIN (SELECT 'SIRE ' || n_nationkey AS k, f.sire AS sire_sire, f.dam AS sire_dam, g.sire AS dam_sire, g.dam AS dam_dam, h.sire, h.dam FROM nation JOIN (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 9 <> 3 THEN {NAME.format("(n_nationkey + 9)")} END AS sire, {NAME.format("(n_nationkey + 2)")} AS dam FROM nation WHERE n_nationkey % 3 = 0) h ON h.n = n_nationkey
  LEFT JOIN family f ON f.name = h.sire LEFT JOIN family g ON g.name = h.dam) o ON o.k = q.k
WHERE s.sire IS NOT NULL OR u.k IS NOT NULL OR p.n % 2 = 1 OR t.k IS NOT NULL"""))
def sire_pages(spark, sf):
    """All fields of the pages of all sires and of one that nobody knows."""
    names, studs, horses, sheets = a.sire_tables(spark, sf)
    page = answers.sire_pages(names, a.stats(spark, sf), studs, a.ratings(spark, sf), horses, sheets)
    flat = page.withColumns({
        "children": F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["rank"], c["name"], c["grade"])), ","),
        "grade_distribution": F.array_join(F.transform("grade_distribution", lambda g: F.concat_ws(":", g["grade"], g["cnt"])), ","),
        "pedigree": F.when(F.col("pedigree").isNotNull(), F.concat_ws("|", *(F.col(f"pedigree.{c}") for c in pedigree.ANCESTORS))),
        "avg_win_rate": F.round("avg_win_rate", 6),
    })
    return rounded_money(flat.select("*", "stud.*").drop("stud"), "max_earnings")


STUD_STATS = "stud_stats AS (SELECT r.name AS sire, score AS avg_score, career_races AS n_in_corsa, win_rate AS pct_top_S, career_earnings AS avg_earnings FROM ratings r)"


def stud_ratings(spark, sf):
    """Ratings of the studs themselves stand in for those of their progeny."""
    return a.ratings(spark, sf).select(F.col("name").alias("sire"), F.col("score").alias("avg_score"), F.col("career_races").alias("n_in_corsa"), F.col("win_rate").alias("pct_top_S"), F.col("career_earnings").alias("avg_earnings"))


@query(f"WITH {BASE}, {STUD_STATS} " + f"""
SELECT mare, name, stud_fee_eur, avg_score, rank FROM (SELECT g.name AS mare, s.name, s.stud_fee_eur, t.avg_score, (row_number() OVER (PARTITION BY g.name ORDER BY t.avg_score DESC, s.name))::INT AS rank
FROM ({GRAND}) g JOIN studs s ON s.stud_status = 'active' AND s.stud_fee_eur <= 6000 AND s.name NOT IN (coalesce(g.sire, ''), coalesce(g.dam, ''), coalesce(g.sire_sire, ''), coalesce(g.sire_dam, ''), coalesce(g.dam_sire, ''), coalesce(g.dam_dam, '')) AND upper(s.name) NOT IN (coalesce(upper(trim(g.sire)), ''), coalesce(upper(trim(g.dam)), ''), coalesce(upper(trim(g.sire_sire)), ''), coalesce(upper(trim(g.sire_dam)), ''), coalesce(upper(trim(g.dam_sire)), ''), coalesce(upper(trim(g.dam_dam)), ''))
JOIN stud_stats t ON t.sire = s.name JOIN horses h ON h.name = g.name AND h.sex = 'F') WHERE rank <= 15""")
def advisor_candidates(spark, sf):
    mares = a.horses(spark, sf).filter("sex = 'F'").select("name")
    return answers.advise(mares, a.family(spark, sf), a.studs(spark, sf), stud_ratings(spark, sf), budget=6000).select("mare", "name", "stud_fee_eur", "avg_score", "rank")


@query(f"WITH {BASE}, {STUD_STATS} " + f"""SELECT s.name, s.stud_fee_eur, t.avg_score, g.sire AS ped_sire, g.dam AS ped_dam FROM studs s LEFT JOIN stud_stats t ON t.sire = s.name LEFT JOIN ({GRAND}) g ON g.name = s.name""")
def stud_list(spark, sf):
    rated = stud_ratings(spark, sf).withColumns({"grade": F.lit(None).cast("string"), "final_score": F.col("avg_score"), "n_figli_totali": F.lit(0)})
    return answers.sires(a.studs(spark, sf), rated, pedigree_two_gen(spark, sf)).select("name", "stud_fee_eur", "avg_score", "ped_sire", "ped_dam")


@query(sql("SELECT name, earn_percentile, CASE WHEN earn_percentile >= 90 THEN 'top' WHEN earn_percentile >= 70 THEN 'high' WHEN earn_percentile >= 40 THEN 'middle' ELSE 'low' END AS band FROM ratings"))
def percentile_bands(spark, sf):
    return a.ratings(spark, sf).select("name", "earn_percentile", fs.band(F.col("earn_percentile")).alias("band"))


# queues


@query(sql(f"SELECT name, birth_year FROM horses WHERE name IN (SELECT horse_name FROM races WHERE race_date >= DATE '{a.AS_OF}' - 180) ORDER BY (key % 7), name LIMIT 300"))
def active_queue(spark, sf):
    visited = a.horses(spark, sf).withColumn("last_updated", F.col("key") % 7)
    return queues.active_queue(visited, a.races(spark, sf), as_of(), limit=300).select("name", "birth_year")


VISITS = "SELECT name, birth_year, CASE WHEN key % 3 = 0 THEN 'pending' ELSE 'done' END AS status, CASE WHEN key % 5 <> 1 THEN DATE '2000-01-01' + (key % 600)::INT END AS seen FROM horses"


@query(sql(f"SELECT name, seen::VARCHAR AS last_backfill_at FROM (SELECT *, status = 'pending' OR seen IS NULL OR seen < DATE '{a.AS_OF}' - 180 AS due FROM ({VISITS})) WHERE due ORDER BY seen NULLS FIRST, name LIMIT 250"))
def backfill_queue(spark, sf):
    k = F.col("key")
    visits = a.horses(spark, sf).withColumns({"backfill_status": F.when(k % 3 == 0, "pending").otherwise("done"), "last_backfill_at": F.when(k % 5 != 1, F.date_add(F.lit("2000-01-01").cast("date"), (k % 600).cast("int")))})
    return queues.backfill_queue(visits, as_of()).select("name", F.col("last_backfill_at").cast("string").alias("last_backfill_at"))


@query("SELECT m.day, m.track, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT n_name AS track, range::INT AS day FROM nation, range(0, 40)) m LEFT JOIN (SELECT n_name AS track, (c_custkey % 40)::INT AS day, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) s USING (track, day) WHERE coalesce(s.n, 0) < 3")
def gap_detection(spark, sf):
    nation = table(spark, sf, "nation")
    wanted = nation.select(F.col("n_name").alias("track"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("day"))
    stored = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("track"), (F.col("c_custkey") % 40).cast("int").alias("day"))
    return queues.missing_meetings(wanted, stored, ["track", "day"])


# merging


@query("""WITH o AS (SELECT o_custkey AS horse, o_orderdate::DATE::VARCHAR AS day, o_orderkey AS id FROM orders), f AS (SELECT * FROM o WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY horse, day ORDER BY id) = 1)
SELECT * FROM o WHERE id % 3 = 0 UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE id % 3 = 0 AND o.horse = f.horse AND o.day = f.day)""")
def insert_if_absent(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("horse"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderkey").alias("id"))
    return merge.insert_if_absent(o.filter("id % 3 = 0"), o.filter("id % 3 <> 0"), ["horse", "day"], [F.col("id")])


@query("SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT c_name, -1 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def insert_stubs(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    known = c.filter(k % 3 == 0).select(F.col("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("nation"))
    return merge.insert_stubs(known, c.filter(k % 2 == 0).select(F.col("c_name").alias("name")), ["name"], {"nation": F.lit(-1)})


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_acctbal END AS fee FROM supplier WHERE s_suppkey % 10 <> 9 UNION ALL SELECT s_suppkey + 100000, 0 FROM supplier WHERE s_suppkey % 10 = 9")
def replace_upsert(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("fee"))
    incoming = s.filter("id % 4 = 0 and id % 10 <> 9").withColumn("fee", F.lit(0.0)).unionByName(s.filter("id % 10 = 9").select((F.col("id") + 100000).alias("id"), F.lit(0.0).alias("fee")))
    return merge.replace_upsert(s.filter("id % 10 <> 9"), incoming, ["id"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END, c_mktsegment) ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 'ADDED'")
def coalesce_upsert(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    incoming = c.filter("id % 3 = 0").withColumn("segment", F.when(F.col("id") % 2 == 0, "NEW")).unionByName(spark.createDataFrame([(-1, "ADDED")], c.schema))
    return merge.coalesce_upsert(c, incoming, ["id"])


@query(sql("SELECT h.name, coalesce(s.career_races, -1) AS career_races FROM horses h LEFT JOIN stat s ON s.horse_name = h.name"))
def keyed_update(spark, sf):
    changes = career.career_stats(a.races(spark, sf)).select(F.col("horse_name").alias("name"), "career_races")
    return merge.keyed_update(a.horses(spark, sf).select("name", F.lit(-1).cast("long").alias("career_races")), changes, ["name"])


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_keys(spark, sf):
    gone = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return merge.delete_keys(table(spark, sf, "customer"), gone, ["c_nationkey"]).select("c_custkey")


@query("SELECT * FROM (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS key, floor(o_totalprice / 10000)::BIGINT AS score FROM orders) QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, id DESC) = 1")
def dedupe_best(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("key"), F.floor(F.col("o_totalprice") / 10000).alias("score"))
    return dedupe.keep_best(o, ["key"], "score", "id")


@query("SELECT o_custkey AS key, count(*) AS c FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return dedupe.duplicate_groups(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query(sql("SELECT name, count(*) AS races FROM (SELECT DISTINCT upper(horse_name) AS name, race_date FROM races) GROUP BY name"))
def merge_variants(spark, sf):
    """Every other race under a lower-case spelling, which the merge takes back; repeats on a day go."""
    spelled = a.races(spark, sf).withColumn("horse_name", F.when(F.col("id") % 2 == 0, F.lower("horse_name")).otherwise(F.upper("horse_name")))
    entities = a.horses(spark, sf).select(F.explode(F.array(F.lower("name"), F.upper("name"))).alias("name"), F.lit(2000).alias("birth_year"))
    _, merged = dedupe.merge_variants(entities, spelled, ["name", "birth_year"], ["horse_name", "race_date"], [F.col("id")])
    return merged.groupBy(F.col("horse_name").alias("name")).agg(F.count(F.lit(1)).alias("races"))


@query(sql("""SELECT (SELECT count(*) FROM horses WHERE key % 4 <> 1) + (SELECT count(DISTINCT horse_name) FROM races WHERE id % 3 <> 0 AND race_date >= DATE '1995-06-01' AND horse_name NOT IN (SELECT name FROM horses WHERE key % 4 <> 1)) AS horses,
(SELECT count(*) FROM horses WHERE key % 4 <> 1) AS horses_before, (SELECT count(*) FROM (SELECT id FROM races WHERE id % 3 = 0 UNION ALL (SELECT id FROM races r WHERE id % 3 <> 0 AND race_date >= DATE '1995-06-01'
AND NOT EXISTS (SELECT 1 FROM races q WHERE q.id % 3 = 0 AND q.horse_name = r.horse_name AND q.race_date = r.race_date) QUALIFY row_number() OVER (PARTITION BY horse_name, race_date ORDER BY race_code) = 1))) AS races,
(SELECT count(*) FROM races WHERE id % 3 = 0) AS races_before"""))
def nightly_counters(spark, sf):
    """Two thirds of the races come in, of which those since a day are taken; a quarter of the horses are unknown so far."""
    r = a.races(spark, sf)
    done = night.nightly(a.horses(spark, sf).filter("key % 4 <> 1"), r.filter("id % 3 = 0"), r.filter("id % 3 <> 0"), a.rankings(spark, sf), as_of(), "full", first_day="1995-06-01")
    return done.counters


NEW = "SELECT * FROM races WHERE id % 3 <> 0 AND id % 7 = 2"


@query(sql(f"""SELECT h.name, coalesce(s.career_races, 0) AS career_races, coalesce(s.career_wins, 0) AS career_wins, round(coalesce(s.e, 0), 2) AS career_earnings FROM horses h LEFT JOIN
(SELECT horse_name, count(placement) AS career_races, count(*) FILTER (placement = 1) AS career_wins, sum(CASE WHEN placement IS NOT NULL THEN prize_net ELSE 0 END) AS e FROM
(SELECT * FROM races WHERE id % 3 = 0 UNION ALL (SELECT * FROM ({NEW}) r WHERE NOT EXISTS (SELECT 1 FROM races q WHERE q.id % 3 = 0 AND q.horse_name = r.horse_name AND q.race_date = r.race_date) QUALIFY row_number() OVER (PARTITION BY horse_name, race_date ORDER BY id) = 1))
GROUP BY horse_name) s ON s.horse_name = h.name"""))
def careers_by_part(spark, sf):
    """New races recompute the careers of the parts that they fall in, by dynamic overwrite."""
    root, r = shared_path(spark, "careers"), a.races(spark, sf)
    parts.start(a.horses(spark, sf), r.filter("id % 3 = 0"), root)
    parts.merge_races(spark, root, r.filter("id % 3 <> 0 and id % 7 = 2"), [F.col("id")])
    return rounded_money(parts.stored_careers(spark, root).select("name", "career_races", "career_wins", "career_earnings"), "career_earnings")


@query(sql(f"SELECT key AS id, CASE WHEN key % 6 = 1 THEN 'done' WHEN key % 3 = 0 THEN 'pending' ELSE 'old' END AS backfill_status, CASE WHEN key % 6 = 1 THEN '{a.AS_OF}' END AS last_backfill_at FROM horses"))
def backfill_status(spark, sf):
    """Statuses set where a horse was visited, others left."""
    k = F.col("key")
    rows = a.horses(spark, sf).select(k.alias("id"), "key", F.when(k % 3 == 0, "pending").otherwise("old").alias("backfill_status"), F.lit(None).cast("date").alias("last_backfill_at"))
    return merge.set_status(rows, k % 6 == 1, F.lit("done"), as_of()).select("id", "backfill_status", F.col("last_backfill_at").cast("string").alias("last_backfill_at"))


@query("SELECT p_brand AS name, p_partkey::VARCHAR AS vp_id, left(p_brand, 1) AS first_letter FROM part WHERE p_size > 25 UNION ALL SELECT 'Z' || n_name, NULL, 'Z' FROM nation WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 25)")
def seeded_rankings(spark, sf):
    """Ranking rows with their first letter, conformed; the seed would take their place if there were none."""
    from ..functions import names

    rows = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("vp_id"), F.lit("loose").alias("eta"))
    seed = table(spark, sf, "nation").select(F.concat(F.lit("Z"), "n_name").alias("name"))
    return schemas.seeded(schemas.conform(rows, "rankings"), schemas.conform(seed, "rankings")).select("name", "vp_id", names.first_letter(F.col("name")).alias("first_letter"))


@query(sql("""SELECT horse_name, race_date, placement FROM (SELECT 'H' || c_custkey AS horse_name, '2024-01-01' AS race_date, n_name AS track, 1 AS placement FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 = 0
UNION ALL SELECT 'H' || c_custkey, '2024-01-01', n_name, (c_custkey % 9 + 1)::INT FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_custkey % 5 <> 0 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1 HAVING count(*) >= 3))"""))
def gap_driven_results(spark, sf):
    """Meetings with fewer than three runners stored are read from their result pages; the runners not known are inserted."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k, day = F.col("c_custkey"), F.lit("2024-01-01")
    stored = c.filter(k % 5 == 0).select(F.concat(F.lit("H"), k).alias("horse_name"), day.cast("date").alias("race_date"), F.lower("n_name").alias("track"), F.lit(1).alias("placement"), F.lit("r").alias("race_code"))
    row = F.format_string('<tr><td class="piaz x">%dº</td><td class="nome_cav">h%d</td></tr>', k % 9 + 1, k)
    html = F.concat(F.lit('<div id="dati_corsa"><table id="tabella_risultati">'), F.array_join(F.collect_list(row), ""), F.lit("</table></div>"))
    made = c.groupBy("n_name").agg(html.alias("html")).select(F.concat(F.lit("u/"), "n_name").alias("url"), "html")
    meetings = table(spark, sf, "nation").select(day.alias("data"), F.upper(F.substring("n_name", 1, 2)).alias("sigla"), F.col("n_name").alias("ippodromo"), F.lit("").alias("note_giorno"), F.concat(F.lit("u/"), "n_name").alias("url"))
    after = night.missing_results(stored, meetings, made)
    return after.select("horse_name", F.col("race_date").cast("string").alias("race_date"), "placement")


@query(sql("""SELECT upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, 'SIRE D''OR ' || c_nationkey AS sire, count(o_orderkey) FILTER (o_orderkey % 5 < 4) AS career_races, count(o_orderkey) FILTER (o_orderkey % 5 < 4 AND o_orderkey % 12 = 0) AS career_wins
FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderdate::DATE::VARCHAR || '_' || o_orderkey) = 1) o ON o_custkey = c_custkey GROUP BY ALL"""))
def career_page_merge(spark, sf):
    """Career pages of all horses: profiles fill what is unknown, races come in once a day, careers are computed anew."""
    from .page_queries import career_pages

    known = a.horses(spark, sf).select(F.upper("name").alias("name"), F.lit(None).cast("string").alias("sex"), F.lit(None).cast("string").alias("country"), "birth_year", F.lit(None).cast("string").alias("sire"), F.lit(None).cast("string").alias("dam"))
    none = spark.createDataFrame([], schemas.schema("races")).drop("id")
    merged, _ = night.full_careers(known, none, career_pages(spark, sf), as_of(), first_day="1990-01-01")
    return merged.select("name", "sex", "sire", "career_races", "career_wins")


# text and JSON


@query("SELECT doc_id, replace(upper(trim(regexp_replace(regexp_replace(left(text, 2000), '[\\x{200B}-\\x{200F}\\x{FEFF}\\x{2060}\\x{AD}]', ' ', 'g'), '[\\s\\x{A0}]+', ' ', 'g'))), 'ẞ', 'SS') AS name FROM documents".replace("left(text, 2000)", "text"))
def normalize_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.canonical_name(F.col("text")).alias("name"))


@query("""SELECT page_id, (i - 1)::INT AS position, l[i] AS link FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), unnest(range(1, len(l) + 1)) AS r(i)""")
def page_links(spark, sf):
    return page_ops.page_links(table(spark, sf, "pages"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
CASE WHEN o_orderkey % 3 < 2 THEN round(floor(o_totalprice) + 0.5, 2) ELSE 0 END AS prize FROM orders""")
def parse_fields(spark, sf):
    """Dates and prizes written in the pages' formats and read back."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-M-d")).otherwise("no date")
    money = F.when(k % 3 < 2, F.concat(F.regexp_replace(F.floor("o_totalprice").cast("string"), r"(\d)(?=(\d{3})+$)", "$1."), F.lit(",50"))).otherwise("none")
    return o.select("o_orderkey", fp.iso_date(day).alias("day"), fp.local_number(money).alias("prize"))


@query(sql("""SELECT name, nationality, CASE nationality WHEN 'USA' THEN '🇺🇸' WHEN 'SWE' THEN '🇸🇪' WHEN 'FRA' THEN '🇫🇷' WHEN 'ITA' THEN '🇮🇹' END AS flag FROM (SELECT name, CASE WHEN key % 11 = 1 THEN 'SWE' WHEN key % 7 = 1 THEN 'FRA' WHEN key % 5 = 1 THEN 'USA' ELSE 'ITA' END AS nationality FROM horses
UNION ALL SELECT 'Muscle Hill', 'USA')"""))
def nationalities(spark, sf):
    """From three sources in order, then the well-known sires, then the default."""
    h = a.horses(spark, sf).select("name", "key")
    some = lambda n, code, out: h.filter(F.col("key") % n == 1).select(F.upper("name").alias("name"), F.lit(code).alias(out))
    names = h.select("name").unionByName(spark.createDataFrame([("Muscle Hill",)], "name string"))
    return answers.nationality_of(names, some(11, "SWE", "nationality"), some(7, "fra", "country"), some(5, "USA", "country"))


@query(sql(f"SELECT name, sire, dam, sire_sire, sire_dam, dam_sire, dam_dam FROM ({GRAND}) WHERE name IN ('Customer#000000041', 'Customer#000000012')"))
def compare_pedigree(spark, sf):
    return answers.compare_pedigrees(a.family(spark, sf), ["Customer#000000041", "Customer#000000012"])


@query(sql(f"""SELECT count(*) AS n FROM (SELECT DISTINCT name FROM (SELECT sire AS name FROM family UNION ALL SELECT dam FROM family) WHERE name IS NOT NULL AND name <> ''
AND name IN (SELECT name FROM ({GRAND}) WHERE sire_sire IS NOT NULL AND sire_dam IS NOT NULL AND dam_sire IS NOT NULL AND dam_dam IS NOT NULL))"""))
def complete_parents(spark, sf):
    return pedigree.already_complete(a.family(spark, sf), pedigree_two_gen(spark, sf))


@query(sql("SELECT r.name, r.birth_year, r.grade, round(r.career_earnings, 2) AS career_earnings, rank FROM (SELECT *, (row_number() OVER (ORDER BY career_earnings DESC, name, birth_year))::INT AS rank FROM ratings WHERE grade = 'B' AND sire ILIKE '%sire 1%') r WHERE rank <= 10"))
def leaderboard_filtered(spark, sf):
    """By earnings, within a grade and sires whose name has a part."""
    return rounded_money(answers.leaderboard(spark, a.leaderboard(spark, sf, "earnings"), limit=10, grade="B", sire="sire 1").select("name", "birth_year", "grade", "career_earnings", "rank"), "career_earnings")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS rank FROM customer")
def update_by_normalised_name(spark, sf):
    """Changes keyed by another spelling of the name; a null change leaves what is there."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("rank"))
    changes = c.filter(k % 3 == 0).select(F.concat(F.lit("  "), F.lower("c_name")).alias("name"), F.when(k % 2 == 0, F.col("c_nationkey") + 100).alias("rank"))
    return merge.keyed_update(rows, changes, ["name"], overwrite=False, by=fn.canonical_name).select("id", "rank")


@query(sql("SELECT name, key % 4 = 1 AS is_new, CASE WHEN key % 4 <> 1 THEN birth_year END AS birth_year FROM horses WHERE name IN (SELECT horse_name FROM races)"))
def known_or_new(spark, sf):
    return merge.known_or_new(a.horses(spark, sf).filter("key % 4 <> 1"), a.races(spark, sf).select(F.col("horse_name").alias("name")), "name", "birth_year")


# the pairing model


@query("SELECT median(p_size)::DOUBLE AS p_size, median(p_retailprice) AS p_retailprice FROM part")
def feature_medians(spark, sf):
    return breeding.medians(table(spark, sf, "part"), ("p_size", "p_retailprice"))


FEATURE_SQL = ", ".join(f"{p}.{c}::DOUBLE AS {p}_{n}" for p in ("s", "m") for n, c in (("time", "time_percentile"), ("earn", "earn_percentile"), ("win", "win_rate"), ("score", "score"), ("races", "career_races")))


@query(sql(f"""SELECT f.name, f.grade, f.score, {FEATURE_SQL}, ds.time_percentile AS ds_time, ss.time_percentile AS ss_time, (f.grade IN ('D', 'E', 'F'))::INT AS poor FROM ratings f JOIN family h ON h.name = f.name JOIN ratings s ON s.name = h.sire JOIN ratings m ON upper(m.name) = upper(trim(h.dam))
LEFT JOIN family hm ON upper(hm.name) = upper(trim(h.dam)) LEFT JOIN ratings ds ON ds.name = hm.sire LEFT JOIN family hs ON hs.name = h.sire LEFT JOIN ratings ss ON ss.name = hs.sire"""))
def breeding_features(spark, sf):
    return breeding.training_rows(a.ratings(spark, sf), a.family(spark, sf)).withColumn("poor", fs.is_poor(F.col("grade")))


@query(sql("SELECT grade, round(avg(career_earnings), 2) AS avg_earnings, count(*) AS n FROM ratings GROUP BY grade"))
def grade_earnings(spark, sf):
    return breeding.grade_earnings(a.ratings(spark, sf)).withColumn("avg_earnings", F.round("avg_earnings", 2))


def toy_trees(n: int = 4) -> list[tuple[list[int], list[float], list[float]]]:
    """Small trees by a rule, for scoring against the oracle: (features, thresholds, leaves) of a heap of depth 3."""
    return [([(3 * t + k) % 8 for k in range(7)], [((5 * t + 3 * k) % 7 - 3) / 20 for k in range(7)], [((7 * t + k) % 11 - 5) / 4 for k in range(8)]) for t in range(n)]


def _nested(tree, node: int = 1) -> str:
    f, th, lf = tree
    if node >= 8:
        return repr(lf[node - 8])
    return f"CASE WHEN x[{f[node - 1] + 1}] <= {th[node - 1]!r} THEN {_nested(tree, 2 * node)} ELSE {_nested(tree, 2 * node + 1)} END"


@query("SELECT vec_id, round(10 + 0.08 * (" + " + ".join(f"({_nested(t)})" for t in toy_trees()) + "), 9) AS score FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)")
def tree_score(spark, sf):
    trees = F.array(*(F.struct(F.array(*map(F.lit, f)).alias("f"), F.array(*map(F.lit, th)).alias("th"), F.array(*map(F.lit, lf)).alias("lf")) for f, th, lf in toy_trees()))
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(breeding.ensemble(x, trees, F.lit(10.0), F.lit(0.08)), 9).alias("score"))


@query(sql("""SELECT r.birth_year, round(1 - sum((r.score - c.score) ** 2) / (var_pop(r.score) * count(*)), 9) AS r2, round((SELECT sum(CASE WHEN x.e > y.e THEN 1 WHEN x.e = y.e THEN 0.5 ELSE 0 END)::DOUBLE / count(*)
FROM (SELECT earn_percentile AS e FROM ratings p WHERE grade IN ('D', 'E', 'F') AND p.birth_year = r.birth_year) x, (SELECT earn_percentile AS e FROM ratings q WHERE grade NOT IN ('D', 'E', 'F') AND q.birth_year = r.birth_year) y), 9) AS auc, count(*) AS n
FROM ratings r JOIN (SELECT name, birth_year, least(earn_percentile, 100) AS score FROM ratings) c ON c.name = r.name AND c.birth_year = r.birth_year GROUP BY r.birth_year"""))
def score_figures(spark, sf):
    """How well earnings alone tell the score and a poor grade, year by year: R2, and the area under the curve by pairs."""
    rows = a.ratings(spark, sf).withColumn("poor", fs.is_poor(F.col("grade")))
    told = figures.r2(rows, "score", "earn_percentile", ["birth_year"]).withColumn("r2", F.round("r2", 9))
    area = figures.area_under_curve(rows, "poor", "earn_percentile", ["birth_year"]).select("birth_year", F.round("auc", 9).alias("auc"))
    return told.join(area, "birth_year").select("birth_year", "r2", "auc", "n")


@query()
def train_models(spark, sf):
    """Regression and classification, with the operator's defaults: the figures of cross-validation, from the document that was trained."""
    made = a.model(spark, sf)  # one row or none
    return made.agg(F.max("cv_r2_score").alias("cv_r2_score"), F.max("cv_auc_poor").alias("cv_auc_poor"), F.coalesce(F.max("n_samples"), F.lit(0)).cast("long").alias("n_samples"))


@query(sql("SELECT name, birth_year, 2::BIGINT AS n FROM ratings WHERE score >= 50"))
def schema_check(spark, sf):
    """Ratings conformed to their table, the better ones twice: the keys that break its uniqueness."""
    conformed = schemas.conform(a.ratings(spark, sf), "horse_ratings")
    return schemas.key_violations(conformed.unionByName(conformed.filter("score >= 50")), "horse_ratings").select("name", "birth_year", F.col("count").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who are the top-rated horses?"""
    return answers.leaderboard(spark, a.leaderboard(spark, sf_dir)).select("rank", "name", "birth_year", "sire", "grade", "score", "career_races", "career_wins", "career_earnings", "win_rate", "total", "pages")


from . import model_queries, page_queries, stream_queries  # noqa: E402, F401  they register their own
