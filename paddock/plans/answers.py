"""The questions that users ask: search, profiles, leaderboards, comparisons, summaries and the pairing advisor.

Answers are DataFrames; every order ends in a unique tie-breaker, and limits are kept within bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.names import flag, nationality, plain_key, truthy
from ..functions.scoring import GRADE_WEIGHTS, rounded
from ..operators import ranges, search
from ..operators.pedigree import ANCESTORS, ancestor_names, grandparents

GRADES = tuple(GRADE_WEIGHTS)


def with_rating(horses: DataFrame, ratings: DataFrame) -> DataFrame:
    rated = ratings.select("name", "birth_year", "grade", "score", "rating_mode")
    return horses.join(rated, ["name", "birth_year"], "left")


def name_index(rows: DataFrame, column: str, path: str) -> search.Index:
    """What the searches below read: rows with all columns that they show, indexed by name."""
    return search.build(rows, column, path)


def search_horse(spark: SparkSession, index: search.Index, term: str, most: int = 20) -> DataFrame:
    """``index`` is over horses ``with_rating``."""
    shown = search.search(spark, index, term).select("name", "birth_year", "sire", "sex", "grade", "score", "rating_mode")
    return shown.orderBy(F.col("score").desc_nulls_last(), "name", "birth_year").limit(most)


def search_sire(spark: SparkSession, index: search.Index, term: str, most: int = 20) -> DataFrame:
    """``index`` is over the statistics of sires."""
    columns = ["n_figli_totali", "n_in_corsa", "avg_score", "n_SSS", "n_SS", "n_S", "pct_top_S"]
    hits = search.search(spark, index, term).select(F.col("sire").alias("name"), *columns).distinct()
    return hits.orderBy(F.desc("avg_score"), "name").limit(most)


def suggestions(spark: SparkSession, index: search.Index, term: str, most: int = 5) -> DataFrame:
    """Mares, or horses of unknown sex, when a name is not found."""
    hits = search.search(spark, index, term).filter((F.col("sex") == "F") | F.col("sex").isNull())
    return hits.select("name", "birth_year").orderBy("name", "birth_year").limit(most)


def horse_profile(horses: DataFrame, ratings: DataFrame, name: str, year: int) -> DataFrame:
    """The horse with its rating and two generations, 0 or 1 row."""
    one = horses.filter((F.col("name") == name) & (F.col("birth_year") == year))
    return grandparents(with_rating(one, ratings), parents_asked(one, horses))


def parents_asked(one: DataFrame, horses: DataFrame) -> DataFrame:
    """The rows of ``horses`` that are sire or dam of a few, by plain key: nobody else's parents are aggregated."""
    keys = one.select(F.explode(F.array("sire", "dam")).alias("__c")).select(plain_key(F.col("__c")).alias("__c")).filter("__c <> ''").distinct()
    return horses.join(F.broadcast(keys), plain_key(F.col("name")) == F.col("__c"), "left_semi")  # two for each horse asked for


def last_races(races: DataFrame, name: str, most: int = 20) -> DataFrame:
    return races.filter(F.col("horse_name") == name).orderBy(F.desc("race_date"), F.desc("id")).limit(most)


def half_siblings(horses: DataFrame, ratings: DataFrame, name: str, year: int, most: int = 6) -> DataFrame:
    own = horses.filter((F.col("name") == name) & (F.col("birth_year") == year)).select(plain_key(F.col("sire")).alias("__sire")).limit(1)
    kin = horses.join(F.broadcast(own), plain_key(F.col("sire")) == F.col("__sire"), "left_semi").filter(~((F.col("name") == name) & (F.col("birth_year") == year)))
    return with_rating(kin, ratings).select("name", "birth_year", "grade", "score").orderBy(F.col("score").desc_nulls_last(), "name").limit(most)


def sire_pages(names: DataFrame, stats: DataFrame, studs: DataFrame, ratings: DataFrame, horses: DataFrame, pedigree: DataFrame, most: int = 20) -> DataFrame:
    """All that a sire's page shows, a row for each of ``names`` that is known anywhere, whatever its spelling; any number of names.

    Statistics, with 0 for counts that are missing; the best paid stud entry; the ``most`` best earning progeny of the performance ratings, over
    which the highest earnings and the mean win rate are taken (null without progeny, and what they lack counts 0); grades by
    how often they occur; two generations of the sire's own row if that names a sire, else of the pedigree table; the nationality that is told first.
    """
    asked = names.select(plain_key(F.col("name")).alias("__k")).filter("__k <> ''").distinct()
    of = lambda df, c: df.join(asked, plain_key(df[c]) == asked["__k"])
    kids = of(ratings.filter("rating_mode = 'performance'"), "sire")
    rank = F.row_number().over(Window.partitionBy("__k").orderBy(F.col("career_earnings").desc_nulls_last(), "name", "birth_year"))
    child = F.struct(F.col("__rank").alias("rank"), "name", "birth_year", "grade", "score", "career_earnings", "record_career", "win_rate", "sire_percentile")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    top = kids.withColumn("__rank", rank).filter(F.col("__rank") <= most).groupBy("__k").agg(F.array_sort(F.collect_list(child)).alias("children"), F.max(zero("career_earnings")).alias("max_earnings"), F.avg(zero("win_rate")).alias("avg_win_rate"))
    grades = kids.groupBy("__k", "grade").agg(F.count(F.lit(1)).alias("cnt"))
    spread = grades.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("least"), "grade"))).alias("__g"))
    spread = spread.select("__k", F.transform("__g", lambda g: F.struct(g["grade"].alias("grade"), (-g["least"]).alias("cnt"))).alias("grade_distribution"))
    paid = F.struct("stud_fee_eur", "stud_farm", "stud_status", "progeny_earnings_2024", "media_in_corsa", "tot_prod")
    stud = of(studs, "name").groupBy("__k").agg(F.max_by(F.struct(paid.alias("stud"), "country"), F.struct("stud_fee_eur", "name")).alias("__stud"))
    stud = stud.select("__k", "__stud.stud", F.col("__stud.country").alias("__stud_country"))
    own = of(horses, "name")
    has = set(horses.columns)
    either = lambda c: truthy(F.col(c), F.col(f"unire_{c}")) if f"unire_{c}" in has else F.nullif(F.col(c), F.lit(""))
    own = own.groupBy("__k").agg(F.max_by(F.struct(either("sire").alias("sire"), either("dam").alias("dam"), "country"), F.struct(either("sire").isNotNull(), "sire", "dam")).alias("__own")).select("__k", "__own.sire", "__own.dam", F.col("__own.country").alias("__own_country"))
    line = grandparents(own, parents_asked(own, horses.withColumns({c: either(c) for c in ("sire", "dam")})))
    tree = lambda: F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in ANCESTORS))
    line = line.select("__k", F.when(F.col("sire").isNotNull(), tree()).alias("__line"), "__own_country")
    sheet = of(pedigree, "name").groupBy("__k").agg(F.min(F.struct(*ANCESTORS, "nationality")).alias("p")).select("__k", "p.*").select("__k", tree().alias("__sheet"), F.col("nationality").alias("__told"))
    known = of(stats, "sire").select("__k", F.struct(*stats.columns).alias("__s"))
    joined = asked
    for part in (known, stud, top, spread, line, sheet):
        joined = joined.join(part, "__k", "left")
    counts = ["n_figli_totali", "n_in_corsa", *(f"n_{g}" for g in GRADES)]
    there = F.col("__s").isNotNull()
    found = joined.filter(there | F.col("stud").isNotNull() | F.col("__sheet").isNotNull() | F.col("children").isNotNull())
    return found.select(
        F.coalesce("__s.sire", "__k").alias("sire"),
        *(F.coalesce(F.col(f"__s.{c}"), F.lit(0)).alias(c) for c in counts),
        *(F.col(f"__s.{c}").alias(c) for c in ("avg_score", "grade", "final_score", "pct_top_S", "avg_earnings")),
        zero("__s.vp_boost").alias("vp_boost"),
        "max_earnings",
        "avg_win_rate",
        "stud",
        F.coalesce("children", F.array().cast(f"array<{joined.schema['children'].dataType.elementType.simpleString()}>")).alias("children"),
        F.coalesce("grade_distribution", F.array().cast(f"array<{joined.schema['grade_distribution'].dataType.elementType.simpleString()}>")).alias("grade_distribution"),
        F.coalesce("__line", "__sheet").alias("pedigree"),
        truthy(F.col("__told"), F.col("__stud_country"), F.col("__own_country")).alias("nationality"),
        (~there & F.col("children").isNull()).alias("no_offspring_data"),
        there.alias("has_offspring_data"),
    )


def nationality_of(names: DataFrame, pedigree: DataFrame, studs: DataFrame, horses: DataFrame) -> DataFrame:
    """``name, nationality, flag``: of the pedigree, else of the stud, else of the horse, by plain key; then that of a
    well-known sire, then the default. Of rows that share a name the last in order counts."""
    key = plain_key(F.col("name"))
    joined = names.select("name")
    for i, (df, c) in enumerate(((pedigree, "nationality"), (studs, "country"), (horses, "country"))):
        one = df.groupBy(key.alias(f"__k{i}")).agg(F.max(F.nullif(F.col(c), F.lit(""))).alias(f"__n{i}"))
        joined = joined.join(one, key == F.col(f"__k{i}"), "left")
    given = F.coalesce("__n0", "__n1", "__n2")
    return joined.select("name", nationality(given, F.trim("name")).alias("nationality"), flag(given, F.trim("name")).alias("flag"))


def compare_pedigrees(horses: DataFrame, names: list[str]) -> DataFrame:
    """Two generations of the horses compared, a row each."""
    some = horses.filter(F.col("name").isin(*names))
    return grandparents(some, parents_asked(some, horses)).select("name", "sire", "dam", "sire_sire", "sire_dam", "dam_sire", "dam_dam")


SORTS = {"score": "score", "earnings": "career_earnings"}


#: What a leaderboard's rows are counted by.
FACETS = {"mode": "rating_mode", "year": "birth_year", "grade": "grade"}


def store_leaderboard(ratings: DataFrame, path: str, sort: str = "score") -> ranges.Ranked:
    """The ratings in the order of the leaderboard; ``sort`` is 'score' or 'earnings', and anything else the score."""
    return ranges.store_ranked(ratings, path, [(SORTS.get(sort, "score"), False), ("name", True), ("birth_year", True)], list(FACETS.values()))


def leaderboard(spark: SparkSession, stored: ranges.Ranked, page: int = 1, limit: int = 25, mode: str = "performance", year: int | None = None, grade: str | None = None, sire: str | None = None) -> DataFrame:
    """A page of the ratings of that mode, year, grade and part of a sire's name, with the rank over all pages and the total in each row.

    Whatever the page, the ranges that it lies in are read, and no others (with a sire, they are after its rows were counted).
    """
    facets = {FACETS["mode"]: mode} | ({FACETS["year"]: year} if year is not None else {}) | ({FACETS["grade"]: grade} if grade else {})
    return ranges.page(spark, stored, max(1, page), max(1, min(50, limit)), facets, F.col("sire").ilike(f"%{sire}%") if sire else None)


def years(ratings: DataFrame) -> DataFrame:
    return ratings.filter("birth_year is not null").select("birth_year").distinct().orderBy(F.desc("birth_year"))


def compare(ratings: DataFrame, first: tuple[str, int | None], second: tuple[str, int | None], higher: list[str], lower: list[str]) -> DataFrame:
    """A row a metric: both values and whether either is better; a missing value never wins."""

    def pick(key, n):
        rows = ratings.filter(F.col("name") == key[0])
        rows = rows.filter(F.col("birth_year") == key[1]) if key[1] is not None else rows
        values = F.map_from_arrays(F.array(*(F.lit(m) for m in [*higher, *lower])), F.array(*(F.col(m).cast("double") for m in [*higher, *lower])))
        return rows.orderBy(F.desc("birth_year")).limit(1).select(F.explode(values).alias("metric", f"value{n}"))

    both = pick(first, 1).join(pick(second, 2), "metric", "full_outer")
    up = F.col("metric").isin(*higher)
    wins = lambda a, b: F.coalesce(F.when(up, F.col(a) > F.col(b)).otherwise(F.col(a) < F.col(b)), F.lit(False))
    return both.withColumns({"wins1": wins("value1", "value2"), "wins2": wins("value2", "value1")})


def sires(studs: DataFrame, stats: DataFrame, pedigree: DataFrame) -> DataFrame:
    """All studs with their ratings and parents, best score first."""
    s = stats.select(plain_key(F.col("sire")).alias("__k"), "avg_score", "grade", "final_score", "n_figli_totali", "n_in_corsa", "pct_top_S", "avg_earnings")
    p = pedigree.select(plain_key(F.col("name")).alias("__p"), F.col("sire").alias("ped_sire"), F.col("dam").alias("ped_dam"))
    joined = studs.join(s, plain_key(F.col("name")) == F.col("__k"), "left").join(p, plain_key(F.col("name")) == F.col("__p"), "left").drop("__k", "__p")
    return joined.orderBy(F.coalesce("final_score", "avg_score", F.lit(0)).desc(), "name")


def histogram(ratings: DataFrame) -> DataFrame:
    """All grades in order, with counts and shares of the total in percent; grades without rows have 0."""
    counts = ratings.groupBy("grade").agg(F.count(F.lit(1)).alias("cnt"))
    order = ratings.sparkSession.createDataFrame([(i, g) for i, g in enumerate(GRADES)], "position int, grade string")
    filled = order.join(counts, "grade", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    total = F.sum("cnt").over(Window.partitionBy())
    return filled.withColumn("share", rounded(F.coalesce(F.try_divide(F.col("cnt") * 100.0, total), F.lit(0.0))))


def best_of_year(ratings: DataFrame) -> DataFrame:
    """The best score of each year of birth, the missing year included; years without scores are left out."""
    best = F.struct(F.col("score"), F.col("career_earnings"), F.col("name"))
    top = ratings.filter("score is not null").groupBy("birth_year").agg(F.max(best).alias("b"), F.max_by("grade", best).alias("grade"))
    return top.select("birth_year", "b.name", "grade", "b.score", "b.career_earnings")


def totals(horses: DataFrame, races: DataFrame, stats: DataFrame) -> DataFrame:
    one = horses.agg(F.count(F.lit(1)).alias("horses"))
    return one.join(races.agg(F.count(F.lit(1)).alias("races"))).join(stats.agg(F.countDistinct("sire").alias("sires")))  # one row each


def advise(mares: DataFrame, horses: DataFrame, studs: DataFrame, stats: DataFrame, budget: float | None = None, most: int = 15) -> DataFrame:
    """For each mare the best active and priced studs that are none of her ancestors; any number of mares.

    Studs are ranked first, one row a plain key, the best rated and then the cheapest of it: at most six ancestors can fall
    out, so only so many more than ``most`` are met with a mare.
    """
    priced = studs.filter("stud_fee_eur is not null and stud_status = 'active'")
    priced = priced.filter(F.col("stud_fee_eur") <= budget) if budget else priced
    known = stats.select(plain_key(F.col("sire")).alias("__sire"), "avg_score", "n_in_corsa", "pct_top_S", "avg_earnings")
    rated = priced.join(known, plain_key(F.col("name")) == F.col("__sire"))
    first = F.max_by(F.struct("name", "stud_fee_eur", "avg_score", "n_in_corsa", "pct_top_S", "avg_earnings"), F.struct("avg_score", -F.col("stud_fee_eur"), "name"))
    best = rated.groupBy("__sire").agg(first.alias("b")).select("b.*").orderBy(F.desc("avg_score"), "name").limit(most + 6)  # a bounded side for the join
    ancestors = ancestor_names(horses).join(mares.select("name").distinct(), "name", "left_semi").withColumnRenamed("name", "mare")
    met = ancestors.join(F.broadcast(best), ~F.array_contains("ancestors", plain_key(F.col("name"))))
    rank = F.row_number().over(Window.partitionBy("mare").orderBy(F.desc("avg_score"), "name"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).drop("ancestors")
