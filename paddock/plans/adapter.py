"""The driver's tables as domain tables, by expressions that Spark and the oracle's SQL both have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import breeding, models
from ..operators.career import careers as with_careers
from ..operators.ratings import rate
from ..operators.sires import competition_rank, ranking_rollup, running_progeny, sire_stats
from ..session import table
from . import answers
from .store import stored, stored_folder

AS_OF = "2001-08-01"


def horses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; the nation is the sire, which one in nine spells its own way; one in fifty has no year of birth."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("name"),
        F.when(key % 50 != 7, (2000 + key % 20).cast("int")).alias("birth_year"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(key % 9 == 4, F.concat(F.lit(" Sire "), F.col("c_nationkey"), F.lit(" "))).otherwise(F.concat(F.lit("SIRE "), F.col("c_nationkey"))).alias("sire"),
        key.alias("key"),
    )


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with customers for parents, half and a third of the key; one in seven spells its dam in capitals and blanks."""
    key = F.col("key")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(F.floor(k).cast("string"), 9, "0"))
    return horses(spark, sf_dir).withColumns({"sire": F.when(key >= 2, name(key / 2)), "dam": F.when(key >= 3, F.when(key % 7 == 5, F.concat(F.upper(name(key / 3)), F.lit("  "))).otherwise(name(key / 3)))})


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; those of status F, and all of one customer in thirteen, did not finish; times come in all three formats and as a code."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    s, t = (10 + k % 9).cast("string"), (k % 10).cast("string")
    time = F.when(k % 4 == 0, F.concat(F.lit("1'"), s, F.lit('"'), t)).when(k % 4 == 1, F.concat(F.lit("1."), s, F.lit("."), t)).when(k % 4 == 2, F.concat(s, F.lit("."), t)).otherwise("r.p.")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("horse_name"),
        F.col("o_orderdate").cast("date").alias("race_date"),
        F.when((F.col("o_orderstatus") != "F") & (F.col("o_custkey") % 13 != 4), F.substring("o_orderpriority", 1, 1).cast("int")).alias("placement"),
        time.alias("time_km"),
        F.col("o_totalprice").alias("prize_net"),
        k.cast("string").alias("race_code"),
    )


def careers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "careers", lambda: with_careers(horses(spark, sf_dir), races(spark, sf_dir)))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "ratings", lambda: rate(careers(spark, sf_dir)))


def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand: brand n is the sire of nation n - 1."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("SIRE "), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - 1).alias("name"),
        F.col("p_partkey").cast("string").alias("vp_id"),
        F.col("p_size").alias("prodotti"),
        F.floor("p_retailprice").cast("long").alias("somme_vinte"),
        F.floor(F.col("p_retailprice") / F.col("p_size")).cast("long").alias("media"),
        F.col("p_partkey").alias("ord"),
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competition_rank(ranking_rollup(ranking_rows(spark, sf_dir)))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def derive() -> DataFrame:
        running = running_progeny(horses(spark, sf_dir), races(spark, sf_dir), F.lit(AS_OF).cast("date"))
        return sire_stats(ratings(spark, sf_dir), rankings(spark, sf_dir), running)

    return stored(spark, sf_dir, "stats", derive)


def studs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers; in stud when in credit; each carries the name of the customer of its key."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")).alias("name"),
        F.when(k % 11 != 3, F.col("s_acctbal")).alias("stud_fee_eur"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("retired").alias("stud_status"),
        F.col("s_name").alias("stud_farm"),
    )


def horse_index(spark: SparkSession, sf_dir: str):
    """Rated horses by their names."""
    return stored_folder(spark, sf_dir, "horse-index", lambda path: answers.name_index(answers.with_rating(horses(spark, sf_dir), ratings(spark, sf_dir)), "name", path))[1]


def sire_index(spark: SparkSession, sf_dir: str):
    return stored_folder(spark, sf_dir, "sire-index", lambda path: answers.name_index(stats(spark, sf_dir), "sire", path))[1]


def leaderboard(spark: SparkSession, sf_dir: str, sort: str = "score"):
    return stored_folder(spark, sf_dir, f"leaderboard-{sort}", lambda path: answers.store_leaderboard(ratings(spark, sf_dir), path, sort))[1]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breeding.training_rows(ratings(spark, sf_dir), family(spark, sf_dir))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model document trained on the given tables, with the operator's defaults, by the first who asks; no row if there were too few to train on."""

    def build(path: str) -> bool:
        rows = training_rows(spark, sf_dir)
        made = breeding.train(rows)
        if made:
            middle = breeding.medians(rows).first().asDict()
            text = models.document(*made, middle, breeding.grade_earnings(ratings(spark, sf_dir)), f"{AS_OF}T00:00:00Z")
            models.write_model(spark, text, path)
        return bool(made)

    path, there = stored_folder(spark, sf_dir, "model", build)
    return models.read_model(spark, path) if there else models.parse_model(spark.createDataFrame([], "value string"))


def sire_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For the pages of sires: names in another spelling (one of them of nobody), their stud entries, own rows among all horses, and pedigrees, from the nations."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = F.concat(F.lit("SIRE "), k)
    customer = lambda i: F.concat(F.lit("Customer#"), F.lpad(i.cast("string"), 9, "0"))
    names = n.select(F.concat(F.lit(" sire "), F.when(k == 7, -1).otherwise(k)).alias("name"))
    studs_ = n.filter(k % 2 == 0).select(
        F.concat(F.lower(name), F.lit(" ")).alias("name"), F.when(k % 6 != 4, k * 100.0).alias("stud_fee_eur"), F.col("n_name").alias("stud_farm"), F.lit("active").alias("stud_status"),
        F.when(k % 4 == 0, F.substring("n_name", 1, 3)).alias("country"), (k * 1000.0).alias("progeny_earnings_2024"), (k / 2).alias("media_in_corsa"), k.cast("int").alias("tot_prod"),
    )
    own = n.filter(k % 3 == 0).select(name.alias("name"), F.when(k % 9 != 3, customer(k + 9)).alias("sire"), customer(k + 2).alias("dam"), F.lit("ITA").alias("country"))
    rows = own.unionByName(family(spark, sf_dir).select("name", "sire", "dam", F.lit(None).cast("string").alias("country")))
    sheet = n.filter(k % 2 == 1).select(name.alias("name"), F.concat(F.lit("P"), k).alias("sire"), F.lit("").alias("dam"), *(F.lit(None).cast("string").alias(c) for c in ("sire_sire", "sire_dam", "dam_sire")), F.col("n_name").alias("dam_dam"), F.when(k % 3 == 1, "FRA").alias("nationality"))
    return names, studs_, rows, sheet
