"""Explicit schemas of the domain tables: nothing is inferred, and tables grow by nullable columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TABLES = {
    "horses": "name string, birth_year int, sex string, country string, sire string, dam string, unire_sire string, unire_dam string, career_races int, career_wins int, career_places int, career_earnings double, record_career string, record_short string, record_long string, last_updated timestamp_ntz, backfill_status string, last_backfill_at timestamp_ntz",
    "races": "id bigint, horse_name string, race_date date, track string, placement int, placement_raw string, time_km string, distance int, driver string, prize_net double, prize_gross double, race_code string",
    "horse_ratings": "name string, birth_year int, sire string, grade string, score double, earn_percentile double, time_percentile double, sire_percentile double, career_races int, career_wins int, career_earnings double, record_career string, win_rate double, rating_mode string, last_updated timestamp_ntz",
    "stallion_rating_stats": "sire string, n_figli_totali int, n_in_corsa int, avg_score double, grade string, n_SSS int, n_SS int, n_S int, pct_top_S double, avg_earnings double, vp_boost double, final_score double, last_updated timestamp_ntz",
    "stallions": "name string, stud_fee_eur double, stud_farm string, stud_status string, country string, progeny_earnings_2024 double, media_in_corsa double, tot_prod int, tot_in_corsa int, perc_in_corsa double, tot_vitt int, perc_vitt double, vp_total_offspring int, vp_total_earnings_eur double, vp_avg_earnings_eur double, vp_rank int, vp_id string, last_updated timestamp_ntz",
    "stallion_pedigree": "name string, sire string, dam string, sire_sire string, sire_dam string, dam_sire string, dam_dam string, nationality string",
    "rankings": "name string, vp_id string, eta int, somme_vinte bigint, prodotti int, media int, in_corsa int, media_in_corsa int, t_112 int, t_113 int, t_114 int, t_115 int, t_116 int, t_117 int, gt100k int, gt50k int, gt25k int, gt10k int",
}

KEYS = {"horses": ["name", "birth_year"], "races": ["horse_name", "race_date", "race_code"], "horse_ratings": ["name", "birth_year", "rating_mode"], "stallion_rating_stats": ["sire"], "stallions": ["name"], "stallion_pedigree": ["name"]}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def read_legacy(spark: SparkSession, url: str, name: str, driver: str, key: str | None = None, parts: int = 8, cuts: list[str] | None = None, table: str | None = None) -> DataFrame:
    """A table of a relational store by JDBC, conformed; the driver's jar must be on the class path.

    With a numeric ``key`` it is read in ``parts`` ranges of it at a time, whose bounds the store is asked for; with ``cuts``, rising values
    of a key of any kind, in the ranges between them. Null keys are read with the first range. Without a key one task reads all.
    """
    source, quoted_key = {"url": url, "dbtable": table or name, "driver": driver}, f'"{key}"'
    if key and cuts:
        quoted = ["'" + c.replace("'", "''") + "'" for c in cuts]
        tests = [f"{quoted_key} < {quoted[0]} OR {quoted_key} IS NULL", *(f"{quoted_key} >= {x} AND {quoted_key} < {y}" for x, y in zip(quoted, quoted[1:], strict=False)), f"{quoted_key} >= {quoted[-1]}"]
        return conform(spark.read.jdbc(url, source["dbtable"], predicates=tests, properties={"driver": driver}), name)
    if key:
        bounds = spark.read.format("jdbc").options(url=url, driver=driver, query=f"SELECT min({quoted_key}) AS low, max({quoted_key}) AS high FROM {source['dbtable']}").load().first()
        if bounds[0] is not None and bounds[0] < bounds[1]:
            source |= {"partitionColumn": key, "lowerBound": str(int(bounds[0])), "upperBound": str(int(bounds[1]) + 1), "numPartitions": str(parts)}
    return conform(spark.read.format("jdbc").options(**source).load(), name)


def write_legacy(df: DataFrame, url: str, table: str, driver: str, tasks: int = 8, batch: int = 10_000, types: str | None = None) -> None:
    """Rows into a relational store, by at most so many connections at a time; ``types`` names columns whose types it makes otherwise than Spark would."""
    named = {"createTableColumnTypes": types} if types else {}
    df.write.format("jdbc").options(url=url, dbtable=table, driver=driver, batchsize=str(batch), numPartitions=str(tasks), **named).mode("append").save()


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in order: missing ones null, loosely typed ones cast or null, others dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)))


def key_violations(df: DataFrame, name: str) -> DataFrame:
    """Keys that are not unique: what a unique index would refuse."""
    return df.groupBy(*KEYS[name]).count().filter("count > 1")


def inline_rankings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Ranking rows given in the program, with ``ord``, their place, and ``first_letter``."""
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*schema("rankings").fields, T.StructField("ord", T.LongType())]))
    return df.withColumn("first_letter", F.substring("name", 1, 1))


def seeded(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The existing rows, or the seed if there are none; which it is shows when the frame runs."""
    some = existing.limit(1).agg(F.count(F.lit(1)).alias("__n"))
    return existing.unionByName(seed.join(F.broadcast(some)).filter("__n = 0").drop("__n"), allowMissingColumns=True)
