"""Careers in parts, and a relational store read in ranges."""

import datetime
import os
from pathlib import Path

from pyspark.sql import functions as F

from paddock.operators.career import careers
from paddock.plans import parts
from paddock.sources import schemas

RACES = "horse_name string, race_date date, placement int, time_km string, prize_net double, race_code string, id long"
DAY = datetime.date(2024, 1, 1)


def test_parts_are_recomputed(spark, tmp_path):
    """Only files of parts whose horses got races change, and the outcome is that of computing everything."""
    root = f"{tmp_path}/careers"
    horses = spark.createDataFrame([(f"H{i}", None, 2000) for i in range(200)] + [(None, None, 1)], "name string, sire string, birth_year int")
    race = lambda i, d, n: (f"h{i} ", DAY + datetime.timedelta(days=d), i % 4 + 1, "1.14.6", float(i), f"r{n}", n)
    old = [race(i, d, 10 * i + d) for i in range(0, 200, 2) for d in range(3)]
    new = [race(i, 3, 9000 + i) for i in (1, 4, 5)] + [race(4, 0, 1), race(4, 3, 9999), race(777, 1, 5)]
    parts.start(horses, spark.createDataFrame(old, RACES), root, 16)
    state = lambda: {str(p.relative_to(root)): (p.stat().st_mtime_ns, os.path.getsize(p)) for p in Path(root).rglob("*.parquet")}
    before = state()
    touched = parts.merge_races(spark, root, spark.createDataFrame(new, RACES), [F.col("id")], 16)
    after, wanted = state(), {p for p in touched}
    names = spark.createDataFrame([("H1",), ("H4",), ("H5",), ("H777",)], "n string").select(parts.part_of(F.col("n"), 16).alias("p"))
    assert wanted == {r.p for r in names.collect()} and len(touched) < 16
    changed = {k.split("part=")[1].split("/")[0] for k in before if k.startswith("careers/") and after.get(k) != before[k]}
    assert {int(p) for p in changed} <= wanted
    assert all(after[k] == v for k, v in before.items() if not k.startswith("careers/"))
    full = careers(horses.filter("name is not null"), parts.stored_races(spark, root))
    assert parts.stored_careers(spark, root).select(full.columns).exceptAll(full).count() == 0 and full.count() == 200
    assert parts.merge_races(spark, root, spark.createDataFrame(new, RACES), [F.col("id")], 16) == []
    assert state() == after and parts.merge_races(spark, root, spark.createDataFrame([], RACES), [F.col("id")], 16) == []


def test_legacy_store(spark, tmp_path):
    """A table goes into a relational store and comes back over four partitions, by a number or by names, nulls too."""
    url, driver = f"jdbc:derby:{tmp_path}/store;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(i if i % 50 else None, f"HORSE {i % 7}", DAY, "RM", i % 9, "1.14.6", 1600, "d", i / 2, i / 2, f"o'{i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, horse_name string, race_date date, track string, placement int, time_km string, distance int, driver string, prize_net double, prize_gross double, race_code string")
    schemas.write_legacy(frame.repartition(3), url, "races", driver, 2, types="horse_name varchar(40)")
    by_number = schemas.read_legacy(spark, url, "races", driver, key="id", parts=4)
    by_name = schemas.read_legacy(spark, url, "races", driver, key="horse_name", cuts=["HORSE 2", "HORSE 4", "HORSE 6"])
    alone = schemas.read_legacy(spark, url, "races", driver)
    wanted = schemas.conform(frame, "races")
    for got, n in ((by_number, 4), (by_name, 4), (alone, 1)):
        assert got.rdd.getNumPartitions() == n and got.schema == schemas.schema("races")
        assert got.exceptAll(wanted).count() == 0 and got.count() == 1000
    sizes = [r["count"] for r in by_number.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 300
    schemas.write_legacy(frame.limit(0), url, "nothing", driver)
    assert schemas.read_legacy(spark, url, "races", driver, key="id", table="nothing").count() == 0
