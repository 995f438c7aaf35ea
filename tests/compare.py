"""Rows of a query against rows of its DuckDB oracle."""

import decimal
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dict):
        return tuple(sorted(value.items()))
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


def spark_rows(frame):
    columns = sorted(frame.columns)
    return columns, ordered(tuple(plain(r[c]) for c in columns) for r in frame.collect())


def oracle_rows(sql, sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def same(spark, queries, oracles, name):
    columns, rows = spark_rows(queries[name](spark, SF))
    wanted_columns, wanted = oracle_rows(oracles[name])
    assert columns == wanted_columns
    assert rows == wanted
