"""Derived tables: careers, ratings and sire statistics are computed once, stored as Parquet and read by every question.

The nightly job derives them and the answers read them, so a question filters a stored table instead of rating everybody
again. They are derived anew when the files of the base tables have changed, or after ``refresh``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import dropped, shared_path

_STORED: dict[tuple[str, str, str], tuple[str, str, object]] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the base tables' files."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files, found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def stored_folder(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> tuple[str, object]:
    """A folder that ``build`` fills, and what it returns: built by the first who asks in this application, and anew when the base tables' files have changed."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if key not in _STORED or _STORED[key][0] != state:
        if key in _STORED:
            dropped(spark, _STORED[key][1])
        path = shared_path(spark, f"tables-{name}")
        _STORED[key] = (state, path, build(path))
    return _STORED[key][1:]


def stored(spark: SparkSession, sf_dir: str, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from the base tables in ``sf_dir``."""

    def build(path: str):
        df = derive()
        df.write.parquet(path)
        return df.schema

    path, schema = stored_folder(spark, sf_dir, name, build)
    return spark.read.schema(schema).parquet(path)


def refresh(spark: SparkSession, sf_dir: str) -> None:
    """Forgets what was derived from ``sf_dir``: the next question derives it again."""
    for key in [k for k in _STORED if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
        dropped(spark, _STORED.pop(key)[1])
