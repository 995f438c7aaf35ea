"""Landed pages as a data source of their own: ``spark.read.format("landed_pages")`` and ``df.write.format("landed_pages")``.

Whoever fetches pages lands them here, and everything after reads them from here. A folder (a day, a site) holds files in pairs:
an index, a JSON line a page with its address, how often it was asked for and where its markup lies, and the markup of
all its pages in one file. A page that could not be reached has a line without a place: its ``html`` is null, which is not an empty page.

Reading plans one partition for some index files of about ``partition_bytes`` together, whatever their folders, so a folder with a
third of all pages is read by many tasks. Filters on ``folder`` keep the files of other folders out of the plan.
Writing is committed as a whole: tasks write into a folder of the job, and files move into place when all have ended, so a
task that is lost or run twice leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

NAME = "landed_pages"
SCHEMA = "folder string, page_id long, url string, attempts int, html string"
_ARROW = pa.schema([("folder", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("attempts", pa.int32()), ("html", pa.string())])
#: Bytes of markup after which a writer begins new files and a reader gives out a batch; folders that a writer has open.
ROLL, BATCH, OPEN = 32 << 20, 8 << 20, 16
INDEX, MARKUP = ".index", ".pages"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Pairs of files: (folder, path without its ending)."""

    pairs: list[tuple[str, str]]


class _Reader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most = root, most
        self.folders: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, (EqualTo, In)) and test.attribute == ("folder",):
                wanted = set(test.value) if isinstance(test, In) else {test.value}
                self.folders = wanted if self.folders is None else self.folders & wanted
            else:
                yield test

    def partitions(self) -> list[Files]:
        store, root = _open(self.root)
        parts, size = [], 0
        tops = [root] if self.folders is None else [f"{root}/{f}" for f in sorted(self.folders)]
        for top in tops:
            for info in sorted(store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)), key=lambda i: i.path):
                if info.path.endswith(MARKUP) and "/_" not in info.path[len(root) :]:
                    if not parts or size + info.size > self.most:
                        parts.append(Files([]))
                        size = 0
                    path = info.path.removesuffix(MARKUP)
                    parts[-1].pairs.append((path[len(root) :].strip("/").rpartition("/")[0], path))
                    size += info.size + 1
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.root)
        for folder, path in partition.pairs:
            rows, size = [], 0
            with store.open_input_stream(path + MARKUP) as markup, store.open_input_stream(path + INDEX) as index:
                for line in index.read().decode().splitlines():
                    page = json.loads(line)
                    html = markup.read(page["bytes"]).decode() if page["bytes"] is not None else None
                    rows.append({"folder": folder, "page_id": page["page_id"], "url": page["url"], "attempts": page["attempts"], "html": html})
                    size += page["bytes"] or 0
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Paths without endings, below the job's folder."""

    paths: list[str]


class _Pair:
    """A pair of files being written."""

    def __init__(self, store: fs.FileSystem, path: str):
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.index: BinaryIO = store.open_output_stream(path + INDEX)
        self.markup: BinaryIO = store.open_output_stream(path + MARKUP)
        self.size = 0

    def put(self, page: dict) -> None:
        html = page["html"].encode() if page["html"] is not None else None
        known = {k: page[k] for k in ("page_id", "url", "attempts")} | {"bytes": None if html is None else len(html)}
        self.index.write(json.dumps(known).encode() + b"\n")
        self.markup.write(html or b"")
        self.size += len(html or b"")

    def close(self) -> None:
        self.index.close()
        self.markup.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.root)
        context, made = TaskContext.get(), []
        task = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        pairs: dict[str, _Pair] = {}
        for batch in batches:
            for page in batch.to_pylist():
                folder = page["folder"] or ""
                if folder not in pairs:
                    if len(pairs) >= OPEN:
                        pairs.pop(next(iter(pairs))).close()
                    made.append(f"{folder}/{task}-{len(made)}".lstrip("/"))
                    pairs[folder] = _Pair(store, f"{root}/{self.job}/{made[-1]}")
                pairs[folder].put(page)
                if pairs[folder].size > ROLL:
                    pairs.pop(folder).close()
        for pair in pairs.values():
            pair.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.root)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not info.path.endswith(self.job):
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for path in (p for m in messages if m for p in m.paths):
            store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
            for ending in (INDEX, MARKUP):  # the markup last: a pair without it isn't read
                store.move(f"{root}/{self.job}/{path}{ending}", f"{root}/{path}{ending}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.root)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class LandedPages(DataSource):
    """Options: ``path``, any store that Arrow's file systems reach, and ``partition_bytes`` (128 MB)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partition_bytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def land(pages: DataFrame, path: str, folder: Column, reached: Column | None = None, attempts: Column | None = None, mode: str = "append") -> None:
    """Lands pages (page_id, url, html) in the folder named; those not ``reached``, or without html, as pages that could not be fetched."""
    register(pages.sparkSession)
    html = F.col("html") if reached is None else F.when(reached, F.col("html"))
    tried = F.lit(1) if attempts is None else attempts
    rows = pages.select(folder.cast("string").alias("folder"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), tried.cast("int").alias("attempts"), html.cast("string").alias("html"))
    rows.write.format(NAME).mode(mode).option("path", path).save()


def landed(spark: SparkSession, path: str, partition_bytes: int = 128 << 20) -> DataFrame:
    """All landed pages, a row for each time a page was landed."""
    register(spark)
    return spark.read.format(NAME).option("path", path).option("partition_bytes", partition_bytes).load()


def latest(pages: DataFrame) -> DataFrame:
    """A row a page: its last reached state, else that it never was; ``attempts`` adds up."""
    place = F.struct(F.col("html").isNotNull(), F.col("folder"), F.col("html"))
    return pages.groupBy("page_id", "url").agg(F.sum("attempts").alias("attempts"), F.max_by("html", place).alias("html"))


def to_fetch_again(pages: DataFrame, most: int = 3) -> DataFrame:
    """``page_id, url, attempts`` of pages that were never reached and asked for fewer than ``most`` times."""
    return latest(pages).filter((F.col("attempts") < most) & F.col("html").isNull()).drop("html")


def found_on(pages: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """``<key>, reached, n``: how many rows of ``found`` each page gave, 0 for a page without any, null for one that was not reached."""
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    reached = F.col("html").isNotNull()
    return pages.join(counts, key, "left").select(key, reached.alias("reached"), F.when(reached, F.coalesce("__n", F.lit(0))).alias("n"))
