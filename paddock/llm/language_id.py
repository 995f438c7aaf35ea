"""Operator 1: language identification by Bayesian evidence fusion.

For each row and language the log posterior adds up
  - the text: a naive Bayes model over hashed character trigrams, tempered because trigrams overlap;
  - the declared markup language and the address suffix: how often each comes with a language, from grouped aggregation of
    the text posteriors over all rows;
  - the prior of the row's host: shrunk towards its site, then all rows, each from grouped sums of the posteriors.
Sums leave the row's own posterior out. Evidence that a row lacks says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

BUCKET_BITS = 16
#: Distinct labelled texts of each language that the text model is fitted on, about and at most: a bounded sample.
SAMPLE_TEXTS = 5_000


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of the lower-cased letters, runs of anything else as one blank."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (raw >= 0xAA) | ((raw >= 97) & (raw <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if len(chars) < 3 or not letter.any():
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = (chars[:-2] * np.uint32(0x9E3779B1)) ^ (chars[1:-1] * np.uint32(0x85EBCA6B)) ^ (chars[2:] * np.uint32(0xC2B2AE35))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """Log probability of each bucket in each language; ``languages`` in code-point order."""

    def __init__(self, languages: list[str], logs: np.ndarray, temper: float):
        self.languages, self.logs, self.temper = languages, logs, temper

    def evidence(self, text: str | None) -> tuple[list[float], int]:
        """Tempered log likelihoods, the largest 0, and the number of trigrams."""
        at = trigrams(text or "")
        if not len(at):
            return [0.0] * len(self.languages), 0
        if len(at) > self.logs.shape[0]:
            sums = np.bincount(at, minlength=self.logs.shape[0]) @ self.logs
        else:
            sums = self.logs[at].sum(0, dtype=np.float64)
        sums = (sums - sums.max()) * self.temper
        return sums.tolist(), len(at)


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``text, lang``: of each language about ``sample_texts`` distinct texts, all if it has fewer, each once.

    Texts are drawn by a 64-bit hash against a share of the language's own number of distinct texts, which is estimated
    within a few percent; so a rare language keeps its texts, and however often a text occurs it counts as one.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null and lang <> ''")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # a row a language: staged, so that Spark sees how small it is and leaves the texts where they lie
    share = staged(rows.groupBy("lang").agg((F.lit(float(sample_texts)) / F.approx_count_distinct("hash", 0.02)).alias("share")))
    drawn = rows.join(share, "lang").filter((F.col("hash") / F.lit(2.0**64) + 0.5) < F.col("share"))
    return drawn.dropDuplicates(["lang", "hash"]).select("text", "lang")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, temper: float = 0.25) -> TextModel:
    """Trigram counts by language over the ``sample`` of labelled texts, add-half smoothed. Rows without a text or a label don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
                at = trigrams(text)
                np.add.at(sums[lang], at, 1)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], ["lang", "bucket", "n"])

    # at most 2^BUCKET_BITS rows a language, whatever the corpus
    counts = sample(labelled, text_col, lang_col, sample_texts).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(counts["lang"].unique().tolist())
    table = np.full((1 << BUCKET_BITS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        mine = counts[counts["lang"] == lang]
        table[mine["bucket"].to_numpy(), k] += mine["n"].to_numpy()
    return TextModel(languages, np.log(table / table.sum(0)), temper)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(rows: DataFrame, key: str, languages: int) -> DataFrame:
    """Posterior mass by key and language, as an array; the key's nulls are a key of their own."""
    return rows.groupBy(key).agg(F.array(*(F.sum(F.col("__p")[k]) for k in range(languages))).alias(f"{key}_mass"))


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def identify(rows: DataFrame, model: TextModel, host_col: str | None = None, markup_col: str | None = None, suffix_col: str | None = None, site_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", strength: float = 20.0, least: float = 0.35) -> DataFrame:
    """One row a row of ``rows``: ``<id_col>, language, probability, text_language, trigrams, accepted``.

    ``host_col`` and the wider ``site_col`` group rows for the prior; ``markup_col`` and ``suffix_col`` are evidence.
    Columns not given are taken as null. ``strength`` is how many rows a wider group's view weighs. A row is accepted when
    it has letters and its best language a probability of at least ``least``.

    Group sums are partially aggregated, so a host with a third of all rows is a row a task in the shuffle; their tables
    are joined back by broadcast only while small. Null and empty texts have no trigrams: the other evidence decides,
    and they are not accepted; a null or empty host, site, suffix or markup says nothing; repeated rows count each and
    stay; texts are taken whole; of languages that tie the first in code-point order is told; an empty table gives an empty result; other columns are ignored.
    """
    k = len(model.languages)
    spark = rows.sparkSession
    if not k:
        raise ValueError("the text model knows no language")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([e for e, _ in out], pa.list_(pa.float64())), pa.array([n for _, n in out], pa.int64())], ["__id", "__host", "__site", "__suffix", "__markup", "__text", "trigrams"])

    given = [(F.col(c) if c else F.lit(None)).cast("string").alias(n) for c, n in ((host_col, "__host"), (site_col, "__site"), (suffix_col, "__suffix"), (markup_col, "__markup"))]
    kind = rows.schema[id_col].dataType.simpleString()
    told = rows.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"), *(F.coalesce(g, F.lit("")).alias(n) for g, n in zip(given, ("__host", "__site", "__suffix", "__markup"), strict=True)))
    told = told.mapInArrow(run, f"__id {kind}, __host string, __site string, __suffix string, __markup string, __text array<double>, trigrams long")
    seen = staged(told.withColumn("__p", F.when(F.col("trigrams") > 0, _softmax(F.col("__text"))).otherwise(F.array_repeat(F.lit(0.0), k))))

    total = seen.agg(F.array(*(F.coalesce(F.sum(F.col("__p")[i]), F.lit(0.0)) for i in range(k))).alias("__all_mass"))
    joined = seen.join(F.broadcast(total))  # one row
    for key in ("__suffix", "__site", "__host", "__markup"):
        joined = joined.join(staged(_sums(seen, key, k)), key)
    mean = F.transform(_less(F.col("__all_mass"), F.col("__p")), lambda x: x + 1.0)
    mass = F.aggregate(mean, F.lit(0.0), lambda a, x: a + x)
    prior = F.transform(mean, lambda x: x / mass)

    def narrowed(wide: Column, key: str) -> Column:
        own = _less(F.col(f"{key}_mass"), F.col("__p"))
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, wide, lambda x, y: (x + strength * y) / (n + strength))

    # the prior, narrowed from all rows to the site and the host where there are any
    wide = prior
    for key in ("__site", "__host"):
        joined = joined.withColumn(f"{key}_prior", F.when(F.col(key) != "", narrowed(wide, key)).otherwise(wide))
        wide = F.col(f"{key}_prior")

    # P(value | language) over the value's share among all rows of the language: no evidence where the value is missing
    def lift(key: str) -> Column:
        own, everything = _less(F.col(f"{key}_mass"), F.col("__p")), _less(F.col("__all_mass"), F.col("__p"))
        logs = F.zip_with(own, everything, lambda x, y: F.log((x + 0.5) / (y + 1.0)))
        return F.when(F.col(key) != "", logs).otherwise(F.array_repeat(F.lit(0.0), k))

    logs = F.transform(wide, lambda x: F.log(x))
    for more in (F.col("__text"), lift("__markup"), lift("__suffix")):
        logs = F.zip_with(logs, more, lambda x, y: x + y)
    joined = joined.withColumn("__post", _softmax(logs))
    names = F.array(*map(F.lit, model.languages))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return joined.select(
        F.col("__id").alias(id_col),
        best(F.col("__post")).alias("language"),
        F.array_max("__post").alias("probability"),
        F.when(F.col("trigrams") > 0, best(F.col("__text"))).alias("text_language"),
        "trigrams",
        ((F.col("trigrams") > 0) & (F.array_max("__post") >= least)).alias("accepted"),
    )


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, text, host, site, suffix, markup`` of web pages: the text without scripts, styles, comments and tags, the
    host's parts and the language that the markup declares (its first subtag). What is never closed ends with the page, as it does
    in a browser; so each pattern goes over a page once, whatever it holds."""
    html = F.col(html_col)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " "), r"(?s)<[^>]*(?:>|\z)|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return pages.select(
        id_col,
        bare.alias("text"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        F.lower(F.regexp_extract(html, r"(?is)<html[^<>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)).alias("markup"),
    )
