"""Operator 13: compression of vectors to codes of codebook entries, in whole numbers, by Exponion search.

Vectors become whole numbers and are cut into parts; each part position has a codebook. In a round each part starts at the
entry it had before, at squared distance r from it. An entry nearer than that is, by the triangle inequality, at most twice as far from
the start as the part is, so at squared distance 4 r: the start's other entries, sorted by their distance from it, are
scanned up to that radius and no further. Distances are whole numbers, so the radius loses nothing, and equal distances go to the lower index.

Vectors lie packed in blocks of rows, which are written anew each round with the codes that the round found and the sums of
the parts of each entry. Only those sums are read back, added up by entry, and brought to the driver: they are as many numbers as the
codebooks have, whatever the number of vectors. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, staged, written
from .jaccard import _frequent, _looked_up

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 2048
#: Components are held at this, some 10^15 before they are scaled.
MOST = 1 << 62
BLOCK = "dim int, ids array<long>, labels array<string>, data binary, codes binary, errors binary, high binary, low binary, counts binary"
NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _usable(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """``id, label, vec`` of the rows whose vector is not null and has finite components only."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall(vec, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), vec.alias("vec")).filter(F.col("vec").isNotNull() & fine)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, held at ``MOST``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * float(scale)), -float(MOST), float(MOST)).astype(np.int64)


def _fits(numbers: np.ndarray, parts: int, wide: int) -> bool:
    """Whether 64 bits hold four times any squared distance of such numbers, and the sum over all parts."""
    most = int(max(abs(int(numbers.max())), abs(int(numbers.min())))) if numbers.size else 0
    return 4 * (2 * most) ** 2 * wide * parts < 1 << 62


def distances(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances: 64-bit, or Python's whole numbers where the arrays hold those."""
    apart = rows - entry
    return (apart * apart).sum(axis=1)


class Neighbours:
    """A codebook and, of each entry, the others by their squared distance from it, equal ones by index."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.order, self.apart = [], []
        for e, entry in enumerate(book):
            apart = distances(book, entry)
            others = sorted((i for i in range(len(book)) if i != e), key=lambda i: (apart[i], i))
            self.order.append(others)
            self.apart.append([apart[i] for i in others])

    def search(self, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance, from the entries ``start``."""
        best, nearest = start.astype(np.int64), np.zeros(len(rows), rows.dtype)
        for e in np.unique(start).tolist():
            at = np.flatnonzero(start == e)
            first = distances(rows[at], self.book[e])
            at, first = (x[np.argsort(-first, kind="stable")] for x in (at, first))  # the widest radius first: those still scanning are the leading ones
            reach = (4 * first)[::-1]
            here, part, entry = rows[at], first.copy(), np.full(len(at), e, np.int64)
            for other, apart in zip(self.order[e], self.apart[e], strict=True):
                n = len(at) - int(np.searchsorted(reach, apart))
                if not n:
                    break
                found = distances(here[:n], self.book[other])
                better = ((found < part[:n]) | ((found == part[:n]) & (other < entry[:n]))).astype(bool)
                part[:n] = np.where(better, found, part[:n])
                entry[:n] = np.where(better, other, entry[:n])
            best[at], nearest[at] = entry, part
        return best, nearest


def cut(vectors: np.ndarray, parts: int, wide: int) -> list[np.ndarray]:
    """Equal consecutive parts of ``wide`` components; vectors that are shorter count as zeros at their end."""
    filled = np.zeros((len(vectors), parts * wide), vectors.dtype)
    filled[:, : vectors.shape[1]] = vectors
    return [filled[:, p * wide : (p + 1) * wide] for p in range(parts)]


def _blocks(rows: DataFrame, scale: int) -> DataFrame:
    """Rows as matrices of whole numbers, one dimension each, in the order and the tasks they come in, with no codes yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                dims = some.column(2).value_lengths().to_numpy(zero_copy_only=False)
                flat = whole(some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
                starts = np.cumsum(dims) - dims
                of = [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]
                lists = [pa.array([some.column(i).take(pa.array(rows)).to_pylist() for _, rows in of], pa.list_(kind)) for i, kind in ((0, pa.int64()), (1, pa.string()))]
                data = [_narrow(flat[starts[rows][:, None] + np.arange(d)]).tobytes() for d, rows in of]
                none = pa.nulls(len(of), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in of], pa.int32()), *lists, pa.array(data, pa.binary()), *[none] * 5], NAMES)

    return rows.mapInArrow(run, BLOCK)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """In 32 bits, if these hold all."""
    small = numbers.astype(np.int32)
    return small if (small == numbers).all() else numbers


def _numbers(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64 if len(data) == 8 * rows * dim else np.int32).reshape(rows, dim).astype(np.int64)


def _assigned(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The blocks with the codes and errors that these codebooks give, and the sums and counts of each entry's parts."""
    parts, (entries, wide) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = _fits(np.concatenate(books), parts, wide)
        near: dict[type, list[Neighbours]] = {}
        for batch in batches:
            out: list[list[bytes]] = [[], [], [], [], []]
            sizes = batch.column(1).value_lengths().to_pylist()
            for n, dim, data, codes in zip(sizes, *(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                rows = _numbers(data, n, dim)
                kind = np.int64 if small and _fits(rows, parts, wide) else object
                if kind not in near:
                    near[kind] = [Neighbours(b.astype(kind)) for b in books]
                before = np.frombuffer(codes, np.uint8).reshape(n, parts) if codes else np.zeros((n, parts), np.uint8)
                found, errors = np.empty((n, parts), np.uint8), np.zeros(n, kind)
                high, low, counts = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
                for p, numbers in enumerate(cut(rows, parts, wide)):
                    found[:, p], nearest = near[kind][p].search(numbers.astype(kind), before[:, p])
                    errors += nearest
                    of = (found[:, p][None] == np.arange(entries)[:, None]).astype(np.float64)
                    high[p], low[p] = of @ (numbers >> 24), of @ (numbers & ((1 << 24) - 1))  # sums of so few rows are exact in doubles
                    counts[p] = of.sum(axis=1)
                held = errors if kind is np.int64 else np.array([min(int(e), (1 << 63) - 1) for e in errors], np.int64)
                for column, x in zip(out, (found, held, high, low, counts), strict=True):
                    column.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.binary()) for c in out)], NAMES)

    return blocks.mapInArrow(run, BLOCK)


def _moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry at the floor of the mean of its parts; entries without any stay."""
    parts, (entries, wide) = len(books), books[0].shape
    cells = parts * entries * wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(cells, object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                sums += (np.frombuffer(row["high"], np.int64).astype(object) << 24) + np.frombuffer(row["low"], np.int64)
                counts += np.frombuffer(row["counts"], np.int64)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), pa.array(np.repeat(counts, wide))], ["cell", "total", "n"])

    summed = blocks.select("high", "low", "counts").mapInArrow(run, "cell int, total decimal(38,0), n long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = np.concatenate([b.astype(object).ravel() for b in books])
    for cell, total, n in summed.collect():  # as many rows as the codebooks have numbers
        if n:
            out[cell] = int(total) // n
    return list(out.reshape(parts, entries, wide))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]] | None:
    """Blocks with their codes under the final codebooks, and these: one array (entry, component) a part. None without a vector."""
    usable = _usable(rows, id_col, vec_col, F.col(f"`{label_col}`").cast("string"))
    wide = -(-(usable.agg(F.max(F.size("vec"))).first()[0] or 0) // parts)
    first = usable.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    if not first:
        return None
    wide = max(1, wide)
    started = [cut(whole(np.array([r.vec], np.float64).reshape(1, -1), scale), parts, wide) for r in first]
    books = [np.concatenate([s[p] for s in started]).astype(object) for p in range(parts)]
    spark = rows.sparkSession
    blocks, path = written(_blocks(usable, scale), "paddock")
    for turn in range(rounds + 1):
        old, (blocks, path) = path, written(_assigned(blocks, books), "paddock")
        dropped(spark, old)
        if turn < rounds:
            books = _moved(blocks, books)
    return blocks, books


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``<id_col>, code, error, label_error, codebooks_sha256``: one row a vector.

    ``code`` has two hex digits a part; ``error`` is the squared distance from the entries, in scaled units; ``label_error`` sums the
    errors of all rows of the same label, those without one together.

    Rows whose vector is null or has null or non-finite components go. Rows that share an id, or have none, are vectors of
    their own; the first codebooks come from the smallest ids, null ones last, and of one id from the least vectors; with fewer
    vectors than entries there are fewer entries. Vectors shorter than the longest count as zeros at their end, as does the
    last part if the dimension can't be divided. Components beyond 2^62 once scaled are held there, and errors and their sums at 2^63 - 1. An empty table gives an empty
    result; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits")
    spark, kind = rows.sparkSession, rows.select(F.col(f"`{id_col}`")).schema.fields[0].dataType.simpleString()
    found = fit(rows, parts, entries, rounds, scale, id_col, vec_col, label_col)
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    blocks, books = found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [data[at : at + parts].hex() for data in batch.column(2).to_pylist() for at in range(0, len(data), parts)]
            errors = np.concatenate([np.frombuffer(e, np.int64) for e in batch.column(3).to_pylist()] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), batch.column(1).flatten(), pa.array(codes, pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    coded = blocks.select("ids", "labels", "codes", "errors").mapInArrow(run, "id long, label string, code string, error long")
    named = coded.select("id", "code", "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("-")).alias("label"))
    sums = named.groupBy(F.col("label").alias("at")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = _looked_up(named, "label", staged(_frequent(named, "label", named.count())), sums, "label_error")
    return out.select(F.col("id").cast(kind).alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
