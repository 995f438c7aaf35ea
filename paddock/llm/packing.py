"""Operator 3: best-fit packing in bulk-synchronous rounds.

Pieces are range-sorted by length: every piece has a length and a rank within it, found with prefix sums over Spark.
Gaps are kept the same way, as runs of consecutive sequences with equal room. One round takes all pieces of one length,
longest first; a successor sweep over the gaps gives them the smallest gap that holds them, conflicts are resolved by
rank (the r-th piece takes the r-th place), the gaps shrink, and the next round begins. As lengths are whole numbers up
to the capacity, both sides of a round are runs, never rows: the sweep's state is bounded by the capacity whatever the
corpus holds, and the placements it makes are joined back to the pieces by (length, rank). The outcome is that of
best-fit decreasing over all pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import prefix_sums, staged, tasks

CAPACITY = 4096


#: A letter of the Latin blocks, then a comma or full stop, then a blank: two pretokens, so a blank between changes no id.
MARK = re.compile("([,.])(?<=[a-z\u00df-\u00f6\u00f8-\u00ff][,.])(?=[ \n])")
#: A chunk of such letters alone is one pretoken.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: So many of these go to the library as one text.
JOINED = 256

# The settings of tokenizers files whose texts may be cut as ``WordIds`` does.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def may_be_cut(settings: dict) -> bool:
    """Whether a tokenizers file lowers case, drops white space, splits letters from marks, neither adds nor cuts ids, and has control strings that all begin as ``encode`` expects."""
    return (
        (settings["normalizer"] or {}).get("normalizers") == NORMALIZERS
        and (settings["pre_tokenizer"] or {}).get("pretokenizers") == [SPLIT, BYTES]
        and not any(settings[part] for part in ("truncation", "padding", "post_processor"))
        and all(a["content"].startswith("<|") for a in settings["added_tokens"])
    )


class WordIds:
    """Ids of texts by a tokenizers file that lowers case, drops white space and never joins letters to marks, with the
    ids of frequent chunks kept. Texts are lowered first (unless they hold the one letter whose lower case depends on its place, or what may be a
    control string) and cut
    at U+0020, at U+000A and before single marks; anything else, other white space included, is left to the library.
    New chunks of letters alone go to it joined by blanks, and its ids are told apart at those that end a word.
    Whether the file is of this kind is looked up in its settings; whole texts go to the library if it is not."""

    def __init__(self, path: str, cached: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.cached = Tokenizer.from_file(path), {"": b""}, cached
        self.cut = may_be_cut(json.loads(self.tokenizer.to_str()))
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """The chunks with their ids."""
        words = list(filter(LETTERS.fullmatch, chunks))
        single = list(set(chunks).difference(words))
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups]), strict=True):
            data, upto = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(upto) == len(group):
                yield from zip(group, (data[a:b] for a, b in zip([0, *upto], upto, strict=False)), strict=True)
            else:  # a file without word ends
                single += group
        yield from zip(single, (ids.tobytes() for ids in self._library(single)), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cut:
            return [ids.tobytes() for ids in self._library(texts)]
        lowered = (t if "\u03a3" in t or "<|" in t else t.lower() for t in texts)
        split = [MARK.sub(r" \1", t).replace("\n", " ").split(" ") for t in lowered]
        known = self.known
        fresh = list(set().union(*split).difference(known))
        room = self.cached - len(known)
        known.update(self._new(fresh))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for i, chunk in enumerate(fresh):
            if i >= room or len(chunk) >= 64:
                del known[chunk]
        return out


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text's ids with ``end_id`` after them, cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # so many texts at a time are held as words
                batch = whole.slice(at, 512)
                out: list[list[int | None]] = [[], [], [], [], []]
                for doc, data in zip(batch.column(0).to_pylist(), ids.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    data += end
                    for k, start in enumerate(range(0, len(data) // 4, capacity)):
                        part = data[4 * start : 4 * (start + capacity)]
                        for column, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds over runs: placements ``(length, first rank, pieces, pieces a sequence, first sequence, first offset)``.

    ``counts`` has at most ``capacity`` lengths. A run of gaps is split at most once a round, so there are fewer than
    two runs a round.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, how many)
    rooms: list[int] = []
    placed, fresh = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                rooms.insert(bisect_left(rooms, room), room)
                gaps[room] = []
            gaps[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)  # the successor: the smallest gap that holds it
            if at < len(rooms):
                room = rooms[at]
                first, n = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                room, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = room // length
            full, some = min(n, left // each), 0
            if full < n and left - full * each:
                some = left - full * each
            took = full * each + some
            placed.append((length, rank, took, each, first, capacity - room))
            put(room - each * length, first, full)
            if some:
                put(room - some * length, first + full, 1)
            put(room, first + full + bool(some), n - full - bool(some))
            left, rank = left - took, rank + took
    return placed


def best_fit(lengths: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length of 1 to ``capacity``; sequences have no gaps before their end.

    ``lengths`` should be cheap to read twice (see ``common.staged``). Rows of one length, a third of all or more, are
    ranked in cells, never in one task. An empty table gives an empty result; equal rows are told apart by nothing but
    their place; a length that is null or out of range is an error.
    """
    spark = lengths.sparkSession
    cells = 4 * tasks(spark)
    named = lengths.withColumn("__cell", F.pmod(F.xxhash64(*lengths.columns), F.lit(cells)).cast("int")).withColumn("__one", F.lit(1).cast("long"))
    named = named.withColumn("__length", F.when(F.col(length_col).between(1, capacity), F.col(length_col).cast("int")).otherwise(F.raise_error(F.lit("a piece's length is out of range")).cast("int")))
    counts = {r[0]: r[1] for r in named.groupBy("__length").agg(F.sum("__one")).collect()}  # at most ``capacity`` rows
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "__length" else T.LongType()) for n in ("__length", "__from", "__n", "__each", "__first", "__offset0")])
    plan = spark.createDataFrame(sweeps(counts, capacity), schema)  # bounded by the capacity, so it can be sent to every task
    ranked = prefix_sums(named, ["__length"], "__cell", [F.xxhash64(*lengths.columns)], "__one", "__rank")
    ranked = ranked.withColumnRenamed("__length", "__l")
    on = (F.col("__l") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n"))
    at = F.col("__rank") - F.col("__from")
    return ranked.join(F.broadcast(plan), on).select(
        *lengths.columns,
        (F.col("__first") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset0") + (at % F.col("__each")) * F.col("__l")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole texts into sequences of at most ``capacity`` ids; only texts longer than that are cut.

    One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is its end
    id alone; repeated rows are packed as often as they occur; very long texts make many pieces; an empty table gives
    an empty result; other columns are ignored.
    """
    return best_fit(staged(pieces(docs, tokenizer, capacity, 1, id_col, text_col)), capacity)
