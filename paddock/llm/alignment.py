"""Operator 12: alignment of two tokenizers by a cogroup of postings.

Each task reads its texts once. A text's tokens under both tokenizers cover the same bytes; where both have an end, a group
ends, and each stretch between two neighbouring ends of either is one link: a pair of tokens that overlap. Where neither tokenizer
joins what stands before a blank to what follows, texts are cut there into units, and each distinct unit is aligned once. Of a chunk of
documents a task writes a row a document (counts and groups) and, for each id of side A, its postings: the ids of side B it
is linked with, in how many of the chunk's documents, and per document how often.

Postings are shuffled by their A id into sorted streams, which Spark spills. An A id's document counts, summed by chunk, come
first in its stream and are bounded by the vocabulary of side B; its postings follow and are read once, row by row, never
held: a link's count is looked up, compared with the id's maximum, and added to its document. An A id with more than a
thousandth of all postings is split by chunk into parts that each get the counts. Documents' contributions are added
up in the stream as far as they fit, packed by chunk, and added up by document where a chunk's meet.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import staged, tasks
from .tokens import _alphabet

#: Characters of text that a task aligns at a time (one text at least): so many units, or tokens of both sides, are held at once.
CHUNK_CHARS = 1 << 22
#: Units that a worker keeps aligned, and the characters of the longest one kept.
KEPT, KEPT_CHARS = 500_000, 64
#: So many units go to a library as one text.
JOINED = 256
#: A ids with over a thousandth of all postings are fewer than this, so a number for each can be sent to every task.
HOT = 1000
#: Contributions that a stream holds before it adds them up by document and, if that does not halve them, gives them out.
HELD = 1 << 20

DOC = "key long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "a int, bs array<int>, ns array<int>, first long, docs array<int>, times array<int>"


#: A unit: a blank and all up to the next blank that does not follow white space.
UNIT = re.compile(r" (?:[^ ]+|(?<=\s) )*")


class Side:
    """A tokenizer's ids of texts, the bytes of each id, and whether the ids of a text are those of its units."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes], cut: bool):
        self.encode, self.bytes, self.cut = encode, token_bytes, cut
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)


def _joins(tokens: list[str]) -> bool:
    """Whether a token goes on with a blank after something that is not white space."""
    return any(re.search(r"\S ", t) for t in tokens)


# The setting of tokenizers files whose pretokens hold white space at their start alone, or are white space.
PRETOKENS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def byte_level_side(path: str) -> Side:
    """A tokenizers file of the byte-level kind; its special strings are plain text, and each text gets a space in front."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _alphabet()
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    settings = json.loads(tokenizer.to_str())
    cut = settings["normalizer"] is None and settings["pre_tokenizer"] == PRETOKENS and not _joins([t.decode(errors="replace") for t in table])
    return Side(lambda texts: [e.ids for e in tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], table, cut)


def piece_side(path: str) -> Side:
    """A sentencepiece model that puts a space in front of each text itself; bytes of pieces as they stand for text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
    # merges keep to a unit if no piece goes beyond one, and the text reaches them unchanged
    same = all(model.normalize(x) == "▁" + x.replace(" ", "▁") for x in ("a", "  a  b\n c ", "\t a\u3000 b"))
    return Side(lambda texts: model.encode(texts, num_threads=1), table, same and not _joins(pieces))


_SIDES: dict[str, Side] = {}


def side(path: str) -> Side:
    """One of each file a worker process; the ending tells the kind."""
    if path not in _SIDES:
        _SIDES[path] = piece_side(path) if path.endswith(".model") else byte_level_side(path)
    return _SIDES[path]


_UNITS: dict[tuple[str, str], Units] = {}


def units(left: str, right: str) -> Units:
    if (left, right) not in _UNITS:
        _UNITS[left, right] = Units(side(left), side(right))
    return _UNITS[left, right]


def _flat_ids(s: Side, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of all texts, which stand with their blanks in front, and the bytes of each text; None if the tokens of a text do not spell it."""
    found = s.encode([t[1:] for t in texts])
    ids = np.concatenate([np.array(x, np.int64) for x in found]) if found else np.empty(0, np.int64)
    whole = "".join(texts).encode()
    if b"".join(map(s.bytes.__getitem__, ids.tolist())) != whole:
        return None
    sizes = np.array([len(t) for t in texts] if len(whole) == sum(map(len, texts)) else [len(t.encode()) for t in texts], np.int64)
    ends, upto = np.cumsum(s.lengths[ids]), np.cumsum([len(x) for x in found], dtype=np.int64)
    return (ids, sizes) if (ends[upto - 1] == np.cumsum(sizes)).all() else None


class Aligned:
    """The tokens of texts under both sides, from their ids, one text after the other, and the bytes of each text.

    ``a, b``: the ids; ``upto_a, upto_b, upto_groups, upto_links``: how many there are up to the end of each text;
    ``group_a, group_b``: the group of each token; ``link_a, link_b``: the tokens of each link. All numbers count from the start.
    """

    def __init__(self, left: Side, right: Side, a: np.ndarray, b: np.ndarray, sizes: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b, ends = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b]), np.cumsum(sizes)
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = both[1:] == both[:-1]
        common, every = both[1:][twice], both[np.append(~twice, True)] if len(both) else both
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.link_a, self.link_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
        self.upto_a, self.upto_b, self.upto_groups, self.upto_links = (np.searchsorted(x, ends, side="right") for x in (ends_a, ends_b, common, every))

    @classmethod
    def of(cls, left: Side, right: Side, texts: list[str]) -> Aligned:
        """Of texts with their blanks in front; those that either side does not spell have no tokens."""
        found = [_flat_ids(s, texts) for s in (left, right)]
        sizes = None
        if None in found:  # one by one, to find which
            kept = [[_flat_ids(s, [t]) for s in (left, right)] for t in texts]
            none = (np.empty(0, np.int64), np.zeros(1, np.int64))
            kept = [[none, none] if None in two else two for two in kept]
            found = [tuple(np.concatenate(x) for x in zip(*(two[i] for two in kept), strict=True)) for i in (0, 1)]
        (a, sizes), (b, _) = found
        return cls(left, right, a, b, sizes)

    @classmethod
    def of_units(cls, left: Side, right: Side, units: list[str]) -> Aligned:
        """Of units, which go to the libraries many at a time: their tokens are told apart at the units' ends."""
        joined, found = ["".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)], []
        if not any(u[-1].isspace() for u in units):  # else a unit would not end where the next begins
            found = [_flat_ids(s, joined) for s in (left, right)]
        if not found or None in found:
            return cls.of(left, right, units)
        sizes = np.array([len(u.encode()) for u in units], np.int64)
        return cls(left, right, found[0][0], found[1][0], sizes)

    def counts(self) -> np.ndarray:
        """Of each text: tokens of A, of B, groups, links."""
        return np.stack([np.diff(upto, prepend=0) for upto in (self.upto_a, self.upto_b, self.upto_groups, self.upto_links)], axis=1)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n_a, n_b = len(self.a), len(self.b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.group_a, self.group_b))
        upto_a, upto_b = np.searchsorted(self.group_a, np.arange(len(last_a) and self.group_a[-1] + 1), side="right"), np.searchsorted(self.group_b, np.arange(len(last_b) and self.group_b[-1] + 1))
        order = np.empty(n_a + n_b, np.int64)  # 4 id + 2 for side B + 1 at a group's end
        if n_a:
            order[np.arange(n_a) + upto_b[self.group_a]] = 4 * self.a + last_a
            order[np.arange(n_b) + upto_a[self.group_b]] = 4 * self.b + 2 + last_b
        ends = (",", "|", ",", ";")
        distinct, at = np.unique(order, return_inverse=True)
        words = [f"{x >> 2}{ends[x & 3]}" for x in distinct.tolist()]
        parts, out, start = list(map(words.__getitem__, at.tolist())), [], 0
        for stop in (self.upto_a + self.upto_b).tolist():
            out.append("".join(parts[start:stop])[:-1])
            start = stop
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The two ids of each link."""
        return self.a[self.link_a], self.b[self.link_b]


class Units:
    """Alignments of distinct units, of which those of ``KEPT`` are kept: counts and groups of each, and the links of all, one unit's after the other."""

    def __init__(self, left: Side, right: Side):
        self.sides, self.at, self.groups = (left, right), {}, []
        self.counts = np.zeros((0, 4), np.int64)
        self.link_a, self.link_b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, units: list[str]) -> None:
        plain = [u for u in units if not ("▁" in u or u[-1].isspace())]
        for some, of in ((plain, Aligned.of_units), (list(set(units).difference(plain)), Aligned.of)):
            if some:
                found = of(*self.sides, some)
                self.at.update(zip(some, range(len(self.groups), len(self.groups) + len(some)), strict=True))
                self.groups += found.groups()
                self.counts = np.concatenate([self.counts, found.counts()])
                self.link_a, self.link_b = (np.concatenate(x) for x in zip((self.link_a, self.link_b), found.links(), strict=True))

    def shrink(self) -> None:
        """Forgets units that are too long to meet again, and the last ones beyond ``KEPT``."""
        if len(self.groups) > KEPT or any(len(u) > KEPT_CHARS for u in list(self.at)[self.short :]):
            stay = [u for u in self.at if len(u) <= KEPT_CHARS][:KEPT]
            old = np.array([self.at[u] for u in stay], np.int64)
            rows = spread(self.starts()[old], self.counts[old, 3])
            self.at, self.groups = {u: i for i, u in enumerate(stay)}, [self.groups[i] for i in old.tolist()]
            self.counts, self.link_a, self.link_b = self.counts[old], self.link_a[rows], self.link_b[rows]
        self.short = len(self.at)

    short = 0

    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts[:, 3]) - self.counts[:, 3]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each run, one run after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def cut_units(text: str) -> list[str]:
    units = UNIT.findall(f" {text}")
    if units[-1] == " ":  # a blank that ends a text belongs to what it follows
        units[-2:] = ["".join(units[-2:])]
    return units


Chunk = tuple[np.ndarray, list[str], pa.RecordBatch | None]


def whole_chunk(left: Side, right: Side, texts: list[str]) -> Chunk:
    """Counts of each text (tokens of either side, groups, links), their groups, and the postings; by whole texts."""
    full = [i for i, t in enumerate(texts) if t]
    x = Aligned.of(left, right, [f" {texts[i]}" for i in full])
    counts, groups = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    counts[full] = x.counts()
    for i, g in zip(full, x.groups(), strict=True):
        groups[i] = g
    docs = np.array(full, np.int64)[np.searchsorted(x.upto_links, np.arange(len(x.link_a)), side="right")]
    return counts, groups, postings(*x.links(), docs, np.ones(len(docs), np.int64), len(texts))


def cut_chunk(known: Units, texts: list[str]) -> Chunk:
    """The same, by units."""
    split = [cut_units(t) if t else [] for t in texts]
    fresh = list(set().union(*split).difference(known.at))
    if fresh:
        known.add(fresh)
    sizes = np.array([len(units) for units in split], np.int64)
    at = np.fromiter((i for units in split for i in map(known.at.__getitem__, units)), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(texts)), sizes)
    bad = np.unique(of[known.counts[at, 0] == 0])  # a unit that its tokens do not spell leaves its text without tokens
    fine = ~np.isin(of, bad)
    at, of = at[fine], of[fine]
    sizes[bad] = 0
    counts = np.stack([np.bincount(of, known.counts[at, i], len(texts)).astype(np.int64) for i in range(4)], axis=1) if len(texts) else np.zeros((0, 4), np.int64)
    parts, groups, start = list(map(known.groups.__getitem__, at.tolist())), [], 0
    for n in sizes.tolist():
        groups.append(";".join(parts[start : start + n]))
        start += n
    found, often = np.unique(of * len(known.groups) + at, return_counts=True)
    docs, units = found // len(known.groups), found % len(known.groups)
    n = known.counts[units, 3]
    rows = spread(known.starts()[units], n)
    out = counts, groups, postings(known.link_a[rows], known.link_b[rows], np.repeat(docs, n), np.repeat(often, n), len(texts))
    known.shrink()
    return out


def postings(a: np.ndarray, b: np.ndarray, docs: np.ndarray, times: np.ndarray, n: int) -> pa.RecordBatch | None:
    """A row for each A id with a link: ``a, bs, ns, docs, times``; the documents of each of ``bs`` stand one after the other.
    The links given are so many times in that one of the ``n`` documents."""
    if not len(a):
        return None
    wide = int(b.max()) + 1
    links = (a * wide + b) * n + docs
    order = np.argsort(links, kind="stable")
    links = links[order]
    firsts = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
    found, times = links[firsts], np.add.reduceat(times[order], firsts)
    pairs, starts = np.unique(found // n, return_index=True)
    counts = np.diff(np.append(starts, len(found)))
    a, first = np.unique(pairs // wide, return_index=True)
    of_b = pa.array(np.append(first, len(pairs)).astype(np.int32))
    of_doc = pa.array(np.append(starts[first], len(found)).astype(np.int32))
    ints = lambda x: pa.array(x.astype(np.int32))
    lists = [pa.ListArray.from_arrays(o, ints(x)) for o, x in ((of_b, pairs % wide), (of_b, counts), (of_doc, found % n), (of_doc, times))]
    return pa.RecordBatch.from_arrays([ints(a), *lists], ["a", "bs", "ns", "docs", "times"])


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _written(docs: DataFrame, left: str, right: str, id_col: str, text_col: str) -> DataFrame:
    """A row a document (``DOC``) and a row for each (chunk, A id) (``POSTING``): of either kind the other's columns are null."""
    schema = pa.schema([*((n, {"long": pa.int64(), "string": pa.string()}[k]) for n, k in (c.split() for c in DOC.split(", "))), ("a", pa.int32()), ("bs", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32())), ("first", pa.int64()), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, key = (side(left), side(right)), TaskContext.get().partitionId() << 40
        for whole in batches:
            ids, texts = whole.column(0), [t or "" for t in whole.column(1).to_pylist()]
            for start, stop in _chunks(texts, CHUNK_CHARS):
                some = texts[start:stop]
                counts, groups, found = cut_chunk(units(left, right), some) if all(s.cut for s in sides) else whole_chunk(*sides, some)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = {"key": pa.array(np.arange(key, key + stop - start)), "id": ids.slice(start, stop - start), "groups_sha256": pa.array(digests, pa.string())}
                columns |= {n: pa.array(np.ascontiguousarray(counts[:, i])) for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(stop - start, f.type)) for f in schema], schema=schema)
                if found is not None:
                    columns = dict(zip(found.schema.names, found.columns, strict=True)) | {"first": pa.array(np.full(found.num_rows, key))}
                    yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(found.num_rows, f.type)) for f in schema], schema=schema)
                key += stop - start

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{DOC}, {POSTING}")


def _flat(column: pa.Array, start: int, stop: int) -> np.ndarray:
    return column.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)


ADDED = "first long, docs array<int>, best array<long>, sums array<long>"


class Contributions:
    """Sums by document of what a stream's postings add. They go out a row a chunk: ``first``, the key of the chunk's first document, and of
    each of its documents that got any the place in the chunk and the sums."""

    def __init__(self):
        self.parts, self.n, self.firsts = [], 0, np.empty(0, np.int64)

    def add(self, firsts: np.ndarray, keys: np.ndarray, best: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.firsts = np.union1d(self.firsts, firsts)
        self.parts.append((keys, best, total))
        self.n += len(keys)
        if self.n > HELD:
            self.summed()
            if self.n > HELD // 2:
                yield from self.out()

    def summed(self) -> None:
        if self.parts:
            keys, best, total = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.parts, self.n = [(keys[starts], np.add.reduceat(best[order], starts), np.add.reduceat(total[order], starts))], len(starts)

    def out(self) -> Iterator[pa.RecordBatch]:
        self.summed()
        for keys, best, total in self.parts:
            chunk = np.searchsorted(self.firsts, keys, side="right") - 1
            starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            first, of = self.firsts[chunk[starts]], pa.array(np.append(starts, len(keys)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(of, pa.array(x)) for x in ((keys - self.firsts[chunk]).astype(np.int32), best, total)]
            yield pa.RecordBatch.from_arrays([pa.array(first), *lists], ["first", "docs", "best", "sums"])
        self.parts, self.n, self.firsts = [], 0, np.empty(0, np.int64)


def _by_document(rows: pa.Table) -> pa.Table:
    """What one chunk's documents got in all streams, no more than its postings: ``key, n_best, count_sum``."""
    first = rows.column("first")[0].as_py()
    docs, best, total = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("docs", "best", "sums"))
    sums = [np.zeros(int(docs.max()) + 1, np.int64) for _ in range(2)]
    for out, x in zip(sums, (best, total), strict=True):
        np.add.at(out, docs, x)
    some = np.flatnonzero(sums[1])
    return pa.table({"key": first + some, "n_best": sums[0][some], "count_sum": sums[1][some]})


def _contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by ``a, part, kind``: of each A id first the counts of its pairs (kind 0), then its postings."""
    sums, counts, most, now = Contributions(), np.zeros(1 << 10, np.int64), 0, None
    touched: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, part, kind, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        bs, ns, docs, times = (batch.column(i) for i in range(4, 8))
        edges = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
        for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            b, n = _flat(bs, start, stop), _flat(ns, start, stop).astype(np.int64)
            if now != (a[start], part[start]):
                now = (a[start], part[start])
                for cells in touched:
                    counts[cells] = 0
                touched, most = [], 0
            if kind[start] == 0:
                if b.max() >= len(counts):
                    counts = np.concatenate([counts, np.zeros(int(b.max()) + 1, np.int64)])
                np.add.at(counts, b, n)
                touched.append(b)
                most = max(most, int(counts[b].max()))
            else:
                rows = docs.slice(start, stop - start).value_lengths().to_numpy(zero_copy_only=False)
                keys = np.repeat(first[start:stop], rows) + _flat(docs, start, stop)
                m = _flat(times, start, stop).astype(np.int64)
                count = np.repeat(counts[b], n)
                yield from sums.add(first[start:stop], keys, np.where(count == most, m, 0), m * count)
    yield from sums.out()


def align(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``left`` and ``right`` are tokenizer files (.json of the byte-level kind, .model of sentencepiece). ``n_best`` counts the links whose
    pair's number of documents is the highest of their A id, ties included; ``count_sum`` adds the numbers up over the links.

    Null and empty texts, and texts whose tokens of either side do not spell a space and the text, have no tokens: zeros and ''. Rows that
    share an id, and repeated rows, are documents of their own; very long texts are aligned whole; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = staged(_written(docs, left, right, id_col, text_col))
    postings = rows.filter("a is not null").select(*(c.split()[0] for c in POSTING.split(", ")))
    sized = postings.groupBy("a").agg(F.sum(F.size("docs")).alias("rows"))
    total = rows.filter("a is not null").agg(F.sum(F.size("docs"))).first()[0] or 0
    hot = F.broadcast(staged(sized.filter(F.col("rows") * HOT > total).select(F.col("a").alias("at"), F.ceil(F.col("rows") * HOT / F.lit(max(1, total))).cast("int").alias("parts"))))
    parted = postings.join(hot, F.col("a") == F.col("at"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    nothing = F.lit(None)
    counted = parted.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("first"), "bs", "ns", nothing.cast("array<int>").alias("docs"), nothing.cast("array<int>").alias("times"))
    posted = parted.select("a", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "first", "bs", "ns", "docs", "times")
    streams = counted.unionByName(posted).repartition(tasks(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "kind")
    added = streams.mapInArrow(_contributed, ADDED).groupBy("first").applyInArrow(_by_document, "key long, n_best long, count_sum long")
    found = rows.filter("key is not null").select("key", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(added, "key", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


