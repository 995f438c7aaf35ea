"""Operator 9: language-model scoring with an Elias-Fano n-gram trie.

Words are 64-bit hashes. The model is a trigram model whose counts back off by adding: with P0(w) = (c(w) + 1) / (n + V + 1),
which knows the count of every word and has one unknown,

    P(w|uv) = (c(uvw) + k (c(vw) + m P0(w))) / (c(uv) + k (c(v) + m)),

which sums to one. Numerator and denominator need not be known in one place: the counts of the first belong to w, those
of the second to v. As in other n-gram tries, n-grams are kept with their last word first. The trie is cut into shards by
that word; a shard holds monotone sequences in Elias-Fano form (words, running sums of their counts, pointers to their
contexts, contexts relative to their word, pointers to theirs, and contexts relative to those) and quantised logs: of the
numerator for each trigram, of both for each bigram. All events of a word go to its shard once, as packed blocks: there its
trie is built from the training events and queried, packed as it is, for all of them, and only sums a document come back.
Words so frequent that they would weigh on a shard are cut by context too, and the number of shards grows with the corpus. So
no task holds the model, and the trie grows with the corpus.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged, tasks
from .jaccard import Words, mixed

#: Tokens of a chunk, the unit that is sorted at once in a task, and training tokens of a shard at most, about.
CHUNK, SHARD = 800_000, 1_000_000
#: Levels of the quantised logs; they lie evenly between the least and the largest of a shard.
LEVELS = 1 << 8
#: Bits of a context's hash that are kept within its word, and within its word and context.
BITS, FAR_BITS = 40, 32
BEGIN, END = (np.uint64(mixed(np.array([x], np.uint64))[0]) for x in (0x5EED, 0xE4D))
_WORDS = Words()


#: Ones in a byte, and the place of the r-th one from its highest bit.
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_NTH = np.array([[*(i for i in range(8) if b >> (7 - i) & 1), *[0] * 8][:8] for b in range(256)], np.uint8)


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bits packed, high bits in unary, with the number of ones before every 64 bits.

    ``levels`` are views, of a mapped file as well; they are searched as they are, never unpacked.
    """

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.before = n, low_bits, lows, highs, before
        self.zeros = 64 * np.arange(len(before)) - before

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = int(values[-1]).bit_length() if n else 0
        low_bits = min(57, max(0, width - max(1, n).bit_length()))
        shifts = np.arange(low_bits - 1, -1, -1).astype(np.uint64)
        step = 1 << 14  # rows of bits at a time: a multiple of 8, so that parts end on whole bytes
        parts = [np.packbits(((values[i : i + step, None] >> shifts) & np.uint64(1)).astype(np.uint8), axis=None) for i in range(0, n, step)] if low_bits else []
        lows = np.concatenate([*parts, np.zeros(8, np.uint8)])
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(high[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        bits[high] = 1
        highs = np.packbits(bits)
        ones = _ONES[highs].reshape(-1, 8).sum(1, dtype=np.int64)
        return EliasFano(n, low_bits, lows, highs, np.cumsum(ones) - ones)

    def _select(self, r: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the r-th one or zero: by the 64 bits that hold it, then its byte, then within the byte."""
        upto = self.before if ones else self.zeros
        block = np.searchsorted(upto, r, "right") - 1
        left, at = r - upto[block], block * 8
        byte, some = np.zeros(len(r), np.uint8), np.zeros(len(r), np.int64)
        open_ = np.ones(len(r), bool)
        for k in range(8):
            now = self.highs[at + k]
            now = now if ones else ~now
            n = _ONES[now]
            here = open_ & (left < n)
            byte[here], some[here] = now[here], k
            open_ &= ~here
            left = left - np.where(open_, n, 0)
        return 64 * block + 8 * some + _NTH[byte, np.minimum(left, 7)]

    def at(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        out = (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)
        return out | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(i.shape, np.uint64)
        first = i * self.low_bits
        at, word = first >> 3, np.zeros(i.shape, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | self.lows[at + k]
        return (word << (first & 7).astype(np.uint64)) >> np.uint64(64 - self.low_bits)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the first index whose value is not smaller: the range of its high part lies between two zeros, and is halved by low parts."""
        x = np.asarray(x, np.uint64)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        zeros = 64 * len(self.before) - self.n

        def first(h: np.ndarray) -> np.ndarray:
            """Values whose high part is below h."""
            out = np.where(h > 0, self.n, 0)
            some = np.flatnonzero((h > 0) & (h <= zeros))
            out[some] = np.minimum(self._select(h[some] - 1, False) - (h[some] - 1), self.n)
            return out

        lo, hi = first(high), first(high + 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each x, or -1."""
        if not self.n:
            return np.full(len(x), -1)
        at = np.minimum(self.successor(x), self.n - 1)
        return np.where(self.at(at) == x, at, -1)

    def dump(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.lows), len(self.highs)], np.int64).tobytes() + self.lows.tobytes() + self.highs.tobytes() + self.before.tobytes()

    @staticmethod
    def view(buffer, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = np.frombuffer(buffer, np.int64, 4, at).tolist()
        at += 32
        before = np.frombuffer(np.frombuffer(buffer, np.uint8, b, at + a + b).tobytes(), np.int64)  # aligned; as long as the high bits
        return EliasFano(n, low_bits, np.frombuffer(buffer, np.uint8, a, at), np.frombuffer(buffer, np.uint8, b, at + a), before), at + a + 2 * b


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


class Codes:
    """Logs at evenly spaced levels, a byte each."""

    def __init__(self, least: float, step: float, codes: np.ndarray):
        self.least, self.step, self.codes = least, step, codes

    @staticmethod
    def dump(logs: np.ndarray) -> bytes:
        least = float(logs.min()) if len(logs) else 0.0
        step = (float(logs.max()) - least) / (LEVELS - 1) if len(logs) else 0.0
        codes = np.rint((logs - least) / step).astype(np.uint8) if step else np.zeros(len(logs), np.uint8)
        return np.array([least, step]).tobytes() + codes.tobytes()

    @staticmethod
    def view(buffer, n: int, at: int) -> tuple[Codes, int]:
        least, step = np.frombuffer(buffer, np.float64, 2, at).tolist()
        return Codes(least, step, np.frombuffer(buffer, np.uint8, n, at + 16)), at + 16 + n

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[i]


class Trie:
    """A shard's levels. Words with running sums of their counts; pairs by word with the logs of both their parts; triples by pair."""

    def __init__(self, buffer):
        at, seqs = 0, []
        for _ in range(6):
            seq, at = EliasFano.view(buffer, at)
            seqs.append(seq)
        self.words, self.sums, self.pointers, self.pairs, self.far_pointers, self.triples = seqs
        self.over2, at = Codes.view(buffer, self.pairs.n, at)
        self.under2, at = Codes.view(buffer, self.pairs.n, at)
        self.over3, at = Codes.view(buffer, self.triples.n, at)

    @staticmethod
    def build(w: np.ndarray, v: np.ndarray, u: np.ndarray, c: np.ndarray, base: Base, prior: float, back: float) -> bytes:
        """From training counts of (kept) triples, which may repeat."""
        order = np.lexsort((u, v, w))
        w, v, u, c = w[order], v[order], u[order], c[order]
        first = _starts(w, v, u)
        w, v, u, c3 = w[first], v[first], u[first], _summed(c, first)
        pair = _starts(w, v)
        c2, pair_of = _summed(c3, pair), np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(w))))
        pw, pv = w[pair], v[pair]
        word = _starts(pw)
        c1, word_of = _summed(c2, word), np.repeat(np.arange(len(word)), np.diff(np.append(word, len(pw))))
        often = base.often_at(pw[word])
        all1 = np.where(often >= 0, base.often_n[often], c1)[word_of]  # a frequent word has more in other shards
        over2 = c2 + prior * base.p0(all1)
        seqs = (pw[word], np.cumsum(c1), word, (word_of.astype(np.uint64) << np.uint64(BITS)) | pv, pair, (pair_of.astype(np.uint64) << np.uint64(FAR_BITS)) | u)
        logs = (np.log10(over2), np.log10(c2 + back * (all1 + prior)), np.log10(c3 + back * over2[pair_of]))
        return b"".join([*(EliasFano.build(s).dump() for s in seqs), *map(Codes.dump, logs)])

    @staticmethod
    def mapped(blob: bytes) -> Trie:
        """The levels in an anonymous memory map: pages, not Python objects."""
        area = mmap.mmap(-1, max(1, len(blob)))
        area.write(blob)
        return Trie(area)

    def counts(self, word: np.ndarray) -> np.ndarray:
        """Exact counts of words by index (0 for -1), as differences of the running sums."""
        out, some = np.zeros(len(word), np.int64), np.flatnonzero(word >= 0)
        at = word[some]
        upto = self.sums.at(at).astype(np.int64)
        lower = np.zeros(len(at), np.int64)
        later = np.flatnonzero(at > 0)
        lower[later] = self.sums.at(at[later] - 1).astype(np.int64)
        out[some] = upto - lower
        return out

    @staticmethod
    def under(level: EliasFano, parent: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
        """Index of each context within its parent by a search relative to it, or -1; a parent of -1 has none."""
        out, some = np.full(len(parent), -1), np.flatnonzero(parent >= 0)
        out[some] = level.find((parent[some].astype(np.uint64) << np.uint64(bits)) | context[some])
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bool], list[np.ndarray]]]:
    """Ids, held-out marks and word hashes, training documents first, of about CHUNK tokens at a time."""
    ids, held, words, n = [], [], [], 0
    for batch in batches:
        for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(i), held.append(h), words.append(_WORDS.hashes(t or ""))
            n += len(words[-1]) + 1
            if n >= CHUNK:
                yield _training_first(ids, held, words)
                ids, held, words, n = [], [], [], 0
    if ids:
        yield _training_first(ids, held, words)


def _training_first(ids, held, words):
    order = np.argsort(held, kind="stable")
    return [ids[i] for i in order], [held[i] for i in order], [words[i] for i in order]


def _word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over training documents, the end of a text included; summed in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words in _chunks(batches):
            found, n = np.unique(np.concatenate([*words, np.full(len(ids), END)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counted = rows.filter("not held").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return staged(counted)


class Base:
    """The totals of the corpus and the counts of its most frequent words: bounded by the number of shards."""

    def __init__(self, counts: DataFrame, least: int, per_shard: int):
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.n, self.v = int(total[0]), int(total[1])
        self.z, self.shards = float(self.n + self.v + 1), max(least, -(-self.n // per_shard))
        end = int(END.view(np.int64))
        # words above a quarter of a shard's mean are cut by context: there are fewer than four a shard
        often = counts.filter((F.col("n") > max(1.0, self.n / self.shards / 4)) | (F.col("word") == end)).toArrow()
        words, n = often.column("word").to_numpy().view(np.uint64), often.column("n").to_numpy()
        if END not in words:
            words, n = np.append(words, END), np.append(n, 0)
        order = np.argsort(words)
        self.often, self.often_n = words[order], n[order]
        self.docs = int(self.often_n[self.often == END][0])

    def p0(self, counts: np.ndarray) -> np.ndarray:
        """P0 of words of these counts."""
        return (counts + 1) / self.z

    def often_at(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.often, words), len(self.often) - 1)
        return np.where(self.often[at] == words, at, -1)


def _shard_of(w: np.ndarray, v: np.ndarray, base: Base) -> np.ndarray:
    key = np.where(base.often_at(w) >= 0, mixed(w * np.uint64(31) + v), w)
    return ((mixed(key) >> np.uint64(32)) * np.uint64(base.shards) >> np.uint64(32)).astype(np.int32)


def _slim(values: np.ndarray) -> bytes:
    """Small numbers in as few bytes each as the largest needs, which the first byte tells."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


BLOCK = "shard int, chunk long, train int, ids binary, held binary, sizes binary, ws binary, wn binary, vs binary, vh binary, vn binary, us binary, un binary, ds binary"


def _blocks(rows: DataFrame, sent) -> DataFrame:
    """A row a (chunk, shard): its distinct triples by last word and context, and the documents of each event; the chunk's
    list of documents goes with one of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), sent.value
        for number, (ids, held, words) in enumerate(_chunks(batches)):
            sizes = np.array([len(w) + 1 for w in words])
            w = np.concatenate([np.append(x, END) for x in words])
            v = np.concatenate([np.append(BEGIN, x) for x in words])
            u = np.roll(v, 1)
            u[np.cumsum(sizes) - sizes] = BEGIN
            d = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            v, u = v & np.uint64((1 << BITS) - 1), (u & np.uint64((1 << FAR_BITS) - 1)).astype(np.uint32)
            shard = _shard_of(w, v, base)
            order = np.lexsort((u, v, w, shard))
            shard, w, v, u, d = shard[order], w[order], v[order], u[order], d[order]
            triple = _starts(shard, w, v, u)
            un = np.diff(np.append(triple, len(w)))
            shard, w, v, u = shard[triple], w[triple], v[triple], u[triple]
            pair = _starts(shard, w, v)
            vn = np.diff(np.append(pair, len(w)))
            ps, pw, pv = shard[pair], w[pair], v[pair]
            word = _starts(ps, pw)
            wn = np.diff(np.append(word, len(pw)))
            at = np.unique(ps)
            t0, t1 = np.searchsorted(shard, at), np.searchsorted(shard, at, "right")
            p0, p1 = np.searchsorted(ps, at), np.searchsorted(ps, at, "right")
            w0, w1 = np.searchsorted(ps[word], at), np.searchsorted(ps[word], at, "right")
            starts = np.append(triple, len(d))
            chunk = (part << 24) | number
            for i, s in enumerate(at.tolist()):
                listed = i == number % len(at)
                yield pa.RecordBatch.from_pylist([{
                    "shard": s, "chunk": chunk, "train": len(held) - sum(held),
                    "ids": pa.array(ids, pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() if listed else None,
                    "held": np.array(held, np.uint8).tobytes() if listed else None, "sizes": sizes.astype(np.int64).tobytes() if listed else None,
                    "ws": pw[word[w0[i] : w1[i]]].tobytes(), "wn": _slim(wn[w0[i] : w1[i]]),
                    "vs": pv[p0[i] : p1[i]].astype(np.uint32).tobytes(), "vh": (pv[p0[i] : p1[i]] >> np.uint64(32)).astype(np.uint8).tobytes(), "vn": _slim(vn[p0[i] : p1[i]]),
                    "us": u[t0[i] : t1[i]].tobytes(), "un": _slim(un[t0[i] : t1[i]]), "ds": _slim(d[starts[t0[i]] : starts[t1[i]]]),
                }], schema=_BLOCK_SCHEMA)

    return rows.mapInArrow(run, BLOCK)


_BLOCK_SCHEMA = pa.schema([pa.field(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split(" ") for x in BLOCK.split(", "))])


class _Block:
    """A block's words, pairs and triples, and which of them each belongs to."""

    def __init__(self, b: dict):
        self.w = np.frombuffer(b["ws"], np.uint64)
        self.v = np.frombuffer(b["vs"], np.uint32).astype(np.uint64) | (np.frombuffer(b["vh"], np.uint8).astype(np.uint64) << np.uint64(32))
        self.u = np.frombuffer(b["us"], np.uint32).astype(np.uint64)
        self.docs = _wide(b["ds"])
        self.word_of = np.repeat(np.arange(len(self.w)), _wide(b["wn"]))
        self.pair_of = np.repeat(np.arange(len(self.v)), _wide(b["vn"]))
        self.triple_of = np.repeat(np.arange(len(self.u)), _wide(b["un"]))

    def trained(self, train: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The triples of training documents, which come first, with their counts."""
        c = np.bincount(self.triple_of[self.docs < train], minlength=len(self.u))
        some = np.flatnonzero(c)
        pair = self.pair_of[some]
        return self.w[self.word_of[pair]], self.v[pair], self.u[some], c[some]


def _views(table: pa.Table) -> list[dict]:
    """The rows of a table whose binary values are views, not copies."""
    out = []
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            values = ((n, batch.column(k)[i]) for k, n in enumerate(batch.schema.names))
            out.append({n: memoryview(x.as_buffer()) if x.is_valid and pa.types.is_binary(x.type) else x.as_py() for n, x in values})
    return out


def _score_shard(table: pa.Table, base: Base, prior: float, back: float) -> list[dict]:
    """Builds the shard's trie from its training events and sums up what it says of all events, a document at a time."""
    rows = _views(table)
    trained = [_Block(b).trained(b["train"]) for b in rows]
    trie = Trie.mapped(Trie.build(*(np.concatenate(x) for x in zip(*trained, strict=True)), base, prior, back))
    del trained
    out = []
    for row in rows:
        b = _Block(row)
        word = trie.words.find(b.w)
        often = base.often_at(b.w)
        known = np.where(often >= 0, base.often_n[often], trie.counts(word))
        base_log, low = np.log10(base.p0(known)), prior * base.p0(known)
        pair = Trie.under(trie.pairs, word[b.word_of], b.v, BITS)
        seen = pair >= 0
        over2 = np.where(seen, trie.over2.at(np.maximum(pair, 0)) if trie.pairs.n else 0.0, np.log10(low)[b.word_of])
        under = np.where(seen, trie.under2.at(np.maximum(pair, 0)) if trie.pairs.n else 0.0, np.log10(back * (known + prior))[b.word_of])
        under = np.where((b.w != END)[b.word_of], under, 0.0)  # each word but the end is a context once
        triple = Trie.under(trie.triples, pair[b.pair_of], b.u, FAR_BITS)
        over3 = np.where(triple >= 0, trie.over3.at(np.maximum(triple, 0)) if trie.triples.n else 0.0, np.log10(back) + over2[b.pair_of])
        event_word = b.word_of[b.pair_of][b.triple_of]
        there, at = np.unique(b.docs, return_inverse=True)
        out.append({
            "chunk": row["chunk"], **{n: None if row[n] is None else bytes(row[n]) for n in ("ids", "held", "sizes")}, "docs": _slim(there),
            "base": np.bincount(at, base_log[event_word]).tobytes(), "score": np.bincount(at, (over3 - under[b.pair_of])[b.triple_of]).astype(np.float32).tobytes(),
            "known": _slim(np.bincount(at, (known > 0)[event_word]).astype(np.int64)),
        })
    return out


SUMS = "chunk long, ids binary, held binary, sizes binary, docs binary, base binary, score binary, known binary"
_SUMS_SCHEMA = pa.schema([pa.field(n, pa.int64() if k == "long" else pa.binary()) for n, k in (x.split(" ") for x in SUMS.split(", "))])


def score(docs: DataFrame, held_out, prior: float = 300.0, back: float = 0.01, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD) -> DataFrame:
    """One row a document: ``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` makes a condition of the id column (null counts as false); all other documents are learned from, all are
    scored. ``n_tokens`` counts the words and one end; ``base_score`` is the add-one unigram score, exact; ``score`` is the
    model's log10 probability with the quantisation of the trie. ``prior`` and ``back`` are the m and k of the model.
    There are as many shards as shuffle partitions, and more so that none has over about ``shard_tokens`` training tokens.
    Null and empty texts are their end alone; repeated rows count each; very long texts are taken whole; a null id stays
    null; without training documents every token is unknown; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    base = Base(_word_counts(rows), tasks(spark), shard_tokens)
    sent = spark.sparkContext.broadcast(base)

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_score_shard(table, sent.value, prior, back), schema=_SUMS_SCHEMA)

    def told(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        listed = next(p for p in parts if p["ids"] is not None)
        ids, held, sizes = (np.frombuffer(listed[k], t) for k, t in (("ids", np.int64), ("held", np.uint8), ("sizes", np.int64)))
        sums = {k: np.zeros(len(ids)) for k in ("base", "score", "known")}
        for p in parts:
            at = _wide(p["docs"])
            for k, s in sums.items():
                s[at] += _wide(p[k]) if k == "known" else np.frombuffer(p[k], np.float64 if k == "base" else np.float32)
        b = sent.value
        begin = np.log10(b.docs + back * (b.docs + prior))  # the one context that no word ends
        null = ids == -(2**63)
        return pa.table({
            "id": pa.array(ids, pa.int64(), mask=null), "held_out": pa.array(held.astype(bool)), "n_tokens": sizes,
            "n_known": sums["known"].astype(np.int64), "train_tokens": np.full(len(ids), b.n), "base_score": sums["base"], "score": sums["score"] - begin,
        })

    sums = _blocks(rows, sent).groupBy("shard").applyInArrow(one, SUMS)
    out = sums.groupBy("chunk").applyInArrow(told, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
