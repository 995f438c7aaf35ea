"""Operator 8: token counts by prefix dynamic programming.

For byte-level BPE the encoding of a prefix is the encoding of a shorter prefix plus one last token, and a sequence of
tokens is the encoding of its bytes exactly when each adjacent pair is. So ``count[i] = count[i - len(t)] + 1`` for the
one token ``t`` that ends at byte ``i`` and agrees with the last token before it. The counts of all prefixes of a text
are kept as one signed byte a byte of text (the differences), and any question about lengths, truncation or budgets is
a sum over them: the text is never encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: The split pattern of this family of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+(?![^WS])|[WS]+"
#: White space as Unicode's White_Space has it, so without the separators U+001C to U+001F.
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Bytes of most tokens: an order of trial, no limit.
USUAL = 6


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for every prefix of a text, from a tokenizers file of the byte-level kind."""

    def __init__(self, path: str, cached: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _alphabet()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT.replace("WS", WS))
        self.units = regex.compile(f"[{WS}]*[^{WS}]+|[{WS}]+$")
        self.runs = regex.compile(f"[{WS}][{WS}]+[^{WS}]")
        self.space = regex.compile(f"[{WS}]*")
        self.cached, self.known, self.agree, self.whole = cached, {}, {}, {}

    def encode(self, piece: bytes) -> list[int]:
        """The merges of one pretoken, lowest rank first."""
        out = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(out) > 1:
            best = min((self.merges.get(p, (1 << 30, 0)) + (i,) for i, p in enumerate(zip(out, out[1:], strict=False))))
            if best[0] == 1 << 30:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out

    def _agrees(self, a: int, b: int) -> bool:
        key = (a << 20) | b
        if (known := self.agree.get(key)) is None:
            known = self.agree[key] = self.encode(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _reached(self, t: int) -> bool:
        if (known := self.whole.get(t)) is None:
            known = self.whole[t] = self.encode(self.bytes[t]) == [t]
        return known

    def piece(self, word: bytes) -> list[int]:
        """Token counts of word[:1], word[:2], ... taken as one pretoken."""
        ids, agree, longest = self.ids.get, self.agree.get, self.longest
        last, count = [0], [0]
        for end in range(1, len(word) + 1):
            # one token fits, whatever the order of trial: the usual lengths come first
            for start in range(end) if end <= USUAL else chain(range(end - USUAL, end), range(end - USUAL - 1, max(-1, end - longest - 1), -1)):
                token = ids(word[start:end])
                if token is None:
                    continue
                if start:
                    fits = agree((last[start] << 20) | token)
                    if fits is None:
                        fits = self._agrees(last[start], token)
                else:
                    fits = self._reached(token)
                if fits:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return count[1:]

    def part(self, text: str) -> bytes:
        """Differences of the counts over one pretoken; a contraction's own prefixes split otherwise than it does."""
        if text[0] == "'" and len(text) > 1 and text[1].isalpha():
            counts = [sum(self.piece(p.encode())[-1] for p in self.split.findall(text[:k])) for k in range(1, len(text) + 1)]
        else:
            counts = self.piece(text.encode())
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts, strict=False)])

    def unit(self, text: str) -> bytes:
        """Differences over one run of white space and the characters after it: a prefix that ends within the run
        counts the run as one pretoken, though the whole text gives the run's last space to the next word."""
        lead = self.space.match(text).group()
        run = self.part(lead) if lead else b""
        parts = b"".join(map(self.part, self.split.findall(text)))
        if len(lead) < 2 or len(lead) == len(text):
            return parts
        upto, size = len(lead[:-1].encode()), len(run)
        gap = sum(_signed(parts[: upto + len(lead[-1].encode())])) - sum(_signed(run))
        return run + bytes([(parts[size] + gap) & 255]) + parts[size + 1 :]

    def deltas(self, text: str) -> bytes:
        """One signed byte a byte of UTF-8: how the count changes when the prefix grows by that byte."""
        out, at = [], 0
        for found in self.special_split.finditer(text) if self.special_split is not None else ():
            token = found.group().encode()
            upto = self.deltas_plain(text[at : found.end()])
            before = self.deltas_plain(text[at : found.start()])
            seen = np.frombuffer(upto, np.int8)[: len(before) + len(token) - 1].astype(np.int64)
            close = int(np.frombuffer(before, np.int8).sum(dtype=np.int64)) + 1 - int(seen.sum())
            out.append(upto[: len(seen)] + np.int8(close).tobytes())
            at = found.end()
        return b"".join([*out, self.deltas_plain(text[at:])])

    def deltas_plain(self, text: str) -> bytes:
        known, out = self.known, []
        units, make = (self.units.findall(text), self.unit) if self.runs.search(text) else (self.split.findall(text), self.part)
        for u in units:
            d = known.get(u)  # a unit that is one pretoken has the same differences either way
            if d is None:
                d = make(u)
                if len(known) < self.cached and len(u) < 64:
                    known[u] = d
            out.append(d)
        return b"".join(out)


def _signed(deltas: bytes) -> list[int]:
    return [d - 256 if d > 127 else d for d in deltas]


def count_at(deltas: bytes, n_bytes: int | None = None) -> int:
    """Tokens of the prefix of that many bytes (all, if None)."""
    return int(np.frombuffer(deltas, np.int8)[:n_bytes].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int, text: str | None = None) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens; with the ``text``, of those that end with a whole character."""
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    fits = counts <= budget
    if text is not None and len(text) < len(counts):
        fits[:-1] &= np.frombuffer(text.encode(), np.uint8)[1:] & 0xC0 != 0x80
    fits = np.flatnonzero(fits)
    return int(fits[-1]) + 1 if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker process: its cache outlives the task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, cut_bytes, prefix_deltas`` for every row of ``docs``.

    ``prefix_deltas`` holds the count of every prefix (see ``count_at``, ``longest_within``); ``cut_bytes`` is the longest
    prefix, in bytes, of whole characters and at most ``limit`` tokens. No shuffle: each task streams its own rows.

    Null and empty texts count 0 bytes and 0 tokens with empty deltas; repeated rows and ids give a row each; very long
    texts are counted whole; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = [c.deltas(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(d) for d in out], pa.int64()),
                    pa.array([count_at(d) for d in out], pa.int64()),
                    pa.array([longest_within(d, limit, t) for d, t in zip(out, texts, strict=True)], pa.int64()),
                    pa.array(out, pa.binary()),
                ],
                ["id", "n_bytes", "n_tokens", "cut_bytes", "prefix_deltas"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, cut_bytes long, prefix_deltas binary")
    return counted.withColumnRenamed("id", id_col)
