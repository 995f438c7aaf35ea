"""Alignment against overlaps of byte ranges made token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from paddock.llm import alignment, queries

from ..compare import SF
from .test_operators import awkward, docs_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(parts):
    out, at = [], 0
    for ident, data in parts:
        out.append((ident, at, at + len(data)))
        at += len(data)
    return out


def by_hand(texts):
    """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each text."""
    left, right = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tokens, links, groups = [], [], []
    for text in texts:
        one = [(i, bytes(letters[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids] if text else []
        two = [(i, bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()) for i in right.encode(text)] if text else []
        whole = b" " + (text or "").encode()
        if b"".join(d for _, d in one) != whole or b"".join(d for _, d in two) != whole:
            one = two = []
        one, two = spans(one), spans(two)
        tokens.append((one, two))
        links.append([(x[0], y[0]) for x in one for y in two if max(x[1], y[1]) < min(x[2], y[2])])
        ends, start, cut = sorted({x[2] for x in one} & {y[2] for y in two}), 0, []
        for end in ends:
            cut.append("|".join(",".join(str(t[0]) for t in some if start < t[2] <= end) for some in (one, two)))
            start = end
        groups.append(cut)
    held = Counter(pair for some in links for pair in set(some))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for (one, two), some, cut in zip(tokens, links, groups, strict=True):
        best = sum(held[p] == most[p[0]] for p in some)
        yield len(one), len(two), len(cut), len(some), best, sum(held[p] for p in some), hashlib.sha256(";".join(cut).encode()).hexdigest() if cut else ""


ODD = [
    None, "", " ", "  two  spaces \n\n\ttab ", "<|endoftext|> and <s>x</s> <unk> <0x41>", "a▁b holds the mark for a space", "你好 \U0001f600\U0001f601 naïve İ Σé",
    "\x00\x01 controls \x1c", "1234567890 don't", "x" * 3000, "the same text", "the same text", "﻿mark", "\r\n\r\n", "é combining",
]


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(("chunk", "hot", "held"), [(1 << 23, 1000, 1 << 20), (300, 3, 50), (1, 1, 1)])
def test_against_byte_ranges(spark, monkeypatch, chunk, hot, held):
    """Whichever chunks the texts fall into, whichever A ids are split, and whenever sums are given out."""
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "HELD", held)
    rows = [(100 + i, t, "en", "a") for i, t in enumerate(ODD)] + [r for r in awkward() if len(r[1] or "") < 5000]
    docs = docs_of(spark, rows).withColumn("a", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    wanted = Counter((r[0], *w) for r, w in zip(rows, by_hand([r[1] for r in rows]), strict=True))
    assert rows_of(alignment.align(docs, A, B)) == wanted


def test_units_give_what_whole_texts_give():
    """On texts of all kinds of white space; and with hardly any unit kept."""
    left, right = alignment.side(A), alignment.side(B)
    assert left.cut and right.cut
    r = random.Random(2)
    alphabet = ["a", "the", "é", "你", "'s", "12", "▁", "!", "<s>", " ", " ", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u3000", "\u2028", "\x85"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(1, 40))) for _ in range(1500)] + [t for t in ODD if t]
    whole = alignment.whole_chunk(left, right, texts)
    known = alignment.Units(left, right)
    for _ in range(2):
        cut = alignment.cut_chunk(known, texts)
        assert cut[1] == whole[1] and (cut[0] == whole[0]).all() and cut[2].equals(whole[2])


def test_units_kept(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "KEPT_CHARS", 5)
    left, right = alignment.side(A), alignment.side(B)
    known = alignment.Units(left, right)
    for texts in (["one two three", "four longerthanfive"], ["two one six", "four"], ["longerthanfive"], ["x"]):
        cut, whole = alignment.cut_chunk(known, texts), alignment.whole_chunk(left, right, texts)
        assert cut[1] == whole[1] and (cut[0] == whole[0]).all() and cut[2].equals(whole[2])
        assert len(known.at) <= 3 and len(known.groups) == len(known.counts) == len(known.at) and known.counts[:, 3].sum() == len(known.link_a)


def test_side_a_in_every_part(spark, monkeypatch):
    """An A id that all documents have, split into many parts, keeps the counts of its pairs."""
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 1)
    monkeypatch.setattr(alignment, "HOT", 20)
    texts = [f"the {w}" for w in ("cat", "dog", "tree") for _ in range(40)] + ["thel"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows_of(alignment.align(docs, A, B)) == Counter((i, *w) for i, w in enumerate(by_hand(texts)))


def test_empty_table(spark):
    found = alignment.align(docs_of(spark, awkward()).limit(0), A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and found.count() == 0
    blank = alignment.align(docs_of(spark, [(1, None, None, None), (2, "", None, None)]), A, B)
    assert rows_of(blank) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_query_over_documents(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    short = [d for d in docs if len(d.text or "") < 3000]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_alignment(spark, SF).collect()}
    assert set(got) == {d.doc_id for d in docs}
    for d, w in zip(short, by_hand([d.text for d in short]), strict=True):
        assert got[d.doc_id][:4] + got[d.doc_id][6:] == w[:4] + w[6:]  # what one document alone decides
    assert all(g[3] == g[0] + g[1] - g[2] and g[4] <= g[3] <= g[5] for g in got.values())
