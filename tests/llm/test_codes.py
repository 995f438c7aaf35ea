"""Codes against plain rounds of whole-number assignments, row by row."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import codes


def by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows ``(id, vector, label)``: ``id, code, error, label_error, codebooks_sha256`` of those that take part."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**50 else int(math.copysign(codes.MOST, x)) for x in v], lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    wide = max(1, -(-max(len(v) for _, v, *_ in kept) // parts))
    cut = lambda v: [(v + [0] * (parts * wide))[p * wide : (p + 1) * wide] for p in range(parts)]
    pieces = [cut(v) for _, v, *_ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][3]))[:entries]
    books = [[pieces[k][p] for k in first] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(x[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in pieces]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x[p] for x, f in zip(pieces, found, strict=True) if f[p][1] == e]
                    if mine:
                        books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [min(sum(d for d, _ in f), 2**63 - 1) for f in found]
    by_label = Counter()
    for (_, _, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    return Counter((i, "".join(f"{e:02x}" for _, e in f), err, min(by_label[lab], 2**63 - 1), digest) for (i, _, lab, _), f, err in zip(kept, found, errors, strict=True))


def frame(spark, rows):
    """With columns that have the names used inside."""
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, id int, code string, error int")


def vectors(n, dim, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, spread) for _ in range(dim)] for _ in range(9)]
    return [(i, [x + r.gauss(0, 0.1) for x in r.choice(centres)], r.choice([None, 1, 1, 2])) for i in r.sample(range(10 * n), n)]


def got(spark, rows, **more):
    return Counter(tuple(r) for r in codes.encode(frame(spark, rows).repartition(3), **more).collect())


def test_against_plain_rounds(spark):
    odd = [(1, None, 1), (2, [1.0, None] * 8, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, None), (5, [0.0] * 16, None)]
    rows = vectors(300, 16, 1) + odd + [(7, [0.25] * 16, 3)] * 60 + [(None, [0.5] * 16, 4)]
    assert got(spark, rows) == by_hand(rows)


def test_ties_and_few_vectors(spark, monkeypatch):
    """Small whole numbers, so that distances tie and entries coincide; fewer vectors than entries; blocks of few rows."""
    monkeypatch.setattr(codes, "BLOCK_ROWS", 7)
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(8)], i % 3) for i in range(200)]
    assert got(spark, rows, scale=1) == by_hand(rows, scale=1)
    for n in (1, 2, 5):
        assert got(spark, rows[:n]) == by_hand(rows[:n])


def test_dimensions(spark):
    """Not to be divided, and mixed: zeros fill the ends."""
    for rows in (vectors(60, 13, 2), vectors(40, 16, 3) + [(10_000 + i, v, lab) for i, v, lab in vectors(30, 5, 4)] + [(99_999, [], 1)]):
        assert got(spark, rows, rounds=2) == by_hand(rows, rounds=2)


def test_large_components(spark):
    """Beyond what 64-bit distances hold."""
    rows = [(i, [x * 1e6 for x in v], lab) for i, v, lab in vectors(50, 8, 6)] + [(9000, [1e300] * 8, 5), (9001, [-1e17] * 8, 6)]
    assert got(spark, rows, rounds=2) == by_hand(rows, rounds=2)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)]):
        found = codes.encode(frame(spark, rows))
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and found.count() == 0
    with pytest.raises(ValueError):
        codes.encode(frame(spark, []), entries=300)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_skips_and_is_exact(kind, monkeypatch):
    """From whatever start, the nearest entry; and far fewer distances than rows times entries where the start is near."""
    r = np.random.default_rng(1)
    book = r.integers(-1000, 1000, (16, 8)).astype(kind)
    rows = (book[r.integers(0, 16, 500)] + r.integers(-20, 20, (500, 8))).astype(kind)
    every = np.stack([codes.distances(rows, c) for c in book], axis=1)
    nearest = every.argmin(axis=1)
    near, measured, plain = codes.Neighbours(book), [], codes.distances
    monkeypatch.setattr(codes, "distances", lambda a, b: measured.append(len(a)) or plain(a, b))
    for start in (nearest, r.integers(0, 16, 500), np.zeros(500, int)):
        measured.clear()
        best, error = near.search(rows, start)
        assert (best == nearest).all() and (error == every.min(axis=1)).all()
        if start is nearest:
            assert sum(measured) == 500


def test_a_hot_label(spark):
    rows = [(i, v, 1 if i % 3 else i) for i, v, _ in vectors(200, 8, 8)]
    wanted, found = by_hand(rows, rounds=1), got(spark, rows, rounds=1)
    assert found == wanted


def test_codebooks(spark):
    """``fit`` gives the codebooks that the digest is of; decoding with them gives the errors back."""
    rows = vectors(80, 16, 9)
    blocks, books = codes.fit(frame(spark, rows))
    digests = {r.codebooks_sha256 for r in codes.encode(frame(spark, rows)).collect()}
    assert digests == {codes.digest(books)} and len(books) == 8 and books[0].shape == (16, 2)
    by_id = {i: v for i, v, _ in rows}
    for r in codes.encode(frame(spark, rows)).collect():
        entry = [int(r.code[k : k + 2], 16) for k in range(0, 16, 2)]
        numbers = [math.floor(4096 * x) for x in by_id[r.vec_id]]
        assert r.error == sum((a - int(b)) ** 2 for p in range(8) for a, b in zip(numbers[2 * p : 2 * p + 2], books[p][entry[p]], strict=True))
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 80
