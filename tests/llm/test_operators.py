"""Each operator against a brute-force version or an exact round trip, with the cases that tables may hold."""

import binascii
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paddock.llm import ann, chat, jaccard, language_id, line_dedup, lm, mixing, packing, queries, tokens, topk, vectors as vectors_module

from ..compare import SF, same

WORD = re.compile("[^\x20\x09-\x0d]+")
BYTE, LOWER = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: Columns beside those of the contract have the names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token long, size int, id string, length int, lines_dropped int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, 7, 9, "x", 3, 4) for i, t, lang, src in rows], DOCS)


def awkward():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choices(vocabulary, k=n) for n in (60, 80, 200, 400)]
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one two", "en", "a"), (5, "ONE  two", "en", "a"), (6, "one two", None, "b")]
    for k in range(40):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 12])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((10 + k, " ".join(words[r.choice([0, 0, 5]) :]), "en", r.choice("aab")))
    rows += [(60, "İ Σé x y <|endoftext|>  don't 12 3456  !!\x1c z  ", "en", "a"), (61, "ab " * 30_000, "de", "a"), (61, "ab " * 30_000, "de", "a"), (None, "one two", "en", "a")]
    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(spark, queries.QUERIES, queries.ORACLES, name)


def shingled(text):
    words = tuple(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or ""))
    return {words[i : i + 5] for i in range(len(words) - 4)} if len(words) >= 5 else {words} - {()}


def test_jaccard(spark):
    rows = awkward()
    sets = [shingled(t) for _, t, _, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if None not in (rows[i][0], rows[j][0]) and (rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= 80 * len(a | b)):
                up[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least[root(i)], r[0])
    wanted = Counter((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows) if r[0] is not None)
    got = jaccard.jaccard_components(docs_of(spark, rows)).collect()
    assert Counter(tuple(r) for r in got if r[0] is not None) == wanted
    assert len(got) == len(rows)


def test_jaccard_over_documents(spark):
    """The query's components on the smallest tables are those of all pairs."""
    texts = {r.doc_id: shingled(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    by = {d: d for d in texts}

    def root(i):
        while by[i] != i:
            i = by[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if j < i and texts[i] and texts[j] and min(len(texts[i]), len(texts[j])) * 100 >= 80 * max(len(texts[i]), len(texts[j])) and 100 * len(texts[i] & texts[j]) >= 80 * len(texts[i] | texts[j]):
                a, b = sorted((root(i), root(j)))
                by[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard(spark, SF).collect()}
    assert got == {d: (len(texts[d]), root(d)) for d in ids}


def test_jaccard_long_chains(spark):
    """Successive revisions, each linked only to the next: falling ids after the least, and ids at random."""
    n = 200
    falling, shuffled = [0, *range(n - 1, 0, -1)], random.Random(4).sample(range(1000, 1000 + n), n)
    text = lambda c, i: " ".join(f"{c}{k}" for k in range(10 * i, 10 * i + 100))
    rows = [(node, text(c, i)) for c, ids in (("x", falling), ("y", shuffled)) for i, node in enumerate(ids)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {node: 0 if node < 1000 else 1000 for node, _ in rows}


@pytest.mark.parametrize("hot", [2, 1000, 1 << 40])
def test_components_with_hubs(spark, monkeypatch, hot):
    """Hubs, chains between them and lone pairs, whichever keys count as frequent: all, some or none."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(7)
    edges = [(5000, i) for i in range(1000, 1400)] + [(i, 6000) for i in range(2000, 2300)] + [(1399, 7000), (7000, 7001), (7001, 2000)]
    edges += [(i, i + 1) for i in range(8000, 8100, 2)] + [(9000, 9000), (5000, 1000)]
    rng.shuffle(edges)
    by = {}

    def root(i):
        while by.setdefault(i, i) != i:
            i = by[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            by[high] = low
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(by) and {r.node: r.component for r in got} == {i: root(i) for i in list(by)}


@pytest.mark.parametrize("hot", [2, 1000])
def test_linked_with_a_hub(spark, monkeypatch, hot):
    """Pairs of one hub, at either end, and others: those that link stay, each once."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    words = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(words[: 100 - i % 40]) for i in range(80)}
    pairs = [(0, i) for i in range(1, 80)] + [(i, 79) for i in range(60)] + [(3, 4), (3, 4)]
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = jaccard._linked(spark.createDataFrame(pairs, "a long, b long"), docs, 5, 80).collect()
    sets = {i: shingled(t) for i, t in texts.items()}
    assert sorted(map(tuple, got)) == sorted({(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])})


def test_components_of_nothing(spark):
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("path", [LOWER, BYTE])
def test_word_ids_of_any_file(path):
    """A file whose texts may not be cut goes to the library whole."""
    ids, library = packing.WordIds(path), Tokenizer.from_file(path)
    assert ids.cut == (path == LOWER)
    texts = ["", " ", "Ab, c\nd. e", "don't  stop,\tno.", "x <|endoftext|> y", "\u03a3\u03a3 a", "ein , zwei\n\ndrei"]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(spark):
    rows = awkward()
    library = Tokenizer.from_file(BYTE)
    got = tokens.prefix_counts(docs_of(spark, rows), BYTE, limit=20).collect()
    wanted = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == wanted
    texts = {i: t or "" for i, t, _, _ in rows}
    for r in got:
        text = texts[r.doc_id].encode()
        for k in {0, 1, 2, 3, 7, 11, len(text) // 2, len(text) - 1, r.cut_bytes}:
            if 0 <= k <= min(len(text), 2000):
                try:
                    prefix = text[:k].decode()
                except UnicodeDecodeError:
                    continue
                if r.doc_id != 60:  # prefixes within a special string are another text
                    assert tokens.count_at(bytes(r.prefix_deltas), k) == len(library.encode(prefix, add_special_tokens=False).ids), (r.doc_id, k)


def test_token_counts_of_many_special_strings():
    text = "some text <|endoftext|> more  " * 3000
    deltas = tokens.counter(BYTE).deltas(text)
    assert len(deltas) == len(text)
    assert tokens.count_at(deltas) == len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)


def test_cuts_end_with_a_character(spark):
    """Whatever the budget, a cut text is text."""
    text = "\U0001f600é" * 25 + " ab"
    deltas = tokens.counter(BYTE).deltas(text)
    for budget in range(0, 120):
        cut = tokens.longest_within(deltas, budget, text)
        data = text.encode()[:cut]
        assert data.decode() == text[: len(data.decode())] and tokens.count_at(deltas, cut) <= budget
        assert cut <= tokens.longest_within(deltas, budget) < cut + 4
    got = tokens.prefix_counts(docs_of(spark, [(1, text, "en", "a"), (2, "é", "en", "a")]), BYTE, limit=20).collect()
    assert {r.doc_id: r.cut_bytes for r in got} == {1: tokens.longest_within(deltas, 20, text), 2: 2}


@pytest.mark.parametrize("make", [lambda d: tokens.prefix_counts(d, BYTE), lambda d: packing.pack(d, LOWER), jaccard.jaccard_components, lambda d: lm.score(d, lambda i: i == 1), mixing.mix])
def test_empty_tables(spark, make):
    """No rows, of the same columns."""
    docs = docs_of(spark, awkward())
    found = make(docs.limit(0))
    assert found.count() == 0 and found.columns == make(docs.limit(3)).columns


def test_chat_of_an_empty_table(spark):
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.expand(talks)).count() == 0


def test_packing(spark):
    rows = awkward()
    library = Tokenizer.from_file(LOWER)
    got = packing.pack(docs_of(spark, rows), LOWER).collect()
    pieces = Counter()
    for i, t, _, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces[i, k, at, len(part), binascii.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    gaps = []  # best fit over falling lengths, one by one
    for length in sorted((r.length for r in got), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 4096) - length)
    assert len(used) == len(gaps)


def test_packing_many_lengths(spark):
    r = random.Random(5)
    lengths = [(i, r.choice([1, 5, 700, 1366, 2049, 3000, 4096, r.randint(1, 4096)])) for i in range(3000)]
    got = packing.best_fit(spark.createDataFrame(lengths, "id long, length long")).collect()
    used = defaultdict(list)
    for x in got:
        used[x.sequence_id].append((x.offset, x.length))
    assert sorted((x.id, x.length) for x in got) == lengths
    for spans in used.values():
        assert [o for o, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()]
        assert sum(n for _, n in spans) <= 4096
    gaps = []
    for _, length in sorted(lengths, key=lambda x: -x[1]):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 4096) - length)
    assert len(used) == len(gaps)


def test_mixing(spark):
    rows = awkward()
    docs = docs_of(spark, rows)
    first, again = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, docs.repartition(3)))
    assert first == again
    assert Counter((i, s) for i, s, *_ in first) == Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in rows)
    assert all(taken % size == 0 and taken <= 3 * size if size else taken == 0 for _, size, _, _, taken in first)
    assert sum(x[4] for x in first) <= sum(x[1] for x in first)
    empty = mixing.mix(docs.limit(0))
    assert empty.count() == 0


def test_mixing_shared_ids(spark):
    """Rows that share an id or have none: the same rows in another order and other parts give the same result; copies are taken each."""
    r = random.Random(8)
    rows = [(r.choice([1, 2, None, 50 + i]), f"w{r.randrange(6)} " * r.randrange(1, 5), "en", r.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [(7, "one and the same", "en", "a")] * 400
    outs = []
    for order, parts in ((rows, 3), (r.sample(rows, len(rows)), 8)):
        docs = docs_of(spark, order).repartition(parts)
        outs.append((sorted(map(tuple, mixing.mix(docs).collect()), key=str), Counter(map(tuple, mixing.repeat(docs).collect()))))
    assert outs[0] == outs[1]
    taken, target = Counter(), {}
    for _, size, source_size, aim, words in outs[0][0]:
        assert words <= 3 * size
        taken[source_size, aim] += words
    for (source_size, aim), n in taken.items():
        assert abs(n - aim) <= 0.05 * aim + 8, (source_size, aim, n)
    words = Counter()  # the mix itself: the same words of rows whose id is theirs alone, about the same of the others
    for row, n in outs[0][1].items():
        words[row[0]] += n * len(row[1].split())
    mixed = Counter()
    for i, _, _, _, n in outs[0][0]:
        mixed[i] += n
    assert all(abs(words[i] - mixed[i]) <= (0 if i is not None and i > 50 else 0.1 * mixed[i]) for i in mixed | words)


def test_mixing_meets_targets(spark):
    taken, target = Counter(), {}
    for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
    largest = 20_000
    for key, n in taken.items():
        assert abs(n - target[key]) <= max(0.1 * target[key], 2 * largest)


def test_line_dedup(spark):
    rows = [(i, f"menu\n body {i}\n\nfooter \r", "en", "a") for i in range(20)] + [(50, None, "en", "a"), (51, "", "en", "b"), (52, "menu\nmenu", None, None), (53, "menu", None, "b")]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[3] == (" body 3\n", 2)
    assert got[50] == (None, 0) and got[51] == ("", 0) and got[52] == ("menu\nmenu", 0) and got[53] == ("menu", 0)
    assert line_dedup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_line_dedup_large_host(spark):
    """A line on 3% of a host's pages goes, in the operator and in the pipeline's stage; one on 1% stays."""
    rows = [(i, f"body {i}" + "\nfollow us" * (i < 30) + "\nas they say" * (i >= 990), "en", "a") for i in range(1000)]
    for out in (line_dedup.dedup_lines(docs_of(spark, rows)), corpus_pipeline.lines(spark, docs_of(spark, rows), SF)):
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == {i: t.removesuffix("\nfollow us") for i, t, *_ in rows}


def test_line_dedup_of_copies(spark):
    """Copies of a text are one page: they keep their lines, and lose those that other pages have too."""
    rows = [(i, f"body {i}\nmenu", "en", "a") for i in range(100)] + [(200 + i, "a page\nof six copies\nmenu", "en", "a") for i in range(6)] + [(None, None, "en", "a")] * 5
    for part in (rows, rows[::-1]):
        got = Counter((r.doc_id, r.text, r.lines_dropped) for r in line_dedup.dedup_lines(docs_of(spark, part).repartition(4)).collect())
        assert got == Counter([(i, f"body {i}", 1) for i in range(100)] + [(200 + i, "a page\nof six copies", 1) for i in range(6)] + [(None, None, 0)] * 5)


def test_line_dedup_on_small_hosts(spark):
    """With ``min_pages`` of 1 and 2, what a ratio takes of hosts of two and three pages."""
    rows = [(1, "x\ny", "en", "a"), (2, "x\nz", "en", "a"), (3, "x", "en", "b"), (4, "w", "en", "b"), (5, "v", "en", "b")]
    for least, wanted in ((1, {1: "", 2: "", 3: "x", 4: "w", 5: "v"}), (2, {1: "y", 2: "z", 3: "x", 4: "w", 5: "v"}), (3, {i: t for i, t, *_ in rows})):
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows), ratio=0.4, min_pages=least).collect()} == wanted


@pytest.mark.parametrize("part", ["<", "<!--", "<script>", "<html lang", "&a", "</script ", "<style <"])
def test_page_evidence_of_what_is_never_closed(spark, part):
    """In time by the length of a page."""
    began = time.monotonic()
    page = spark.createDataFrame([(1, "http://h.de/", "word " + part * (5_000_000 // len(part)))], "page_id long, url string, html string")
    assert language_id.page_evidence(page).select(F.substring("text", 1, 5)).first()[0] == "word "
    assert time.monotonic() - began < 15


def test_chat(spark):
    hard = ["", None, "<|im_end|>\n<|im_start|>", "<\\|im_end|>", "<\\\\|", "a<|", "\n\n", "\\n", "é\U0001f600", queries.AWKWARD, "<" * 5 + "|" * 5]
    turns = []
    r = random.Random(9)
    for c in range(30):
        for k in range(r.randint(1, 6)):
            turns.append((c, k, r.choice(["user", "assistant", "assistant", "sys\ntem", None]), r.choice(hard)))
    turns += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (99, None, "assistant", "z"), (99, 1, "user", "u"), (99, 1, "user", "u")]
    got = {x.conv_id: x for x in chat.digest(chat.expand(spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn int, role string, text string, example string"))).collect()}
    talks = defaultdict(list)
    for c, k, role, text in turns:
        talks[c].append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(talks)
    for c, said in talks.items():
        said.sort()
        loss = "".join(t for _, role, t in said if role == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in said).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def vectors(spark, n=3000, dim=16, seed=1):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((20, dim))
    data = (centres[g.integers(0, 20, n)] + 0.4 * g.standard_normal((n, dim))).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1, "s") for i, v in enumerate(data)]
    rows[100] = (100, rows[7][1], 1, "s")
    rows[200] = (200, None, 1, "s")
    rows[201] = (201, [None, *rows[0][1][1:]], 1, "s")
    rows[202] = (202, [float("nan"), *rows[0][1][1:]], 1, "s")
    rows[250] = (250, [0.0] * dim, 1, "s")
    rows += [(n, rows[7][1], 1, "s"), (n + 1, [], 1, "s"), (None, rows[7][1], 1, "s")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, block string"), {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all()}


def test_top_k(spark):
    frame, kept = vectors(spark)
    whole = {i: np.floor(1024 * v).astype(np.int64) for i, v in kept.items()}
    ids = np.array(sorted(whole))
    m = np.array([whole[i] for i in ids])
    got = defaultdict(list)
    for r in topk.top_k(frame, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in whole if i % 100 == 0}
    for q in got:
        s = m @ whole[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:10]
        assert got[q] == [(i + 1, int(ids[k]), int(s[k])) for i, k in enumerate(order)]
    assert topk.top_k(frame.limit(0), lambda i: i % 100 == 0).count() == 0


def test_top_k_large_components(spark):
    """Components far beyond usual ones: doubles, 64-bit and whole Python numbers."""
    rows = [(100, [1.0, 0.0]), (200, [100000.0, 0.0]), (300, [200000.0, 0.0]), (400, [-3.5e9, 2.25]), (500, [3.0e15, 1.0]), (1, [1e12, -7.0]), (2, [1e12, 7.0])]
    got = defaultdict(list)
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in (100, 200, 300, 400, 500):
        scores = {i: sum(a * b for a, b in zip(whole[q], v, strict=True)) for i, v in whole.items() if i != q}
        held = {i: max(-(2**63), min(2**63 - 1, s)) for i, s in scores.items()}
        assert got[q] == sorted(held.items(), key=lambda x: (-x[1], x[0])), q


def test_nearest(spark):
    frame, kept = vectors(spark)
    unit = {i: v for i, v in kept.items() if v.any()}
    ids = np.array(sorted(unit))
    m = np.array([unit[i] for i in ids])
    hits = total = 0
    got = defaultdict(list)
    for r in ann.nearest(frame, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in unit if i % 50 == 0}
    for q, found in got.items():
        c = (m @ unit[q]) / np.linalg.norm(m, axis=1) / np.linalg.norm(unit[q])
        order = [int(ids[k]) for k in np.lexsort((ids, -c)) if ids[k] != q][:5]
        hits, total = hits + len({r.vec_id for r in found} & set(order)), total + 5
        where = {int(i): k for k, i in enumerate(ids)}
        assert all(math.isclose(r.score, c[where[r.vec_id]], rel_tol=1e-12) for r in found)
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and sorted((-r.score, r.vec_id) for r in found) == [(-r.score, r.vec_id) for r in found]
    assert hits / total >= 0.9
    assert ann.nearest(frame.limit(0), lambda i: i % 50 == 0).count() == 0


def test_top_k_of_wide_vectors(spark, monkeypatch):
    """2000 dimensions beside a few, in cells of few bytes: all pairs."""
    monkeypatch.setattr(vectors_module, "CELL_BYTES", 1 << 20)
    monkeypatch.setattr(vectors_module, "PACK_BYTES", 200_000)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=2000 if i % 3 else 4).tolist()) for i in range(120)]
    got = defaultdict(list)
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), lambda i: i % 10 == 0, 5).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    for i, v in rows[::10]:
        whole = lambda u: np.floor(np.array(u) * 1024).astype(int)
        scored = sorted((-int(whole(v) @ whole(u)), j) for j, u in rows if j != i and len(u) == len(v))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]


def test_nearest_on_embeddings_over_many_shards(spark, monkeypatch):
    """Recall on the table itself, against brute force, over some ten shards of several leaves."""
    monkeypatch.setattr(vectors_module, "SHARD_ROWS", 200)
    rows = {x.vec_id: np.array(x.embedding, np.float64) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    got = defaultdict(set)
    for x in queries.op10_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[x.query_id].add(x.vec_id)
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids])
    m /= np.linalg.norm(m, axis=1)[:, None]
    hits = 0
    for q, found in got.items():
        c = m @ m[np.searchsorted(ids, q)]
        hits += len(found & set([int(ids[k]) for k in np.lexsort((ids, -c)) if ids[k] != q][:5]))
    assert len(ids) >= 10 * 200 and hits / (5 * len(got)) >= 0.9


def counted(texts):
    counts, pairs, triples = Counter(), Counter(), Counter()
    for ws in texts:
        counts.update([*ws, ">"])
        pairs.update(zip(["<", *ws], [*ws, ">"], strict=True))
        triples.update(zip(["<", "<", *ws][: len(ws) + 1], ["<", *ws], [*ws, ">"], strict=True))
    return counts, pairs, triples


def trigram_score(ws, counts, pairs, triples, z, docs, m=300, k=0.01):
    """The model's formula, a word at a time."""
    total = 0.0
    for u, v, w in zip(["<", "<", *ws][: len(ws) + 1], ["<", *ws], [*ws, ">"], strict=True):
        over = triples[u, v, w] + k * (pairs[v, w] + m * (counts[w] + 1) / z)
        under = (docs if v == "<" else pairs[u, v]) + k * ((docs if v == "<" else counts[v]) + m)
        total += math.log10(over / under)
    return total


def test_lm(spark):
    rows = awkward()
    marked = lambda i: i % 5 == 0
    got = lm.score(docs_of(spark, rows), lambda c: c % 5 == 0).collect()
    words = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] for _, t, _, _ in rows]
    counts, pairs, triples = counted(ws for (i, *_), ws in zip(rows, words, strict=True) if i is None or not marked(i))
    n, v, n_docs = sum(counts.values()), len(counts), counts[">"]
    wanted = []
    for (i, *_), ws in zip(rows, words, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, ">"])
        score = trigram_score(ws, counts, pairs, triples, n + v + 1, n_docs)
        wanted.append((i, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, ">"]), base, score))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key), sorted(wanted, key=key), strict=True):
        assert a[:3] == b[:3]
        assert math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[4] - b[4]) <= 0.03 * a[1] + 1e-6  # the steps of both logs are about a 255th of six
    assert {r.train_tokens for r in got} == {n}
    assert lm.score(docs_of(spark, rows).limit(0), lambda c: c % 5 == 0).count() == 0


def test_lm_knows_every_word(spark):
    """P0 has the count of each word of a large vocabulary, however many there are."""
    often, once = [f"a{i}" for i in range(66_000)], [f"b{i}" for i in range(66_000)]
    rows = [(k, " ".join(often[(k + 1) * i % 66_000] for i in range(66_000))) for k in (0, 6, 12, 16, 18, 22, 28, 30)] + [(40, " ".join(once))]
    held = {101: once[::-7][:300], 102: often[::-7][:300], 103: ["new", once[5], "newer", often[3]] * 20}
    counts, pairs, triples = counted(text.split() for _, text in rows)
    z = sum(counts.values()) + len(counts) + 1
    frame = spark.createDataFrame([*rows, *((i, " ".join(words)) for i, words in held.items())], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(frame, lambda c: c > 100, shard_tokens=20_000).filter("held_out").collect()}  # some thirty shards
    assert set(got) == set(held)
    for i, words in held.items():
        wanted = trigram_score(words, counts, pairs, triples, z, counts[">"])
        assert abs(got[i] - wanted) <= 0.03 * (len(words) + 1), i


def test_lm_beats_base_on_held_out(spark):
    held = queries.op9_lm_scoring(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_elias_fano():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 40_000):
        values = np.sort(g.integers(0, 1 << 62, n).astype(np.uint64))
        blob = lm.EliasFano.build(values).dump()
        seq, end = lm.EliasFano.view(blob, 0)
        assert end == len(blob)
        if n:
            assert (seq.at(np.arange(n)) == values).all()
            asked = np.concatenate([values, values + np.uint64(1), g.integers(0, 1 << 62, 100).astype(np.uint64)])
            assert (seq.successor(asked) == np.searchsorted(values, asked)).all()


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    found = language_id.identify(docs.filter("doc_id % 2 = 1 and n_chars > 100"), model, "source").join(docs.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.9
    odd = docs_of(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "123 456 !!", "en", "a"), (None, "der Hund und die Katze", None, "a")])
    got = {r.doc_id: r.accepted for r in language_id.identify(odd, model, "source").collect()}
    assert len(got) == 4 and not got[1] and not got[2] and not got[3]
    assert language_id.identify(odd.limit(0), model, "source").count() == 0


def test_language_evidence_by_hand(spark):
    """The fusion against sums made one by one: priors and evidence without the own row, missing host, site, suffix and markup, repeated rows."""
    texts = {"es": "la casa es grande y el perro corre", "de": "der Hund und die Katze sind im Haus", "?": "zzz qqq", "": ""}
    r = random.Random(12)
    model = language_id.fit(spark.createDataFrame([(texts[k], k) for k in ("es", "de")] * 3, "text string, lang string"))
    rows = [(i, texts[r.choice(["es", "de", "de", "?", ""])], r.choice([None, "a.x.de", "b.x.de", "c.es"]), r.choice([None, "x.de", "c.es"]), r.choice([None, "", "de", "es"]), r.choice([None, "de", "es"])) for i in range(60)]
    rows += [(100, texts["?"], "a.x.de", "x.de", "de", None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, h string, s string, x string, m string")
    got = Counter((g.doc_id, g.language, round(g.probability, 9)) for g in language_id.identify(frame, model, "h", "m", "x", "s").collect())
    soft = lambda v: np.exp(np.array(v) - max(v)) / np.exp(np.array(v) - max(v)).sum()
    seen = [(model.evidence(t)[0], soft(model.evidence(t)[0]) if model.evidence(t)[1] else np.zeros(2)) for _, t, *_ in rows]
    total = sum(p for _, p in seen)
    wanted = Counter()
    for i, row in enumerate(rows):
        text, own = seen[i]
        group = lambda c, i=i, row=row: sum((p for j, (_, p) in enumerate(seen) if j != i and rows[j][c] == row[c]), np.zeros(2))
        prior = (total - own + 1) / (total - own + 1).sum()
        for c in (3, 2):
            if row[c]:
                prior = (group(c) + 20 * prior) / (group(c).sum() + 20)
        logs = np.array(text) + np.log(prior)
        for c in (5, 4):
            if row[c]:
                logs = logs + np.log((group(c) + 0.5) / (total - own + 1))
        post = soft(logs)
        wanted[row[0], model.languages[int(post.argmax())], round(float(post.max()), 9)] += 1
    assert got == wanted


def test_language_sample(spark):
    """However often a text is repeated it is one, rare languages keep theirs, and the bound holds."""
    rows = [("ein Text", "de")] * 4000 + [(f"der Text {i}", "de") for i in range(3000)] + [("un texto", "es"), ("otro", "es")]
    drawn = language_id.sample(spark.createDataFrame(rows, "text string, lang string").repartition(5), sample_texts=500).collect()
    count = Counter(d.lang for d in drawn)
    assert count["es"] == 2 and 400 <= count["de"] <= 600 and len({d.text for d in drawn}) == len(drawn)


def test_declared_markup_decides(spark):
    """Of texts that say nothing either way, the declared language and the host decide."""
    docs = spark.createDataFrame([(i, "la casa es grande y el perro corre" if i % 2 else "der Hund und die Katze sind im Haus", "es" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    rows = docs.withColumn("host", F.when(F.col("lang") == "es", "h.es").otherwise("h.de")).withColumn("m", F.col("lang"))
    rows = rows.unionByName(spark.createDataFrame([(900, "zzz qqq", None, "h.es", "es"), (901, "zzz qqq", None, "h.de", "de")], rows.schema))
    got = {r.doc_id: r.language for r in language_id.identify(rows, model, "host", "m").filter("doc_id >= 900").collect()}
    assert got == {900: "es", 901: "de"}
