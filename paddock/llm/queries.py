"""The queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import alignment, ann, chat, codes, jaccard, language_id, line_dedup, lm, mixing, packing, sharding, tokens, topk


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; documents have a source for a host, pages have an address and markup too."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.fit(docs)
    none = F.lit(None).cast("string")
    texts = docs.select(F.struct(F.col("doc_id"), F.lit(None).cast("long").alias("page_id")).alias("id"), "text", F.col("source").alias("host"), none.alias("site"), none.alias("suffix"), none.alias("markup"))
    sites = language_id.page_evidence(pages).select(F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("page_id")).alias("id"), "text", "host", "site", "suffix", "markup")
    found = language_id.identify(texts.unionByName(sites), model, "host", "markup", "suffix", "site", id_col="id")
    return found.select("id.doc_id", "id.page_id", "language", "probability", "text_language", "trigrams", "accepted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own ratio of a fiftieth and at least five pages; copies of a text in a source are one page."""
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "text", F.col("lines_dropped").cast("long").alias("lines_dropped"))


OP2 = r"""
WITH lines AS (
  SELECT doc_id, source, text, i, parts[i] AS line, trim(parts[i], ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS r(i)),
pages AS (SELECT source, count(DISTINCT text) + count(DISTINCT text IS NULL) FILTER (text IS NULL) AS n FROM documents GROUP BY source),
boiler AS (
  SELECT l.source, l.bare FROM (SELECT source, bare, count(DISTINCT text) AS n FROM lines WHERE bare <> '' GROUP BY source, bare) l
  JOIN pages p ON l.source = p.source WHERE l.n >= 5 AND l.n > 0.02::DOUBLE * p.n)
SELECT l.doc_id, l.source, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.bare IS NULL), '') AS text,
       count(*) FILTER (b.bare IS NOT NULL) AS lines_dropped
FROM lines l LEFT JOIN boiler b ON l.source = b.source AND l.bare = b.bare
GROUP BY l.doc_id, l.source
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP4 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl FROM s1),
s3 AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lvl, cap / w) FROM s2 WHERE lvl * w <= cap * (1 + 1e-12)), 0) * w) AS target FROM s2),
r AS (SELECT d.*, s3.source_size, s3.target, CASE WHEN size > 0 AND target > 0 THEN least(3, ceil(target / source_size)::INT) ELSE 0 END AS rounds
      FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
t AS (SELECT r.*, turn, md5('17:' || doc_id || ':' || turn) AS place FROM r, unnest(range(0, rounds)) AS u(turn)),
f AS (SELECT *, (turn * source_size + sum(size) OVER (PARTITION BY source, turn ORDER BY place ROWS UNBOUNDED PRECEDING)) / target AS finish FROM t),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, place ROWS UNBOUNDED PRECEDING) AS upto FROM f),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE upto <= (SELECT sum(source_size) FROM s0) GROUP BY doc_id)
SELECT r.doc_id, r.size::BIGINT AS size, r.source_size, r.target, coalesce(k.taken, 0)::BIGINT AS taken FROM r LEFT JOIN k USING (doc_id)
"""


#: One more conversation, whose texts hold the control strings.
AWKWARD = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", AWKWARD), (-1, 1, "assistant", AWKWARD)], talks.schema)
    return chat.digest(chat.expand(talks.unionByName(more)))


OP5 = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
w AS (SELECT *, sum(23 + 1 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
             turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR last) AS n_examples
FROM w GROUP BY conv_id
"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
"""


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "cut_bytes")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), lambda i: F.crc32(i.cast("string").cast("binary")) % 7 == 2)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards in three regions of two racks; one more shard is a region of its own."""
    found = sharding.assign(table(spark, sf_dir, "documents"), sharding.Tree.of(24))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# The checksum bit by bit: each byte is followed by eight steps. Draws: regions of weight 8 (one more of 1), racks of 4, shards of 1.
OP11 = r"""
WITH b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce('=' || doc_id, '-') AS key,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
d AS (
  SELECT doc_id, size, key, ('0x' || substr(md5('11:slot:' || key), 1, 12))::BIGINT AS place,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(bytes, lambda x: [x, 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS text_crc32,
    list_transform(range(0, 4), lambda i: -ln((('0x' || substr(md5('11:' || i || ':' || key), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) / CASE WHEN i < 3 THEN 8 ELSE 1 END) AS draws FROM b),
r AS (SELECT *, list_position(draws[1:3], list_min(draws[1:3])) - 1 AS region, list_position(draws, list_min(draws)) = 4 AS more FROM d),
k AS (SELECT *, list_transform(range(0, 2), lambda i: -ln((('0x' || substr(md5('11:' || region || ':' || i || ':' || key), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) / 4) AS racks FROM r),
s AS (SELECT *, list_position(racks, list_min(racks)) - 1 AS rack FROM k),
t AS (SELECT *, list_transform(range(0, 4), lambda i: -ln((('0x' || substr(md5('11:' || region || ':' || rack || ':' || i || ':' || key), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656)) AS leaves FROM s),
u AS (SELECT *, (8 * region + 4 * rack + list_position(leaves, list_min(leaves)) - 1)::INT AS shard FROM t)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot, CASE WHEN more THEN 24 ELSE shard END AS grown_shard
FROM u
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


def _op13(rounds: int = 6) -> str:
    """Assignments and moves in turn, as many as there are rounds; of equal distances the lower index is least."""
    steps = [
        """
a{0} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(x, lambda y, i: (y - c[i]) * (y - c[i])))::HUGEINT * 16 + e) AS best
                      FROM parts JOIN b{0} USING (p) GROUP BY vec_id, p)"""
        + """,
s{1} AS (SELECT p, best % 16 AS e, i, sum(x[i]) AS total, count(*) AS n FROM a{0}, range(1, 9) AS r(i) GROUP BY ALL),
m{1} AS (SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c FROM s{1} GROUP BY p, e),
b{1} AS MATERIALIZED (SELECT p, e, coalesce(m{1}.c, b{0}.c) AS c FROM b{0} LEFT JOIN m{1} USING (p, e))"""
        * (k < rounds)
        for k in range(rounds + 1)
    ]
    turns = ",".join(step.format(k, k + 1) for k, step in enumerate(steps))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1 : p * 8 + 8] AS x FROM kept, range(0, 8) AS r(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 16),{turns},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', (best % 16)::INT), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error
          FROM a{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_chat_formatting": op5_chat_formatting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_exact_top_k": op7_exact_top_k,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op8_token_counts": op8_token_counts,
    "op9_lm_scoring": op9_lm_scoring,
    "op11_sharding": op11_sharding,
    "op12_alignment": op12_alignment,
    "op13_codes": op13_codes,
}

ORACLES: dict[str, str] = {"op2_line_dedup": OP2, "op4_mixing": OP4, "op5_chat_formatting": OP5, "op7_exact_top_k": OP7, "op11_sharding": OP11, "op13_codes": _op13()}
