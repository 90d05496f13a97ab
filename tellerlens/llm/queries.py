"""The registered queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (
    ann, bpe, hard_negatives, jaccard_join, line_dedup, mixing, prefix_trie, quality_rules, secret_scan, sharding, suffix_dedup, token_counts, toxicity,
)
from .common import documents, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_quoted"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard_documents(documents(spark, sf_dir), folder=scratch_dir(spark))
    return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard", "virtual_slot")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(turns))).drop("first", "last")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).drop("n_literal")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules, "op2_token_counts": op2_token_counts, "op3_line_dedup": op3_line_dedup, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing,
        "op6_suffix_dedup": op6_suffix_dedup, "op7_nearest": op7_nearest, "op8_jaccard_join": op8_jaccard_join, "op9_sharding": op9_sharding, "op10_bpe": op10_bpe,
        "op11_prefix_trie": op11_prefix_trie, "op12_secrets": op12_secrets, "op13_hard_negatives": op13_hard_negatives,
    }


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
words AS (SELECT row_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
grams AS (SELECT row_id, i, word, lead(word, 1) OVER n AS b, lead(word, 2) OVER n AS c FROM words WINDOW n AS (PARTITION BY row_id ORDER BY i)),
twice AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, word, b, c) AS n FROM grams WHERE c IS NOT NULL),
covered AS (SELECT row_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY row_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (row_id)),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, n_repeat_words FROM m),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) || ':{mixing.SEED}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN size > 0 THEN 1 - 0.75::DOUBLE * least(1::DOUBLE, CAST(symbols AS DOUBLE) / size) ELSE 1 END) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS most FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * (SELECT arg_min(level, most / weight) FROM l WHERE most >= level * weight)) AS target FROM l),
a AS (
  SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND ahead + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM a
"""


#: CRC-32 of the decimal ids, bit by bit.
_BYTE_SQL = "CASE WHEN i % 8 = 0 THEN xor(r, CAST(unicode(s[i // 8 + 1]) AS BIGINT)) ELSE r END"
OP11_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS c, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS r FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN ({_BYTE_SQL}) & 1 = 1 THEN xor(({_BYTE_SQL}) >> 1, 3988292384) ELSE ({_BYTE_SQL}) >> 1 END FROM crc WHERE i < 8 * length(s)),
t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT c, turn, role, sha256(text) AS told, sha256(length(role) || ':' || role || text) AS k, len({WORDS_SQL}) AS w FROM t),
s AS (SELECT c, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, role, told) AS seq FROM d GROUP BY c),
r AS (
  SELECT s.c, list_concat(list_slice(coalesce(b.seq, []), 1, h), list_slice(s.seq, h + 1, len(s.seq))) AS seq
  FROM (SELECT s.*, xor(r, 4294967295) % 4 AS h FROM s JOIN crc ON crc.c = s.c AND i = 8 * length(crc.s)) AS s LEFT JOIN s AS b ON b.c = s.c - s.c % 20),
p AS (SELECT c, list_transform(list_slice(seq, 1, d), lambda x: x.k) AS path, d, len(seq) AS turns, CASE WHEN d > 0 THEN seq[d].w ELSE 0 END AS w
      FROM (SELECT *, unnest(generate_series(0, len(seq))) AS d FROM r)),
n AS (
  SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (turns = d), '') AS ends
  FROM p GROUP BY path),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT list_slice(path, 1, up) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved
      FROM (SELECT *, unnest(generate_series(0, depth)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (path) LEFT JOIN n AS q ON f.depth > 0 AND q.path = list_slice(f.path, 1, f.depth - 1)
"""

OP13_SQL = """
WITH e AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS r ON a.id % 50 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op5_mixing": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
