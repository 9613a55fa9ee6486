"""Queries over the test tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, linededup, mixing, ngramjoin, phrases, quality, separators, suffixes, tokenfile, warc

#: Where the public tokenizers lie; set the variable to use another folder.
TOKENIZERS = os.environ.get("CLIPFRAME_TOKENIZERS")
END = 2
#: End-of-document id of the flat token files: it is no token of ordinary text.
END_OF_TEXT = 50256


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark)}/tokens"
    tokenfile.write_tokens(documents(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"), END)
    return tokenfile.read_documents(spark, path)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = warc.write_archive(pages, f"{common.shared_folder(spark)}/archive")
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark)}/flat"
    separators.write_flat(documents(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"), END_OF_TEXT)
    return separators.count_documents(spark, path, END_OF_TEXT).select("doc_id", "n_tokens")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_substrings(documents(spark, sf_dir))
    kept_text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut within a code point leaves replacement characters
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), F.char_length(kept_text).cast("bigint").alias("kept_chars"), kept_text.alias("kept_text"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_grams")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_quality_rules, op2_token_files, op3_warc_archive, op4_line_dedup, op5_token_counts, op6_fingerprints, op7_mixing, op8_suffix_dedup, op9_ngram_jaccard, op10_byte_bpe]
    return {f.__name__: f for f in [*ops, pipeline]}


OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
c AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (2 * n_dup_lines > n_lines)
    AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to
FROM q
"""

OP4 = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
x AS (SELECT k.doc_id, k.i, k.line, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (
    SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
        / (1.0 - least(0.9, 9.0 * (length(t) - length(translate(t, '#*$%&|<>', ''))) / greatest(length(t), 1))) AS key
    FROM d
),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
b AS (SELECT source, source_size, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight, 2.0 * source_size::DOUBLE AS cap, 1.5 * (sum(source_size) OVER ())::DOUBLE AS budget FROM a),
c AS (
    SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remaining,
        sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM b
),
l AS (SELECT *, min(cap / weight) FILTER (remaining / open * weight <= cap) OVER () AS first_open FROM c),
e AS (SELECT source, source_size, coalesce(least((SELECT arg_min(remaining / open, cap / weight) FROM l WHERE remaining / open * weight <= cap) * weight, cap), cap) AS target FROM l),
t AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM e),
o AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_warc_archive": OP3, "op4_line_dedup": OP4, "op7_mixing": OP7}
