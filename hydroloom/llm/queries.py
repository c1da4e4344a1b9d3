"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hydroloom.llm import align, bpe, decontaminate, exact, language, quality, rules, secrets, simhash, substring, suffix, tokens, whiten

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


@query
def op5_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, unigram tokens and path score of every document."""
    return tokens.count_tokens(documents(spark, sf_dir), tokens.rank_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return exact.exact_groups(documents(spark, sf_dir))


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

ORACLES["op6_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(documents(spark, sf_dir))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document and whether it is accepted."""
    return quality.classify(documents(spark, sf_dir))


@query
def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by an incremental ledger of blobs."""
    return secrets.document_secrets(documents(spark, sf_dir))


@query
def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated spans."""
    return substring.dedup(documents(spark, sf_dir))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that hold a window of a benchmark item with a few other words between its own."""
    return decontaminate.proximity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op9_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{decontaminate.WORD}') AS own FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{decontaminate.WORD}') AS item FROM benchmark),
i AS (SELECT *, least(len(item), {decontaminate.WINDOW}) AS span FROM b WHERE len(item) > 0),
w AS (SELECT DISTINCT item_id, span, array_to_string(item[k : k + span - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(item) - span + 2)) AS k FROM i)),
s AS (SELECT DISTINCT span FROM w),
p AS (SELECT doc_id, span, k, array_to_string(own[k : k + span - 1], ' ') AS phrase
      FROM (SELECT doc_id, own, span, unnest(range(1, len(own) - span + 2)) AS k FROM d, s WHERE len(own) >= span)),
h AS (SELECT doc_id, item_id, k, p.span FROM p JOIN w USING (span, phrase)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + span)) AS pos FROM h) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT doc_id, len(own)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * {decontaminate.MIN_HIT_SHARE} >= len(own) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings of 200 bytes."""
    return suffix.remove_repeats(documents(spark, sf_dir))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the plain rules' verdict, and that of the robust outlier test."""
    return rules.judge(documents(spark, sf_dir))


@query
def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two vocabularies in every document."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.align_tokens(documents(spark, sf_dir), *paths, public_tokenizers.PATTERN)


@query
def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable embedding."""
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
