"""The queries of this package by name, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import archives, byte_bpe, exact_dedup, fingerprints, html_text, jaccard_join, mixing, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_html_text": html_text.op4_html_text,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_warc": archives.op7_warc,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op7_warc": archives.OP7_SQL}


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op2: each document's size and the law."""
    return sharding.op2_sharding(spark, sf_dir).select("doc_id", "size", "law")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op3: each document's length and the digest of its edited text."""
    return fingerprints.op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES |= {"shard_sizes": shard_sizes, "edited_texts": edited_texts}
ORACLE |= {
    "shard_sizes": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'bytes' AS law FROM documents",
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS k FROM documents),
n AS (SELECT a.doc_id, a.t, b.t AS n FROM d a JOIN d b ON b.k = a.k % (SELECT count(*) FROM d) + 1)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(n, 1, length(t) // 2)) AS edited_sha256 FROM n
""",
}
