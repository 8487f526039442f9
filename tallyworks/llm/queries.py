"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, html_text, language_id, mixing, order_minhash, pii, prefix_trie, simhash, token_counts, toxicity, vector_codes
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda spark, d: language_id.op1(table(spark, d, "documents")),
        "op2_token_counts": lambda spark, d: token_counts.op2(table(spark, d, "documents")),
        "op3_pii": lambda spark, d: pii.op3(table(spark, d, "documents")),
        "op4_chat_format": lambda spark, d: chat_format.op4(table(spark, d, "conversations")),
        "op5_toxicity": lambda spark, d: toxicity.op5(table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_decontaminate": lambda spark, d: decontaminate.op6(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_exact_dedup": lambda spark, d: exact_dedup.op7(table(spark, d, "documents")),
        "op8_simhash": lambda spark, d: simhash.op8(table(spark, d, "documents")),
        "op9_html_text": lambda spark, d: html_text.op9(table(spark, d, "pages")),
        "op10_mixing": lambda spark, d: mixing.op10(table(spark, d, "documents")),
        "op11_prefix_trie": lambda spark, d: prefix_trie.op11(table(spark, d, "conversations")),
        "op12_vector_codes": lambda spark, d: vector_codes.op12(table(spark, d, "embeddings")),
        "op13_order_minhash": lambda spark, d: order_minhash.op13(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY norm)""",
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_vector_codes": vector_codes.oracle(),
    }
