"""Registered queries over skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.hotkeys import heavy_keys, key_profile
from ..session import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(table(spark, sf, "tokens"), "doc_id", "tok_idx", 0.03)


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    return key_profile(table(spark, sf, "tokens"), table(spark, sf, "mentions"))


QUERIES = {"p4_found": p4_found, "p4_profile": p4_profile}

ORACLE = {
    "p4_found": """
        WITH d AS (SELECT DISTINCT doc_id, tok_idx FROM tokens WHERE doc_id IS NOT NULL AND tok_idx IS NOT NULL)
        SELECT doc_id FROM d GROUP BY doc_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM d)""",
    "p4_profile": """
        WITH t AS (SELECT doc_id, count(DISTINCT tok_idx) AS n_rows, count(DISTINCT sent_id) AS n_sentences, count(DISTINCT token) AS n_distinct_tokens
                   FROM tokens WHERE doc_id IS NOT NULL GROUP BY doc_id),
             m AS (SELECT doc_id, count(DISTINCT mention_idx) AS n_mentions FROM mentions WHERE mention_idx > 0 AND doc_id IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_mentions, 0) AS n_mentions,
               coalesce(n_distinct_tokens, 0) AS n_distinct_tokens, coalesce(n_rows, 0) >= 0.03 * (SELECT sum(n_rows) FROM t) AS is_heavy
        FROM t FULL JOIN m USING (doc_id)""",
}
