"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import groups, names, overlap, packing, privacy, splits, terms, tokenizer
from .common import spread

FIELDS = {"head": "head_as_lowercase_string", "tokens": "tokens_as_lowercase_string"}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_related(table(spark, sf, "conll_docs")).filter("group_size > 1").select("doc_key", "group_key")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_related(table(spark, sf, "conll_docs")).select("doc_key", "group_key", "split")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.spelling_pairs(table(spark, sf, "mentions"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.linked_mentions(table(spark, sf, "mentions"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.mention_groups(table(spark, sf, "mentions"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf, "conll_docs"), width=3, threshold=0.5)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select(F.col("key_a").alias("doc_key_a"), F.col("key_b").alias("doc_key_b"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, sf), table(spark, sf, "conll_docs"), splits.source_key(F.col("doc_id")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(table(spark, sf, "mentions"), FIELDS).filter("mark IS NOT NULL").select("field", "term", "mark")


def p6_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(table(spark, sf, "mentions"), FIELDS)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode(_documents(spark, sf), keep_text=False)


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(tokenizer.sizes(_documents(spark, sf), keep_text=False))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.find_personal(_documents(spark, sf), privacy.session_secret(spark)).select("doc_id", "kind", "found")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.redact_personal(_documents(spark, sf), privacy.session_secret(spark))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p2_found, p3_found, p3_groups, p5_found, p5_report, p6_found, p6_terms, p7_ids, p8_containers, p9_found, p9_redacted)}

_MENTIONS = "(SELECT DISTINCT mention_id, doc_id, mention_idx, set_id, antecedent, head_as_lowercase_string, tokens_as_lowercase_string FROM mentions WHERE mention_id IS NOT NULL)"

_TERMS = f"""
    WITH m AS {_MENTIONS},
         v AS (SELECT 'head' AS field, mention_id, doc_id, head_as_lowercase_string AS value FROM m UNION ALL SELECT 'tokens', mention_id, doc_id, tokens_as_lowercase_string FROM m),
         t AS (SELECT field, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS term, mention_id, doc_id FROM v),
         c AS (SELECT field, term, count(DISTINCT mention_id) AS n_mentions, count(DISTINCT doc_id) AS n_documents FROM t WHERE term <> '' GROUP BY ALL),
         r AS (SELECT *, CASE WHEN n_mentions <= 2 THEN 'rare' WHEN n_documents >= 0.1 * (SELECT count(DISTINCT doc_id) FROM mentions) THEN 'common' END AS mark FROM c)"""

ORACLE = {
    "p6_found": _TERMS + " SELECT field, term, mark FROM r WHERE mark IS NOT NULL",
    "p6_terms": _TERMS + " SELECT field, term, n_mentions, n_documents, mark FROM r",
}
