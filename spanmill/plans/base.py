"""The driver's tables without repeated rows, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

TOKEN_COLUMNS = ["corpus", "doc_id", "sent_id", "tok_idx", "in_sent_idx", "token", "pos", "ner", "speaker", "parse_bit", "head", "deprel"]
MENTION_COLUMNS = [
    "mention_id", "doc_id", "mention_idx", "span", "sent_id", "tokens", "pos", "ner", "head", "head_span", "head_index", "fine_type", "citation_form", "number", "gender", "semantic_class",
    "grammatical_function", "speaker", "is_apposition", "annotated_set_id", "set_id", "antecedent", "first_in_gold_entity", "governor", "deprel", "ancestry",
]


def tokens(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Distinct token rows of the given columns (all but ``loaded_at`` by default); columns that aren't named are never read."""
    return table(spark, sf, "tokens").filter("doc_id IS NOT NULL AND tok_idx IS NOT NULL").select(*(columns or TOKEN_COLUMNS)).distinct()


def mentions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Distinct mention rows with ``type`` trimmed in upper case and both lowercase strings made from the tokens."""
    wanted = list(columns) if columns else MENTION_COLUMNS
    m = table(spark, sf, "mentions").filter("mention_id IS NOT NULL AND doc_id IS NOT NULL")
    kind = F.upper(F.trim("type")).alias("type")
    rows = m.select(*[kind if c == "type" else c for c in dict.fromkeys(["mention_id", *wanted, *([] if columns else ["type"])])])
    out = rows.distinct()
    out._spanmill_rows = rows
    return out


def delivered(m: DataFrame) -> DataFrame:
    """The rows of :func:`mentions` as they come, some of them twice, with a hash of each as ``_row``."""
    rows = getattr(m, "_spanmill_rows", m)
    return rows.withColumn("_row", F.xxhash64(*rows.columns))


def with_strings(m: DataFrame) -> DataFrame:
    return m.withColumns({"head_as_lowercase_string": F.lower(F.array_join("head", " ")), "tokens_as_lowercase_string": F.lower(F.array_join("tokens", " "))})


def event_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as mentions: user = document, order of time = index from 1, type = key entity, ``k`` of the props modulo 5 = response entity."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props").distinct()
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("doc_id"), F.row_number().over(w).alias("mention_idx"), "event_id", "event_type", F.pmod(k, F.lit(5)).alias("response"), F.to_date("ts").alias("day"),
    )


T = "t AS (SELECT DISTINCT " + ", ".join(TOKEN_COLUMNS) + " FROM tokens WHERE doc_id IS NOT NULL AND tok_idx IS NOT NULL)"
M = (
    "m AS (SELECT DISTINCT " + ", ".join(MENTION_COLUMNS) + ", upper(trim(type)) AS type, lower(array_to_string(head, ' ')) AS head_text, lower(array_to_string(tokens, ' ')) AS text"
    " FROM mentions WHERE mention_id IS NOT NULL AND doc_id IS NOT NULL)"
)
E_ = (
    "e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS mention_idx, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS response, CAST(ts AS DATE) AS day"
    " FROM (SELECT DISTINCT event_id, ts, user_id, event_type, props FROM events))"
)
