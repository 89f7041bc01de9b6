"""Streams of documents: tokens and counts while texts arrive.

The batch functions that need no other row (tokenizing, tagged mentions) run on a
stream as they are.  Whole-document operators run per micro-batch: a document
arrives in one piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rawtext import tokenized


def read_texts(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """(path, arrived, text): a row per text file that appears in a folder."""
    raw = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("text"))


def token_stream(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tok_idx, token, and all other columns but the text) of a stream or a table."""
    others = [c for c in texts.columns if c not in (doc, text)]
    return texts.select(doc, *others, F.posexplode(tokenized(F.col(text))).alias("tok_idx", "token"))


def token_counts(tokens: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes", key: str = "source") -> DataFrame:
    """(window, key, n_tokens, n_documents) of event-time windows; rows later than the watermark are dropped."""
    w = tokens.withWatermark(time, late).groupBy(F.window(time, window), key)
    return w.agg(F.count(F.lit(1)).alias("n_tokens"), F.approx_count_distinct("doc_id").alias("n_documents"))


def for_each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Applies a batch operator to every micro-batch and appends its result as parquet, a folder per batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
