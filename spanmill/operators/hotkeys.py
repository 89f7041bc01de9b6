"""Per-key results where a few keys hold most rows.

Nothing here is keyed by the hot column alone before rows have been combined:
every shuffle moves compact, mergeable partial states that each map task has
already folded (hash aggregation spills when its table is full).  Distinct
integers are held as 64-bit masks, so a run of 64 neighbouring positions of a
key costs one shuffled row, and masks merge with a bitwise or.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_int_count(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Distinct non-null ``value`` per ``key``; rows with a null key or value don't count."""
    v = F.col(value).cast("long")
    masks = (
        df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(key), F.floor(v / 64).alias("_block"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int"))).alias("_mask"))
    )
    return masks.groupBy(key).agg(F.sum(F.bit_count("_mask")).cast("long").alias(out))


def distinct_value_count(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Distinct non-null ``value`` of any type per ``key``: partial distinct first, then a partial count."""
    return (
        df.select(F.col(key), value.alias("_v"))
        .filter(F.col(key).isNotNull() & F.col("_v").isNotNull())
        .groupBy(key, "_v").agg(F.lit(1).alias("_one"))
        .groupBy(key).agg(F.count("_one").alias(out))
    )


def heavy_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all distinct (key, value) pairs.

    The total is summed from the per-key counts, one row; at most ``1 / share``
    keys come out.  An empty table gives no rows.
    """
    per_key = distinct_int_count(df, key, value, "_n")
    total = per_key.agg(F.sum("_n").alias("_n")).scalar()
    return per_key.filter(F.col("_n") >= total * F.lit(share)).select(key)


def key_profile(tokens: DataFrame, mentions: DataFrame, key: str = "doc_id", share: float = 0.03) -> DataFrame:
    """Per identifier: rows, sentences, mentions, distinct tokens, and whether it is heavy.

    ``n_rows`` counts distinct ``tok_idx`` (repeated deliveries count once),
    ``n_mentions`` distinct ``mention_idx`` without the dummy (index 0),
    ``n_distinct_tokens`` distinct token strings.  Rows with a null key are
    left out; a key of only one of the tables gets 0 for the other's counts.
    """
    rows = distinct_int_count(tokens, key, "tok_idx", "n_rows")
    sentences = distinct_int_count(tokens, key, "sent_id", "n_sentences")
    words = distinct_value_count(tokens, key, F.col("token"), "n_distinct_tokens")
    found = distinct_int_count(mentions.filter("mention_idx > 0"), key, "mention_idx", "n_mentions")
    total = rows.agg(F.sum("n_rows").alias("_n")).scalar()
    counts = ["n_rows", "n_sentences", "n_mentions", "n_distinct_tokens"]
    return (
        rows.join(sentences, key, "full").join(words, key, "full").join(found, key, "full")
        .select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
        .withColumn("is_heavy", F.col("n_rows") >= F.coalesce(total, F.lit(0)) * F.lit(share))
    )
