"""Problem 3: pairwise matches consolidated into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_rows
from .components import connected_components, stars


def mention_links(mentions: DataFrame) -> DataFrame:
    """(src, dst) of the stated links, each set as a star instead of all its pairs.

    A link is an ``antecedent`` that is in the table, is not the mention itself
    and is not a dummy (``mention_idx`` 0), or an equal (``doc_id``, non-null
    ``set_id``).  Nulls link nothing.
    """
    m = distinct_rows(mentions, "mention_id", "doc_id", "set_id", "antecedent", "mention_idx")
    real = m.filter(~F.col("mention_idx").eqNullSafe(0)).select(F.col("mention_id").alias("antecedent"))
    pointed = (
        m.filter("antecedent IS NOT NULL AND antecedent <> mention_id")
        .select("mention_id", "antecedent")
        .join(real, "antecedent", "left_semi")
        .select(F.col("mention_id").alias("src"), F.col("antecedent").alias("dst"))
    )
    sets = m.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").select("mention_id", "doc_id", "set_id")
    return pointed.unionByName(stars(sets, ["doc_id", "set_id"], "mention_id"))


def linked_mentions(mentions: DataFrame, **grid) -> DataFrame:
    """(mention_id, group_id) of each mention in a group of at least two; no links give no rows."""
    found = connected_components(mention_links(mentions), **grid)
    return found.select(F.col("vertex").alias("mention_id"), F.col("component").alias("group_id"))


def mention_groups(mentions: DataFrame, **grid) -> DataFrame:
    """(mention_id, group_id) of every mention; one without links is its own group."""
    every = mentions.select("mention_id").filter("mention_id IS NOT NULL").distinct()
    linked = linked_mentions(mentions, **grid)
    return every.join(linked, "mention_id", "left").select("mention_id", F.coalesce("group_id", "mention_id").alias("group_id"))
