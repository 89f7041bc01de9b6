"""Lookup lists, antecedent files and tables; every list may be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..functions.spans import parse


def gender_lists(spark: SparkSession, **paths: str) -> DataFrame:
    """(word, gender) of one file per gender, a word per line: ``gender_lists(spark, male='...', female='...')``."""
    out = spark.createDataFrame([], "word string, gender string")
    for gender, path in paths.items():
        out = out.unionByName(spark.read.text(path).select(F.trim("value").alias("word"), F.lit(gender.upper()).alias("gender")).filter("word <> ''"))
    return out


def coreferent_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(lo, hi): distinct unordered pairs; pairs with a null are left out."""
    return pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()


def with_listed_pairs(pairs: DataFrame, listed: DataFrame, field: str = "head_text") -> DataFrame:
    """Adds ``is_listed_pair`` to pair rows; ``listed`` is from :func:`coreferent_pairs`. Planned as a broadcast where the list is small."""
    lo, hi = F.least(f"ana.{field}", f"ante.{field}"), F.greatest(f"ana.{field}", f"ante.{field}")
    hit = listed.withColumn("_hit", F.lit(True))
    return pairs.drop("is_listed_pair").withColumns({"lo": lo, "hi": hi}).join(hit, ["lo", "hi"], "left").withColumn("is_listed_pair", F.coalesce("_hit", F.lit(False))).drop("lo", "hi", "_hit")


def with_singleton_counts(mentions: DataFrame, counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Adds ``singleton_count`` from a (text, n) table by the mention's own string; null where it isn't listed."""
    c = counts.groupBy("text").agg(F.max("n").cast("int").alias("singleton_count")).withColumnRenamed("text", "_text")
    return mentions.withColumn("_text", F.array_join(tokens, " ")).join(c, "_text", "left").drop("_text")


def feature_list(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(mention features, pair features) of a feature file."""
    return features.feature_names(r["value"] for r in spark.read.text(path).collect())  # a handful of lines


def read_antecedents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ana, ante) spans of a file 'identifier TAB (b, e) TAB (b, e)'; other lines are left out."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") == 3)
    return raw.select(F.trim(F.col("c")[0]).alias("doc_id"), parse(F.col("c")[1]).alias("ana"), parse(F.col("c")[2]).alias("ante")).filter("ana IS NOT NULL AND ante IS NOT NULL")


def mentions_of_antecedents(annotated: DataFrame, pairs: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, span, set_id, antecedent): annotated mentions with antecedents written onto them.

    Pairs are applied in their order: an anaphor takes its antecedent's entity,
    so a chain has the entity of its first mention.  Spans that aren't annotated
    become mentions; a chain that starts at one gets a new id, counted from the
    document's largest id on (``keep_ids``), or from 0 as some files were made,
    where it may meet an id in use.
    """
    from ..operators.cluster import forest_roots

    one = pairs.groupBy("doc_id", "ana").agg(F.max("ante").alias("ante"))
    every = one.select("doc_id", F.col("ana").alias("span")).unionByName(one.select("doc_id", F.col("ante").alias("span"))).unionByName(annotated.select("doc_id", "span")).distinct()
    known = annotated.groupBy("doc_id", "span").agg(F.first("set_id").alias("_id"))
    roots = forest_roots(one.select("doc_id", F.col("ana").alias("child"), F.col("ante").alias("parent"))).select("doc_id", F.col("mention_idx").alias("span"), F.col("entity_id").alias("root"))
    m = every.join(roots, ["doc_id", "span"], "left").join(known, ["doc_id", "span"], "left").withColumn("root", F.coalesce("root", "span"))
    root_id = known.select("doc_id", F.col("span").alias("root"), F.col("_id").alias("_root_id"))
    top = known.groupBy("doc_id").agg(F.max("_id").alias("_top"))
    m = m.join(root_id, ["doc_id", "root"], "left").join(top, "doc_id", "left")
    fresh = m.filter("_root_id IS NULL").select("doc_id", "root").distinct()
    from ..operators.context import place_in_document

    fresh = place_in_document(fresh, "doc_id", F.col("root.begin"), [F.col("root")], "_new")
    base = F.coalesce(F.col("_top") + 1, F.lit(0)) if keep_ids else F.lit(0)
    out = m.join(fresh, ["doc_id", "root"], "left").join(one.withColumnRenamed("ana", "span"), ["doc_id", "span"], "left")
    return out.select("doc_id", "span", F.coalesce(F.col("_root_id"), base + F.col("_new") - 1).cast("int").alias("set_id"), F.col("ante").alias("antecedent"))
