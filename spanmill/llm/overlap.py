"""Problem 5: the same or nearly the same records across splits.

Shingles are hashed once to 64 bits, and a document is the sorted set of its
hashes from then on.  Documents with equal sets form a class, found by a 128-bit
fingerprint of the set.  Classes get a minwise signature; those that share all
rows of a band meet in its bucket, and only a class with a training member and one
with an evaluation member become a candidate.  Candidates are verified by the
Jaccard similarity of their whole sets, and pairs of classes are expanded to pairs
of documents last.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from .common import spread

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def banding(threshold: float, miss: float = 1e-6, rows: int | None = None) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold misses all bands with probability ``miss`` at most.

    As many rows as make a band of a pair at the threshold agree in about one case
    of eight: then pairs far below it (boilerplate) rarely meet.
    """
    r = rows or max(1, min(8, round(math.log(0.125) / math.log(threshold)))) if threshold < 1 else 8
    hit = threshold**r
    return (1 if hit >= 1 else math.ceil(math.log(miss) / math.log(1 - hit))), r


def shingles(tokens: Column, width: int) -> Column:
    """Sorted distinct 64-bit hashes of the sequences of ``width`` neighbouring lower-cased tokens; null without any. A null token counts as ''."""
    low = F.transform(tokens, lambda t: F.coalesce(F.lower(t), F.lit("")))
    hashed = lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    # the lower-cased tokens are made once, as the one element of an array
    runs = F.element_at(F.transform(F.array(low), hashed), 1)
    return F.when(F.size(tokens) >= width, F.sort_array(F.array_distinct(runs)))


def _band_keys(bands: int, rows: int, seed: int):
    """(class_id, bucket) rows: a 64-bit hash of the number and the minima of each band of each class."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            lists = batch.column("hashes")
            for at in range(0, len(lists), 512):
                part = lists.slice(at, 512)
                values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                starts = np.concatenate([[0], np.cumsum(np.diff(part.offsets.to_numpy()))])[:-1].astype(np.int64)
                if not len(starts):
                    continue
                minima = np.empty((len(starts), bands * rows), dtype=np.uint64)
                for k in range(bands * rows):
                    h = values * a[k] + b[k]
                    h ^= h >> np.uint64(32)
                    h *= np.uint64(0x9E3779B97F4A7C15)
                    minima[:, k] = np.minimum.reduceat(h, starts)
                keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(starts), 1))
                for k in range(rows):
                    keys = (keys ^ minima[:, k::rows][:, :bands]) * np.uint64(0xFF51AFD7ED558CCD)
                    keys ^= keys >> np.uint64(29)
                ids = batch.column("class_id").slice(at, 512).take(pa.array(np.repeat(np.arange(len(starts)), bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.view(np.int64).ravel())], names=["class_id", "bucket"])

    return run


def cross_split_pairs(
    docs: DataFrame, key: str = "doc_key", tokens: str = "tokens", split: str = "split", train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("dev", "test"),
    width: int = 5, threshold: float = 0.8, miss: float = 1e-6, seed: int = 7,
) -> DataFrame:
    """(key_a, key_b, jaccard): pairs of a training and an evaluation document with at least the similarity.

    ``key_a`` is the smaller key.  Splits are trimmed and lower-cased.  Documents
    without a split, without tokens or with fewer than ``width`` tokens take no
    part; a document delivered again counts once.  Equal sets have similarity 1.
    """
    assert 0 < threshold <= 1 and width > 0 and 0 < miss < 1
    side = F.lower(F.trim(F.col(split)))
    part = docs.filter(F.col(tokens).isNotNull() & (F.size(tokens) >= width) & side.isin(*train, *held_out) & F.col(key).isNotNull())
    # written before use, so that sets are made once, where the tokens are, and no token leaves its task
    sets = write_table(spread(part.select(F.col(key).alias("key"), side.isin(*train).alias("is_train"), F.col(tokens).alias("tokens")), "key").select("key", "is_train", shingles(F.col("tokens"), width).alias("set")), "sets")
    prints = [F.xxhash64("set").alias("print"), F.xxhash64("set", F.lit(seed)).alias("print2")]
    each = sets.select("key", "is_train", *prints).distinct()
    flags = [F.bool_or("is_train").alias("has_train"), F.bool_or(~F.col("is_train")).alias("has_held_out")]
    named = write_table(each.groupBy("print", "print2").agg(F.min("key").alias("class_id"), *flags), "named")  # a class is called by its smallest key
    sides = named.select("class_id", "has_train", "has_held_out")
    members = each.join(named.select("print", "print2", "class_id"), ["print", "print2"]).select(F.col("key").alias(key), "is_train", "class_id")
    # a class has the set of the document it is called by; one delivered twice gives its rows twice until the pairs are made distinct
    classes = write_table(sets.select(F.col("key").alias("class_id"), "set").join(sides, "class_id"), "classes")

    bands, rows = banding(threshold, miss)
    kind = dict(named.dtypes)["class_id"]
    signed = lambda flag: classes.filter(flag).select("class_id", F.col("set").alias("hashes")).mapInArrow(_band_keys(bands, rows, seed), f"class_id {kind}, bucket long")
    near = (
        signed("has_train").withColumnRenamed("class_id", "class_t")
        .join(signed("has_held_out").withColumnRenamed("class_id", "class_h"), "bucket")
        .filter("class_t <> class_h").select("class_t", "class_h").distinct()
    )
    left = classes.filter("has_train").select(F.col("class_id").alias("class_t"), F.col("set").alias("set_t"))
    right = classes.filter("has_held_out").select(F.col("class_id").alias("class_h"), F.col("set").alias("set_h"))
    both = F.size(F.array_intersect("set_t", "set_h"))
    shared = F.element_at(F.transform(F.array(both), lambda n: n / (F.size("set_t") + F.size("set_h") - n)), 1)
    verified = near.join(right, "class_h").join(left, "class_t").select("class_t", "class_h", shared.alias("jaccard")).filter(F.col("jaccard") >= threshold).distinct()
    same = sides.filter("has_train AND has_held_out").select(F.col("class_id").alias("class_t"), F.col("class_id").alias("class_h"), F.lit(1.0).alias("jaccard"))
    of = lambda c, t: members.filter("is_train" if t else "NOT is_train").select(F.col("class_id").alias(c), F.col(key).alias(f"key_{c[-1]}"))
    pairs = verified.unionByName(same).join(of("class_t", True), "class_t").join(of("class_h", False), "class_h")
    return pairs.select(F.least("key_t", "key_h").alias("key_a"), F.greatest("key_t", "key_h").alias("key_b"), F.col("key_t").alias("train_key"), F.col("key_h").alias("held_out_key"), "jaccard")


def overlap_report(pairs: DataFrame, docs: DataFrame, source: Column, key: str = "doc_key", split: str = "split") -> DataFrame:
    """(split, source, n_documents, n_pairs): held-out documents with a partner in train, per split and source.

    A null source is reported as one row with a null source.
    """
    about = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("held_out_key"), F.lower(F.trim(F.col(split))).alias("split"), source.alias("source")).distinct()
    per_doc = pairs.groupBy("held_out_key").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.join(about, "held_out_key").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_pairs"))
