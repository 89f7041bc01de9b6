"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null ``key`` with the given columns.

    A repeated delivery is equal in the given columns, so a keys-only hash
    aggregate (map-side combined) is enough.
    """
    return df.select(key, *columns).filter(F.col(key).isNotNull()).distinct()


def bounded_rank(df: DataFrame, groups: list[str], order: list[str], out: str = "rank", buckets: int = 512) -> DataFrame:
    """0-based rank of each row within ``groups``, exact, without one task per group.

    Rows are ranked in hash buckets of a group; a bucket's offset is the running
    sum of the counts of the buckets before it (``buckets`` rows per group at
    most).  ``order`` has to be unique within a group.
    """
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    ranked = b.withColumn("_rn", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*groups, "_bucket"]).withColumn(out, F.col("_offset") + F.col("_rn")).drop("_bucket", "_rn", "_offset")


def squeezed(c: Column) -> Column:
    """Lower case, only letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over at least as many partitions as there are cores, for work that costs far more than reading.

    A table of many files keeps its partitions and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(2 * cores, key)
