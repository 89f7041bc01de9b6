"""Problem 8: texts packed into containers of fixed capacity.

Bulk-synchronous best fit.  A round range-sorts the documents and the gaps of
containers by size, and deals both in this order to slabs, so that each slab has
the same mixture of sizes.  A slab is swept by one task: documents from the
largest down, each into its successor among the gaps (the tightest that holds
it); where several want one gap the larger rank has it, and what is left of the
gap goes back into the order.  A slab opens no more containers than its documents
fill.  Documents without a place and all updated gaps go into the next round,
which has as many fewer slabs as there is less to place; the last one has one slab
and opens what is still needed.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import write_table

CAPACITY = 1_024
#: Containers that a slab's documents fill, at most and at least, and the documents of a slab where that leaves a choice.
SLAB_CONTAINERS, LEAST_CONTAINERS, SLAB_DOCUMENTS = 256, 8, 100_000


def sweep(sizes, gaps, capacity: int, most: int | None, name):
    """Best fit of sizes in their order: (container per size or None, [(gap, container)] left, number opened).

    ``gaps`` are (gap, container); at most ``most`` containers are opened, called ``name(0)``, ``name(1)`` ...
    """
    free, opened, out = sorted(gaps), 0, []
    for size in sizes:
        at = bisect_left(free, (size,))
        if at < len(free):
            gap, box = free.pop(at)
        elif most is None or opened < most:
            gap, box = capacity, name(opened)
            opened += 1
        else:
            out.append(None)
            continue
        out.append(box)
        if gap > size:
            insort(free, (gap - size, box))
    return out, free, opened


def _sweep_slabs(capacity: int, at_round: int, last: bool):
    """Rows of whole slabs, gaps first and documents from the largest down -> documents with their container (null: none yet) and gaps."""

    def run(batches):
        schema, slab, gaps, rows = None, None, [], []

        def flush():
            volume = sum(r[2] for r in rows)
            # no more new containers than the documents fill beside the gaps that are there
            most = None if last else volume // capacity
            boxes, left, _ = sweep([r[2] for r in rows], gaps, capacity, most, lambda i: (at_round << 56) + (slab << 24) + i)
            out = [(slab, k, p, n, b) for (k, p, n), b in zip(rows, boxes)] + [(slab, None, None, g, b) for g, b in left]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

        for b in batches:
            schema = b.schema
            for s, k, p, n, box in zip(*(c.to_pylist() for c in b.columns)):
                if s != slab:
                    if slab is not None:
                        yield flush()
                    slab, gaps, rows = s, [], []
                if box is None:
                    rows.append((k, p, n))
                else:
                    gaps.append((n, box))
        if slab is not None:
            yield flush()

    return run


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, first, n_tokens, container): where each piece of each document goes.

    A document within the capacity is one piece.  A longer one is cut into
    consecutive pieces of the capacity and a rest (``first`` is the offset of a
    piece's first token).  An empty document (size 0 or null) takes no room: piece
    0 with ``container`` null.  ``key`` is unique and not null.  Containers are
    named by whole numbers that are not consecutive.
    """
    assert capacity > 0
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = sizes.select(F.col(key).alias("key"), n.alias("_n")).select("key", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = write_table(pieces.select("key", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).alias("size")), "pieces")
    row = "key {}, piece int, size long, box long".format(dict(pieces.dtypes)["key"])
    parts = pieces.sparkSession.sparkContext.defaultParallelism
    # a full piece is a container of its own
    waiting, gaps, placed, at_round = pieces.filter((F.col("size") > 0) & (F.col("size") < capacity)).withColumn("box", F.lit(None).cast("long")), None, [], 1
    while True:
        t = waiting.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("v")).first()
        if not t["n"]:
            break
        per_slab = min(SLAB_CONTAINERS, max(LEAST_CONTAINERS, SLAB_DOCUMENTS * t["v"] // t["n"] // capacity))
        slabs = math.ceil(t["v"] / (per_slab * capacity))
        rows = (waiting if gaps is None else waiting.unionByName(gaps)).select("key", "piece", "size", "box")
        in_order = rows.repartitionByRange(4 * parts, F.col("box").isNull(), F.desc("size"), F.xxhash64("key", "piece", "box")).sortWithinPartitions(F.col("box").isNull(), F.desc("size"), F.xxhash64("key", "piece", "box"))
        dealt = in_order.select(F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 31, F.lit(slabs)).alias("slab"), "key", "piece", "size", "box")
        sorted_slabs = dealt.repartition(min(slabs, 4 * parts), "slab").sortWithinPartitions("slab", F.col("box").isNull(), F.desc("size"))
        swept = write_table(sorted_slabs.mapInArrow(_sweep_slabs(capacity, at_round, slabs == 1), f"slab long, {row}"), "swept")
        placed.append(swept.filter("piece IS NOT NULL AND box IS NOT NULL").select("key", "piece", "size", "box"))
        if slabs == 1:
            break
        waiting, gaps, at_round = swept.filter("piece IS NOT NULL AND box IS NULL"), swept.filter("piece IS NULL"), at_round + 1
    full = pieces.filter(F.col("size") == capacity).select("key", "piece", "size", F.monotonically_increasing_id().alias("box"))
    none = pieces.filter("size = 0").select("key", "piece", "size", F.lit(None).cast("long").alias("box"))
    for part in placed:
        none = none.unionByName(part)
    out = none.unionByName(full)
    return out.select(F.col("key").alias(key), "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("first"), F.col("size").cast("int").alias("n_tokens"), F.col("box").alias("container"))
