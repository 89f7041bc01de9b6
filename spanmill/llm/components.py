"""Connected components on a two-dimensional grid of edge blocks.

Vertices are hashed into ``B`` blocks and edges into the cells (block, block)
of the upper triangle.  A round runs a union-find on every cell on its own,
then exchanges representatives: a vertex has been seen by the cells of its row
and column, takes the smallest of their roots as its parent, and the other roots
become edges (root, parent) of the next, smaller round.  The rounds end when no
vertex has two roots, that is, when parents are stable.  A hub's edges spread
over the ``B`` cells of its row and column, so no group and no component is ever
held by one task; a vertex collects at most ``2 B - 1`` roots.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_table, write_table

#: Edges that one cell may hold on average; blocks of the grid at least.
CELL_EDGES = 400_000
MIN_BLOCKS = 4


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges with the smallest vertex of their local component."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))
    n = len(u)
    for a, b in zip(codes[:n].tolist(), codes[n:].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i, p in enumerate(parent):  # parents have smaller codes, so one pass flattens
        parent[i] = parent[p]
    return names, names[np.asarray(parent, dtype=np.int64)] if len(parent) else names


def _union_cell(batches):
    """Local union-find of one cell (a partition holds one cell)."""
    us, vs = [], []
    for b in batches:
        us.append(b.column("src").to_numpy(zero_copy_only=False))
        vs.append(b.column("dst").to_numpy(zero_copy_only=False))
    if us:
        names, roots = _roots(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(roots)], names=["vertex", "root"])


def connected_components(edges: DataFrame, cell_edges: int = CELL_EDGES, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is its smallest vertex.

    ``edges`` has ``src`` and ``dst`` (BIGINT).  Edges with a null end or equal
    ends link nothing and name no vertex; direction, order and repetition make no
    difference; no edges give no rows.
    """
    assert cell_edges > 0 and min_blocks > 0
    links = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    forests = []
    current = write_table(links, "edges")
    while True:
        n = current.count()
        if n == 0:
            drop_table(current)
            break
        # later, smaller rounds have the blocks that their edges need; a grid of one cell leaves no vertex with two roots
        blocks = max(1 if forests else min_blocks, math.ceil(math.sqrt(2 * n / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(len(forests))), F.lit(blocks)).cast("int")  # noqa: B023, E731  # another grid in each round
        lo, hi = F.least(block("src"), block("dst")), F.greatest(block("src"), block("dst"))
        cells = blocks * (blocks + 1) // 2
        stars = (
            current.select("src", "dst", (lo + (hi * (hi + 1) / 2).cast("int")).alias("cell"))
            .repartitionById(cells, "cell")
            .select("src", "dst")
            .mapInArrow(_union_cell, "vertex long, root long")
        )
        met = stars.groupBy("vertex").agg(F.collect_set("root").alias("roots"))
        forest = write_table(met.select("vertex", F.array_min("roots").alias("parent"), "roots"), "forest")
        drop_table(current)
        forests.append(forest)
        rest = forest.filter(F.size("roots") > 1).select(F.explode(F.array_except("roots", F.array("parent"))).alias("src"), F.col("parent").alias("dst"))
        current = write_table(rest.distinct(), "edges")
    if not forests:
        return edges.sparkSession.createDataFrame([], "vertex long, component long")
    label = forests[-1].select("vertex", F.col("parent").alias("component"))
    for forest in reversed(forests[:-1]):
        up = label.select(F.col("vertex").alias("parent"), "component")
        label = forest.select("vertex", "parent").join(up, "parent", "left").select("vertex", F.coalesce("component", "parent").alias("component"))
    return label


def stars(members: DataFrame, keys: list[str], vertex: str) -> DataFrame:
    """Edges (src, dst) that link each ``vertex`` to the smallest one of the same ``keys``.

    A group of n members gives n - 1 edges.  The minimum is map-side combined;
    the join back has one row per key on its other side, so a hot key is only
    a long probe side, which adaptive execution splits.
    """
    least = members.groupBy(*keys).agg(F.min(vertex).alias("dst"))
    return members.join(least, keys).select(F.col(vertex).alias("src"), "dst").filter("src <> dst")
