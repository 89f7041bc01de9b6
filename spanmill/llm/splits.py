"""Problem 1: splits that keep related records together.

Related documents form components (see :mod:`.components`).  Components of equal
size and label profile are one bundle.  A min-cost flow sends the documents of the
bundles to the splits: each split has its quota, and a bundle's cost in a split is
the deviation that its whole label profile makes there.  Flows are rounded to whole
components; what is left over goes, largest first, where it deviates least over all
labels, and components move on along the cheapest ways between splits (cancelling
cycles) while that lowers the deviation.  A bundle's components are told apart by
the rank of their hash.

The number of bundles is bounded whatever the table: sizes are exact up to
``EXACT_SIZE`` and in classes of 2 percent beyond, profiles are exact up to
``EXACT_PROFILE`` documents and in eighths beyond, and labels beyond the most
frequent ``LABELS`` count as one.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from .common import bounded_rank, distinct_rows, squeezed
from .components import connected_components, stars

EXACT_SIZE, EXACT_PROFILE, LABELS = 64, 4, 16

#: What stands in the place of an author who isn't known, squeezed.
PLACEHOLDERS = ["", "anon", "anonymous", "na", "nil", "noauthor", "none", "null", "nobody", "tba", "tbd", "unk", "unknown", "unnamed", "xxx"]


def author_key(author: Column) -> Column:
    """The author without case, blanks and punctuation; null for a missing value or a placeholder."""
    a = squeezed(author)
    return F.when(~a.isin(PLACEHOLDERS), a)


def source_key(identifier: Column) -> Column:
    """The document path of an identifier: without part, extension, case, blanks, punctuation and slashes."""
    low = F.lower(identifier)
    path = F.regexp_replace(low, r"[\s;,)_\-]*\bpart[\s_\-]*\d+[\s)\]]*$|[\s;,)_\-]+part[\s_\-]*\d+[\s)\]]*$", "")
    path = F.regexp_replace(path, r"\.[a-z][a-z0-9_]*[\s)\];]*$", "")
    s = F.regexp_replace(path, r"[^\p{L}\p{N}]+", "")
    return F.when(s != "", s)


def related(docs: DataFrame, key: str = "doc_key", author: str = "author", identifier: str = "doc_id", entity: str = "topic_entity", **grid) -> DataFrame:
    """(key, group_key) of every document that is related to another one.

    Documents are related by equal author, source or entity, directly or through
    others; missing values and placeholders connect nothing.
    """
    d = distinct_rows(docs, key, author, identifier, entity)
    values = F.array(
        F.struct(F.lit("a").alias("kind"), author_key(F.col(author)).alias("value")),
        F.struct(F.lit("s").alias("kind"), source_key(F.col(identifier)).alias("value")),
        F.struct(F.lit("e").alias("kind"), F.col(entity).cast("string").alias("value")),
    )
    members = d.select(key, F.explode(values).alias("x")).select(key, "x.kind", "x.value").filter("value IS NOT NULL")
    found = connected_components(stars(members, ["kind", "value"], key), **grid)
    return found.select(F.col("vertex").alias(key), F.col("component").alias("group_key"))


def _min_cost_flow(supply: list[int], sinks: list[int], cost: list[list[int]], over: int) -> list[list[int]]:
    """Cheapest flow of all supplies to the sinks: ``cost`` per unit, plus ``over`` per unit beyond a sink's quota.

    Successive shortest paths.  All paths lead through the few sinks, so the
    residual graph is kept between sinks only: the cheapest supply to move from
    one sink to another stands on a heap.
    """
    k = len(sinks)
    flow = [[0] * k for _ in supply]
    used = [0] * k
    moves = [[[] for _ in range(k)] for _ in range(k)]

    def cheapest(i: int, j: int):
        heap = moves[i][j]
        while heap and flow[heap[0][1]][i] == 0:
            heapq.heappop(heap)
        return heap[0] if heap else None

    for s in sorted(range(len(supply)), key=lambda s: -supply[s]):
        left = supply[s]
        while left:
            # shortest way from the supply to a sink's free quota or to its overflow, over moves between sinks
            dist, via = list(cost[s]), [(-1, -1)] * k
            for _ in range(k - 1):
                for i in range(k):
                    for j in range(k):
                        m = cheapest(i, j) if i != j else None
                        if m and dist[i] + m[0] < dist[j]:
                            dist[j], via[j] = dist[i] + m[0], (i, m[1])
            free = [sinks[j] - used[j] for j in range(k)]
            end = min(range(k), key=lambda j: (dist[j] + (0 if free[j] > 0 else over), -free[j]))
            amount, j = left, end
            if free[end] > 0:
                amount = min(amount, free[end])
            while via[j][0] >= 0:
                amount, j = min(amount, flow[via[j][1]][via[j][0]]), via[j][0]
            j = end
            used[end] += amount
            while via[j][0] >= 0:
                i, t = via[j]
                flow[t][i] -= amount
                flow[t][j] += amount
                for x in range(k):
                    if x != j:
                        heapq.heappush(moves[j][x], (cost[t][x] - cost[t][j], t))
                j = i
            flow[s][j] += amount
            for x in range(k):
                if x != j:
                    heapq.heappush(moves[j][x], (cost[s][x] - cost[s][j], s))
            left -= amount
    return flow


def allocate(bundles: list[tuple[float, dict[str, float], int]], shares: list[float]) -> list[list[int]]:
    """Components of each bundle (size, documents per label, number) per split, as whole numbers.

    The deviation is the sum over labels and splits of the squared difference from
    the share, in units of the share; all documents together are one more label.
    """
    if not bundles:
        return []
    k, share = len(shares), np.array(shares)
    names = {n: i + 1 for i, n in enumerate(sorted({n for _, p, _ in bundles for n in p}))}
    profile = np.zeros((len(bundles), len(names) + 1))
    for b, (size, labels, _) in enumerate(bundles):
        profile[b, 0] = size
        for n, docs in labels.items():
            profile[b, names[n]] = docs
    number = np.array([n for *_, n in bundles])
    target = np.maximum(np.outer(profile.T @ number, share), 1e-9)  # label x split
    weight = 1 / np.maximum(target, 1)
    whole = np.floor(np.outer(number, share)).astype(np.int64)  # shares of a bundle that are whole components deviate nowhere
    filled = profile.T @ whole
    left = number - whole.sum(axis=1)

    def added() -> np.ndarray:
        """Bundle x split: what one more component changes in the deviation."""
        return profile @ (2 * (filled - target) * weight) + profile**2 @ weight

    # the rest as a flow of documents into what the quotas still take
    supply = [max(1, round(bundles[b][0] * left[b])) if left[b] else 0 for b in range(len(bundles))]
    room = np.maximum(0, target[0] - filled[0])
    sinks = [int(x) for x in room]
    sinks[0] += max(0, sum(supply) - sum(sinks))
    per_document = added() / profile[:, :1]
    low = per_document.min()
    scale = 1000 / max(per_document.max() - low, 1e-9)
    cost = [[int((c - low) * scale) for c in row] for row in per_document]
    flow = np.array(_min_cost_flow(supply, sinks, cost, 2000))
    rounded = np.minimum(np.floor(flow / profile[:, :1] + 1e-9).astype(np.int64), left[:, None])
    whole += rounded
    filled = profile.T @ whole
    left = number - whole.sum(axis=1)
    for b in np.lexsort((np.arange(len(bundles)), -profile[:, 0])):
        for _ in range(left[b]):
            j = int(np.argmin(2 * profile[b] @ ((filled - target) * weight) + profile[b] ** 2 @ weight))
            whole[b, j] += 1
            filled[:, j] += profile[b]
    for _ in range(20 * len(bundles)):
        gain = profile @ (2 * (filled - target) * weight) - profile**2 @ weight  # what a component less saves
        change = added()[:, None, :] - np.where(whole > 0, gain, -np.inf)[:, :, None]  # bundle x from x to
        change[:, np.arange(k), np.arange(k)] = 0
        b, i, j = np.unravel_index(np.argmin(change), change.shape)
        if change[b, i, j] > -1e-9:
            break
        whole[b, i] -= 1
        whole[b, j] += 1
        filled[:, i] -= profile[b]
        filled[:, j] += profile[b]
    return whole.tolist()


def _bundled(grouped: DataFrame) -> DataFrame:
    """(group_key, size, bundle, bundle_size, labels) of each group; see the module for what a bundle leaves out."""
    frequent = grouped.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).select("label", F.col("label").alias("kept"))
    profile = grouped.join(frequent, "label", "left").groupBy("group_key", F.when(F.col("label").isNull(), "").otherwise(F.coalesce(F.concat(F.lit("="), "kept"), F.lit("+"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    groups = profile.groupBy("group_key").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("name", "n"))).alias("counts"))  # LABELS + 2 entries at most
    step = F.floor(F.log(F.col("size") / F.lit(float(EXACT_SIZE))) / F.log(F.lit(1.02)))
    size = F.when(F.col("size") <= EXACT_SIZE, F.col("size").cast("double")).otherwise(F.round(F.lit(float(EXACT_SIZE)) * F.pow(F.lit(1.02), step + 0.5)))
    eighths = F.filter(F.transform("counts", lambda c: F.struct(c["name"].alias("name"), F.round(c["n"] * 8 / F.col("size")).cast("long").alias("n"))), lambda c: c["n"] > 0)
    shape = F.when(F.col("size") <= EXACT_PROFILE, F.col("counts")).otherwise(eighths)
    named = groups.select("group_key", "size", size.alias("bundle_size"), shape.alias("labels"))
    return named.withColumn("bundle", F.concat_ws("|", F.col("bundle_size").cast("string"), F.to_json("labels")))


def split_related(
    docs: DataFrame, key: str = "doc_key", label: str = "genre", names: tuple[str, ...] = ("train", "validation", "test"), shares: tuple[float, ...] = (0.8, 0.1, 0.1), **grid,
) -> DataFrame:
    """(key, group_key, group_size, split) of every document; no related documents are in two splits.

    A document without relations is its own group.  Shares hold over all documents
    and within each label (documents without one count as a label of their own) as
    closely as whole groups allow.  A document delivered with several labels counts
    under the smallest.  An empty table gives no rows.
    """
    assert len(names) == len(shares) and abs(sum(shares) - 1) < 1e-9
    every = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    grouped = write_table(every.join(related(docs, key, **grid), key, "left").select(key, "label", F.coalesce("group_key", key).alias("group_key")), "grouped")
    groups = write_table(_bundled(grouped), "groups")
    rows = groups.groupBy("bundle").agg(F.first("bundle_size").alias("size"), F.first("labels").alias("labels"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("size"), "bundle").toLocalIterator()
    bundles = [(r["bundle"], r["size"], {c["name"]: float(c["n"]) for c in r["labels"]}, r["n"]) for r in rows]
    # a profile in eighths is scaled to the size
    scaled = [(size, {n: x * size / sum(p.values()) for n, x in p.items()} if p else {}, number) for _, size, p, number in bundles]
    cuts = []
    for (bundle, *_), counts in zip(bundles, allocate(scaled, list(shares))):
        at = 0
        for name, n in zip(names, counts):
            if n:
                cuts.append((bundle, at, at + n, name))
                at += n
    plan = docs.sparkSession.createDataFrame(cuts, "bundle string, lo long, hi long, split string")
    ranked = bounded_rank(groups.select("group_key", "size", "bundle"), ["bundle"], ["group_key"])
    placed = ranked.join(plan, "bundle").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("group_key", F.col("size").alias("group_size"), "split")
    return grouped.select(key, "group_key").join(placed, "group_key").select(key, "group_key", "group_size", "split")
