"""Evaluation of entities: MUC, B3, CEAF, BLANC and their average.

``key`` and ``response`` have (doc, mention, entity).  Everything but the CEAF
alignment is closed-form sums over the table of overlaps (how many mentions an
entity of one side shares with one of the other), so no pair of mentions is
built.  Scores are recall and precision numerators and denominators per
document, summed before they are divided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("muc", "bcub", "ceafm", "ceafe", "blanc")


def aligned(key: DataFrame, response: DataFrame, doc: str = "doc_id", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both sides with each mention once per document.

    A mention that a response repeats counts in its first entity (smallest);
    more than ``most`` repetitions of a document raise an error when rows are read.
    """
    once = lambda df: df.filter(F.col("mention").isNotNull() & F.col("entity").isNotNull()).groupBy(doc, "mention").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("_n"))
    r = once(response)
    repeated = r.groupBy(doc).agg(F.sum(F.col("_n") - 1).alias("_extra"))
    guarded = r.join(repeated, doc).filter(F.when(F.col("_extra") > most, F.raise_error(F.concat(F.lit("too many repeated mentions in "), F.col(doc).cast("string")))).otherwise(F.lit(True)))
    return once(key).drop("_n"), guarded.drop("_n", "_extra")


def _sizes(df: DataFrame, doc: str, name: str) -> DataFrame:
    return df.groupBy(doc, "entity").agg(F.count(F.lit(1)).alias(f"n_{name}")).withColumnRenamed("entity", name)


def overlaps(key: DataFrame, response: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, k, r, n, n_k, n_r): mentions that entity k of the key shares with entity r of the response."""
    both = key.select(doc, "mention", F.col("entity").alias("k")).join(response.select(doc, "mention", F.col("entity").alias("r")), [doc, "mention"])
    n = both.groupBy(doc, "k", "r").agg(F.count(F.lit(1)).alias("n"))
    return n.join(_sizes(key, doc, "k"), [doc, "k"]).join(_sizes(response, doc, "r"), [doc, "r"])


def mention_counts(key: DataFrame, response: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mention identification: (doc, rn, rd, pn, pd)."""
    k, r = key.select(doc, "mention", F.lit(1).alias("_k")), response.select(doc, "mention", F.lit(1).alias("_r"))
    j = k.join(r, [doc, "mention"], "full").groupBy(doc).agg(F.count("_k").alias("_k"), F.count("_r").alias("_r"), F.count(F.when(F.col("_k").isNotNull() & F.col("_r").isNotNull(), 1)).alias("_b"))
    d = lambda c: F.col(c).cast("double")
    return j.select(doc, d("_b").alias("rn"), d("_k").alias("rd"), d("_b").alias("pn"), d("_r").alias("pd"))


def _totals(key: DataFrame, response: DataFrame, doc: str, k: dict[str, Column], r: dict[str, Column]) -> DataFrame:
    """Per-document sums over the entities of either side, 0 where a side is missing."""
    a = _sizes(key, doc, "e").withColumnRenamed("n_e", "n").groupBy(doc).agg(*[c.alias(n) for n, c in k.items()])
    b = _sizes(response, doc, "e").withColumnRenamed("n_e", "n").groupBy(doc).agg(*[c.alias(n) for n, c in r.items()])
    j = a.join(b, doc, "full")
    return j.select(doc, *[F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in (*k, *r)])


def muc(key: DataFrame, response: DataFrame, doc: str = "doc_id") -> DataFrame:
    n = overlaps(key, response, doc).groupBy(doc).agg(F.sum(F.col("n") - 1).cast("double").alias("x"))
    t = _totals(key, response, doc, {"rd": F.sum(F.col("n") - 1)}, {"pd": F.sum(F.col("n") - 1)}).join(n, doc, "left")
    x = F.coalesce("x", F.lit(0.0))
    return t.select(doc, x.alias("rn"), "rd", x.alias("pn"), "pd")


def bcub(key: DataFrame, response: DataFrame, doc: str = "doc_id") -> DataFrame:
    sq = F.col("n") * F.col("n")
    n = overlaps(key, response, doc).groupBy(doc).agg(F.sum(sq / F.col("n_k")).alias("x"), F.sum(sq / F.col("n_r")).alias("y"))
    t = _totals(key, response, doc, {"rd": F.sum("n")}, {"pd": F.sum("n")}).join(n, doc, "left")
    return t.select(doc, F.coalesce("x", F.lit(0.0)).alias("rn"), "rd", F.coalesce("y", F.lit(0.0)).alias("pn"), "pd")


def blanc_counts(key: DataFrame, response: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, cl_both, cl_key, cl_res, nl_both, nl_key, nl_res): coreference and other links in common and of either side."""
    two = lambda c: c * (c - 1) / 2
    n = overlaps(key, response, doc)
    shared = n.groupBy(doc).agg(F.sum("n").alias("m"), F.sum(two(F.col("n"))).alias("cl_both"))
    by = lambda e: n.groupBy(doc, e).agg(F.sum("n").alias("s")).groupBy(doc).agg(F.sum(two(F.col("s"))).alias(f"_{e}"))
    shared = shared.join(by("k"), doc).join(by("r"), doc)
    t = _totals(key, response, doc, {"mk": F.sum("n"), "cl_key": F.sum(two(F.col("n")))}, {"mr": F.sum("n"), "cl_res": F.sum(two(F.col("n")))}).join(shared, doc, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    other = two(z("m")) - z("_k") - z("_r") + z("cl_both")
    return t.select(doc, z("cl_both").alias("cl_both"), "cl_key", "cl_res", other.alias("nl_both"), (two(F.col("mk")) - F.col("cl_key")).alias("nl_key"), (two(F.col("mr")) - F.col("cl_res")).alias("nl_res"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of largest total weight (shortest augmenting paths with potentials)."""
    w = np.asarray(weights, dtype=float)
    if w.size == 0:
        return []
    flip = w.shape[0] > w.shape[1]
    c = -(w.T if flip else w)
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        i, j = row, -1
        while True:
            if j >= 0:
                done[j] = True
            gap = c[i] - u[i] - v
            better = ~done & (gap < least)
            least[better] = gap[better]
            came[better] = j
            at = int(np.argmin(np.where(done, np.inf, least)))
            d = least[at]
            u[row] += d
            used = np.flatnonzero(done)
            u[owner[used]] += d
            v[used] -= d
            least[~done] -= d
            j = at
            i = owner[j]
            if i < 0:
                break
        while j >= 0:
            before = came[j]
            owner[j] = owner[before] if before >= 0 else row
            j = before
    return [(j, int(i)) if flip else (int(i), j) for j, i in enumerate(owner) if i >= 0]


def _best_total(k: np.ndarray, r: np.ndarray, phi: np.ndarray) -> float:
    """Total of the best alignment; entities that overlap, directly or through others, are aligned group by group."""
    nk = int(k.max()) + 1
    parent = list(range(nk + int(r.max()) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in zip(k.tolist(), (r + nk).tolist()):
        parent[root(a)] = root(b)
    group = np.array([root(a) for a in k.tolist()])
    order = np.argsort(group, kind="stable")
    total = 0.0
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(rows) == 1:
            total += float(phi[rows[0]])
            continue
        ks, ki = np.unique(k[rows], return_inverse=True)
        rs, ri = np.unique(r[rows], return_inverse=True)
        w = np.zeros((len(ks), len(rs)))
        w[ki, ri] = phi[rows]
        total += float(sum(w[a, b] for a, b in assignment(w)))
    return total


def _aligner(doc: str, entity_based: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        phi = 2 * group["n"] / (group["n_k"] + group["n_r"]) if entity_based else group["n"].astype(float)
        x = _best_total(pd.factorize(group["k"])[0], pd.factorize(group["r"])[0], phi.to_numpy())
        return pd.DataFrame({doc: [group[doc].iloc[0]], "x": [x]})

    return run


def ceaf(key: DataFrame, response: DataFrame, doc: str = "doc_id", entity_based: bool = True) -> DataFrame:
    """Best one-to-one alignment of the entities of a document.

    Entities that share no mention never align, so only the overlaps reach
    Python, and each group of overlapping entities is aligned on its own.
    """
    n = overlaps(key, response, doc)
    kind = dict(n.dtypes)[doc]
    x = n.groupBy(doc).applyInPandas(_aligner(doc, entity_based), f"`{doc}` {kind}, x double")
    total = F.count(F.lit(1)) if entity_based else F.sum("n")
    t = _totals(key, response, doc, {"rd": total}, {"pd": total}).join(x, doc, "left")
    x = F.coalesce("x", F.lit(0.0))
    return t.select(doc, x.alias("rn"), "rd", x.alias("pn"), "pd")


def f1(recall: Column, precision: Column) -> Column:
    return F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(sums: DataFrame) -> DataFrame:
    """Adds recall, precision and f1 to rows with rn, rd, pn, pd; 0 where undefined."""
    r, p = _ratio(F.col("rn"), F.col("rd")), _ratio(F.col("pn"), F.col("pd"))
    return sums.withColumns({"recall": r, "precision": p, "f1": f1(r, p)})


def blanc_rates(c: DataFrame) -> DataFrame:
    """Adds recall, precision and f1 to rows of :func:`blanc_counts`: the mean of both kinds of links.

    A key with one kind of links only is judged by that kind; without any links
    of either side there are identical single mentions or nothing, and counts decide.
    """
    part = lambda b, k, r: (_ratio(F.col(b), F.col(k)), _ratio(F.col(b), F.col(r)))
    cr, cp = part("cl_both", "cl_key", "cl_res")
    nr, np_ = part("nl_both", "nl_key", "nl_res")
    cf, nf = f1(cr, cp), f1(nr, np_)
    pick = lambda a, b: F.when((F.col("cl_key") == 0) & (F.col("nl_key") == 0), 0.0).when(F.col("nl_key") == 0, a).when(F.col("cl_key") == 0, b).otherwise((a + b) / 2)
    return c.withColumns({"recall": pick(cr, nr), "precision": pick(cp, np_), "f1": pick(cf, nf)})


def _counts(metric: str, key: DataFrame, response: DataFrame, doc: str) -> DataFrame:
    make = {"mentions": mention_counts, "muc": muc, "bcub": bcub, "ceafm": lambda k, r, d: ceaf(k, r, d, False), "ceafe": ceaf, "blanc": blanc_counts}[metric]
    return make(key, response, doc)


def score(key: DataFrame, response: DataFrame, metric: str = "all", doc: str = "doc_id", per_doc: bool = False) -> DataFrame:
    """(metric, doc, recall, precision, f1); the total has a null ``doc``.

    ``metric`` is one of ``METRICS``, 'mentions' or 'all'.  Documents of one
    side only count for that side.
    """
    k, r = aligned(key, response, doc)
    out: DataFrame | None = None
    for m in METRICS if metric == "all" else (metric,):
        counts = _counts(m, k, r, doc)
        columns = [c for c in counts.columns if c != doc]
        if per_doc:
            sums = counts.groupingSets([[F.col(doc)], []], F.col(doc)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
        else:
            sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]).withColumn(doc, F.lit(None).cast(dict(counts.dtypes)[doc]))
        rows = (blanc_rates if m == "blanc" else rates)(sums).select(F.lit(m).alias("metric"), doc, "recall", "precision", "f1")
        out = rows if out is None else out.unionByName(rows)
    return out


def conll_average(scores: DataFrame) -> DataFrame:
    """(doc, conll): mean f1 of MUC, B3 and CEAF-e."""
    doc = [c for c in scores.columns if c not in ("metric", "recall", "precision", "f1")]
    return scores.filter(F.col("metric").isin("muc", "bcub", "ceafe")).groupBy(*doc).agg((F.sum("f1") / 3).alias("conll"))


def shown(c: Column) -> Column:
    """Percent with two decimals, cut off."""
    return F.floor(c * 10000) / 100


def report(scores: DataFrame) -> DataFrame:
    """(metric, R, P, F1) lines of the total, with the average last, as percent."""
    total = scores.filter(F.col([c for c in scores.columns if c not in ("metric", "recall", "precision", "f1")][0]).isNull())
    lines = total.select("metric", shown(F.col("recall")).alias("R"), shown(F.col("precision")).alias("P"), shown(F.col("f1")).alias("F1"))
    mean = conll_average(total).select(F.lit("conll").alias("metric"), F.lit(None).cast("double").alias("R"), F.lit(None).cast("double").alias("P"), shown(F.col("conll")).alias("F1"))
    return lines.unionByName(mean)
