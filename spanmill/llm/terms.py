"""Problem 6: frequency of every distinct term, counted in burst tries.

Rows are first combined on the JVM to (field, term, document) with their number
of mentions, so that a document counts once for a term.  Every task then counts
its rows in a burst trie: access nodes lead through a term's first characters to a
container of suffixes, and a container that grows past a limit bursts into a node
with smaller containers.  A trie that is full leaves the task as compact subtrees
(one row per container: prefix, sorted suffixes, counters).  Matching subtrees
meet by an adaptive prefix: the routes are the ranges between sampled terms, which
are as long as it takes to give each route its share, however many terms begin
alike.  A route's subtrees are merged in the order of their terms as a stream, so
that a task holds one batch and one open term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from .common import distinct_rows

#: Suffixes in a container before it bursts; entries of a trie before its containers leave the task.
BURST, FLUSH = 2_048, 400_000


class BurstTrie:
    """Counters by term: nodes are dicts by character, containers are dicts by suffix."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.size = burst, 0
        self.root: dict = {"": _Container()}

    def add(self, term: str, n: int, docs: int) -> None:
        node, at = self.root, 0
        while True:
            key = term[at] if at < len(term) and term[at] in node else ""
            below = node.get(key)
            at += len(key)
            if type(below) is dict:
                node = below
                continue
            break
        suffix = term[at:]
        entry = below.get(suffix)
        if entry is not None:
            entry[0] += n
            entry[1] += docs
            return
        below[suffix] = [n, docs]
        self.size += 1
        if len(below) > self.burst:
            self._split(node, key, below)

    def _split(self, node: dict, key: str, full: _Container) -> None:
        """A full container becomes a node: a container per first character, and one for the empty suffix."""
        parts: dict[str, _Container] = {}
        for suffix, entry in full.items():
            parts.setdefault(suffix[:1], _Container())[suffix[1:]] = entry
        if key:
            node[key] = {**{c: p for c, p in parts.items() if c}, "": parts.get("", _Container())}
            return
        # the container of a node's remaining suffixes: its characters join the node
        rest = parts.pop("", _Container())
        for c, p in parts.items():
            node[c] = p
        node[""] = rest

    def containers(self):
        """(prefix, container) in the order of prefixes."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for c in sorted(node, reverse=True):
                below = node[c]
                if type(below) is dict:
                    stack.append((prefix + c, below))
                elif below:
                    yield prefix + c, below


class _Container(dict):
    """Suffix -> [mentions, documents]; told from a node by its type."""


_SUBTREE = "field string, prefix string, suffixes array<string>, mentions array<long>, documents array<long>"
_COUNTED = "field string, term string, n_mentions long, n_documents long"


def _subtrees(tries: dict[str, BurstTrie]):
    rows = [(f, prefix, box) for f, trie in tries.items() for prefix, box in trie.containers()]
    for i in range(0, len(rows), 512):
        part = [(f, p, sorted(b), b) for f, p, b in rows[i : i + 512]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, *_ in part], pa.string()), pa.array([p for _, p, *_ in part], pa.string()), pa.array([s for *_, s, _ in part], pa.list_(pa.string()))]
            + [pa.array([[b[x][k] for x in s] for *_, s, b in part], pa.list_(pa.int64())) for k in (0, 1)],
            names=["field", "prefix", "suffixes", "mentions", "documents"],
        )


def _count(burst: int, flush: int):
    def run(batches):
        tries: dict[str, BurstTrie] = {}
        for b in batches:
            for f, t, n, d in zip(*(b.column(c).to_pylist() for c in ("field", "term", "n", "d"))):
                trie = tries.get(f)
                if trie is None:
                    trie = tries[f] = BurstTrie(burst)
                trie.add(t, n, d)
            if sum(t.size for t in tries.values()) > flush:
                yield from _subtrees(tries)
                tries = {}
        yield from _subtrees(tries)

    return run


def _merge(batches):
    """Rows in the order of (field, term) -> one row per term with the sums of its counters; the last term of a batch waits for the next one."""
    open_ = None

    def row(x):
        return pa.RecordBatch.from_arrays([pa.array([x[0]], pa.string()), pa.array([x[1]], pa.string()), pa.array([x[2]], pa.int64()), pa.array([x[3]], pa.int64())], names=["field", "term", "n_mentions", "n_documents"])

    for b in batches:
        if not b.num_rows:
            continue
        f, t = b.column("field"), b.column("term")
        n, d = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mentions", "documents"))
        differs = lambda c: ~pa.compute.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(differs(f) | differs(t)) + 1]) if b.num_rows > 1 else np.array([0])
        n, d, at = np.add.reduceat(n, starts), np.add.reduceat(d, starts), pa.array(starts)
        f, t = f.take(at), t.take(at)
        if open_ and (f[0].as_py(), t[0].as_py()) == open_[:2]:
            n[0] += open_[2]
            d[0] += open_[3]
        elif open_:
            yield row(open_)
        open_ = (f[-1].as_py(), t[-1].as_py(), int(n[-1]), int(d[-1]))
        yield pa.RecordBatch.from_arrays([f.slice(0, len(f) - 1), t.slice(0, len(t) - 1), pa.array(n[:-1], pa.int64()), pa.array(d[:-1], pa.int64())], names=["field", "term", "n_mentions", "n_documents"])
    if open_:
        yield row(open_)


def term_counts(mentions: DataFrame, fields: dict[str, str], burst: int = BURST, flush: int = FLUSH) -> DataFrame:
    """(field, term, n_mentions, n_documents) of every distinct term of the given columns.

    ``fields`` names them: field -> column.  A term is the whole value without
    blanks at both ends, in lower case; null and empty values don't count.  Each
    ``mention_id`` counts once however often it is delivered; a null
    ``mention_id`` doesn't count, a null ``doc_id`` counts as no document.
    """
    assert burst > 0 and flush > 0
    columns = list(fields.values())
    m = distinct_rows(mentions, "mention_id", "doc_id", *columns)
    pairs = m.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(_stripped(F.col(c))).alias("term")) for f, c in fields.items()])).alias("x"))
    rows = pairs.select("doc_id", "x.field", "x.term").filter(F.length("term") > 0).groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("field", "term", "n", F.col("doc_id").isNotNull().cast("int").alias("d"))
    trees = write_table(rows.mapInArrow(_count(burst, flush), _SUBTREE), "subtrees")
    flat = trees.select("field", "prefix", F.explode(F.arrays_zip("suffixes", "mentions", "documents")).alias("e")).select("field", F.concat("prefix", "e.suffixes").alias("term"), "e.mentions", "e.documents")
    return flat.repartitionByRange("field", "term").sortWithinPartitions("field", "term").mapInArrow(_merge, _COUNTED)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def marked_terms(mentions: DataFrame, fields: dict[str, str], rare: int = 2, common: float = 0.1, **trie) -> DataFrame:
    """:func:`term_counts` with ``mark``: 'rare', 'common' or null.

    ``rare``: in at most ``rare`` mentions; ``common``: in at least the share
    ``common`` of all distinct ``doc_id``.  A term that is both is 'common' only
    where the table has so few documents, and is then marked 'rare'.
    """
    n_docs = mentions.agg(F.countDistinct("doc_id")).scalar()
    mark = F.when(F.col("n_mentions") <= rare, "rare").when(F.col("n_documents") >= F.lit(common) * n_docs, "common")
    return term_counts(mentions, fields, **trie).withColumn("mark", mark)
