"""All feature strings of all pairs of a document, summed up per anaphor without the pairs.

A string is made of parts of the anaphor, of the antecedent, and of what holds
between them. Its CRC-32 is linear: that of two parts is the first's, moved by
the length of the second, xor the second's. So the sum over many antecedents
needs, for each length of what they end in, their number and how many of them
have each bit set; running totals of those give the sums of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relation_counts import Rows, contained_strings, spread

#: Pair features that can be summed up.
PAIRS = ("exact_match", "head_match", "same_speaker", "sentence_distance", "tokens_contained")
_FEW = 128
_ZERO = np.array([crc32(bytes([i])) ^ crc32(b"\0") for i in range(256)], dtype=np.int64)


def _zero_byte(x: np.ndarray) -> np.ndarray:
    """CRCs moved by one byte."""
    return _ZERO[x & 255] ^ (x >> 8)


def feature_sums(mentions: DataFrame, names: list[str], pair: list[str], cap: int = 5) -> DataFrame:
    """(doc_id, ana_idx, n_pairs, n_features, crc_sum): of each anaphor its pairs, their strings as :func:`..functions.features.feature_strings` has them, and the sum of the strings' CRC-32.

    ``mentions`` has ``feature_values``, and ``_row``, by which repeated rows are known, where there are any.
    """
    assert set(pair) <= set(PAIRS), "other pair features have no sums"
    m = mentions.filter("doc_id IS NOT NULL AND mention_idx > 0")
    values = [F.get("feature_values", F.lit(i)).alias(f"v{i}") for i in range(len(names))]
    asked = m.select("doc_id", "mention_idx", *[c for c in ("_row",) if c in m.columns], "sent_id", "speaker", "tokens_as_lowercase_string", "head_as_lowercase_string", *values)
    spark = m.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from _Sums(Rows(batches), names, pair, cap).batches()

    return asked.repartition(n, "doc_id").mapInArrow(run, f"doc_id string, ana_idx {dict(m.dtypes)['mention_idx']}, n_pairs long, n_features long, crc_sum long")


class _Sums:
    def __init__(self, r: Rows, names: list[str], pair: list[str], cap: int) -> None:
        self.r, self.cap = r, cap
        self.pairs = r.before(np.ones(r.n, dtype=np.int64))
        self.features, self.crc = np.zeros(r.n, dtype=np.int64), np.zeros(r.n, dtype=np.int64)
        columns = [r.codes(f"v{i}") for i in range(len(names))]
        self.code = [c for c, _ in columns]
        text = lambda side: [[f"{side}_{n}={v}".encode() for v in values] for n, (_, values) in zip(names, columns)]
        self.own, self.other = text("ana"), text("ante")
        self.first = self.code[0]
        #: of each kind of antecedent, by its first value, the number before each row
        self.kinds = range(len(self.own[0]))
        self.of_kind = [r.before(self.first == f) for f in self.kinds]
        self.mention_strings()
        for i in range(1, len(names)):
            self.joined(i)
        at = {
            "exact_match": lambda: self.equal("exact_match", r.codes("tokens_as_lowercase_string")[0]), "head_match": lambda: self.equal("head_match", r.codes("head_as_lowercase_string")[0]),
            "same_speaker": lambda: self.equal("same_speaker", r.codes("speaker")[0]), "sentence_distance": self.distances, "tokens_contained": self.contained,
        }
        for name in pair:
            at[name]()

    def batches(self) -> Iterator[pa.RecordBatch]:
        r = self.r
        at = np.flatnonzero((r.tie == np.arange(r.n)))
        sums = [np.add.reduceat(x, at) for x in (self.pairs, self.features, self.crc)]
        kept = np.flatnonzero(sums[0])
        docs = pa.array(r.docs, pa.string())
        for i in range(0, len(kept), 1 << 14):
            k = kept[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(r.doc[at[k]])), pa.array(r.idx[at[k]]), *[pa.array(s[k]) for s in sums]], ["doc_id", "ana_idx", "n_pairs", "n_features", "crc_sum"])

    def mention_strings(self) -> None:
        """Strings of one side, and those of both first values."""
        k = len(self.own)
        self.features += self.pairs * (3 * k + 3 * (3 * k - 3))
        alone = sum(np.array([crc32(s) for s in own], dtype=np.int64)[c] for own, c in zip(self.own, self.code))
        there = sum(np.array([crc32(s) for s in other], dtype=np.int64)[c] for other, c in zip(self.other, self.code))
        for i in range(1, k):
            for texts, side in ((self.own, 0), (self.other, 1)):
                starts = [crc32(s + b"^") for s in texts[0]]
                keys, at = np.unique(self.first * len(texts[i]) + self.code[i], return_inverse=True)
                joint = np.array([crc32(texts[i][x % len(texts[i])], starts[x // len(texts[i])]) for x in keys.tolist()], dtype=np.int64)[at]
                alone, there = (alone + joint, there) if side == 0 else (alone, there + joint)
        self.crc += self.pairs * alone + self.r.before(there)
        for f in self.kinds:
            self.crc += self.of_kind[f] * np.array([crc32(s + b"^" + self.other[0][f]) for s in self.own[0]], dtype=np.int64)[self.first]

    def joined(self, i: int) -> None:
        """Strings of both sides with the value of a further feature on one or both."""
        width = len(self.own[i])
        key = self.first * width + self.code[i]
        keys, at = np.unique(key, return_inverse=True)
        firsts, others = [self.own[0][x // width] for x in keys.tolist()], [self.own[i][x % width] for x in keys.tolist()]
        lengths = np.array([len(s) for s in self.other[i]], dtype=np.int64)
        for f in self.kinds:
            kind, here = self.other[0][f], np.flatnonzero(self.first == f)
            # without the antecedent's value: its kind before the anaphor's value, and both first ones before it
            plain = np.array([crc32(kind + b"^" + b) + crc32(b"^".join((a, kind, b))) for a, b in zip(firsts, others)], dtype=np.int64)
            self.crc += self.of_kind[f] * plain[at]
            # what stands before the antecedent's value
            starts = np.array([[crc32(s) for s in (a + b"^", a + b"^" + kind + b"^", b + b"^", a + b"^" + b + b"^", kind + b"^" + b + b"^", a + b"^" + kind + b"^" + b + b"^")] for a, b in zip(firsts, others)], dtype=np.int64)
            if len(keys) <= _FEW and width <= _FEW:
                for v in np.unique(self.code[i][here]).tolist():
                    x = starts
                    for _ in range(lengths[v]):
                        x = _zero_byte(x)
                    self.crc += self.r.before(key == f * width + v) * (x ^ crc32(self.other[i][v])).sum(axis=1)[at]
                continue
            sizes, done, x = lengths[self.code[i][here]], 0, starts
            ends = np.array([crc32(s) for s in self.other[i]], dtype=np.int64)
            for n in np.unique(sizes).tolist():
                for _ in range(n - done):
                    x = _zero_byte(x)
                done = n
                self.bits(here[sizes == n], ends[self.code[i][here[sizes == n]]], x, at)

    def bits(self, antes: np.ndarray, ends: np.ndarray, starts: np.ndarray, at: np.ndarray, at_once: int = 1 << 15) -> None:
        """Adds, for the antecedents before each row, the sum of their ends xor each of the row's starts."""
        r, power = self.r, np.arange(32)
        set_ = (ends[:, None] >> power) & 1
        run = np.cumsum(1 - 2 * set_, axis=0)
        # running totals of their document: n minus twice the number of set bits
        base = np.searchsorted(antes, r.first[antes])
        run -= np.where(base[:, None] > 0, run[base - 1], 0)
        low, high = np.searchsorted(antes, r.first), np.searchsorted(antes, r.tie)
        rows = np.flatnonzero(high > low)
        self.crc += starts.shape[1] * r.before(np.bincount(antes, weights=ends, minlength=r.n).astype(np.int64))
        weights = (((starts[:, :, None] >> power) & 1).sum(axis=1)) << power
        for j in range(0, len(rows), at_once):
            k = rows[j : j + at_once]
            self.crc[k] += np.einsum("ij,ij->i", weights[at[k]], run[high[k] - 1])

    def add(self, text: str, f: int, n: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Counts a pair feature's string of the antecedents of a kind, alone and after the first strings."""
        end, kind = text.encode(), self.other[0][f]
        each = np.array([sum(crc32(s + end) for s in (b"", a + b"^", kind + b"^", a + b"^" + kind + b"^")) for a in self.own[0]], dtype=np.int64)
        if rows is None:
            self.features += 4 * n
            self.crc += n * each[self.first]
        else:
            self.features[rows] += 4 * n
            self.crc[rows] += n * each[self.first[rows]]

    def found(self, antes: np.ndarray, key: np.ndarray, rows: np.ndarray, of: np.ndarray):
        """For each kind, the number of ``antes`` with the key of each of ``rows``, in its document and before it."""
        r = self.r
        width = int(max(key.max(initial=0), of.max(initial=0))) + 1
        keys, dense = np.unique(r.doc[antes] * width + key, return_inverse=True)
        if not len(keys):
            return
        order = np.lexsort((antes, dense))
        there = dense[order] * (r.n + 1) + antes[order]
        own = r.doc[rows] * width + of
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == own)
        at, rows = at[hit] * (r.n + 1), rows[hit]
        low, high = np.searchsorted(there, at), np.searchsorted(there, at + r.tie[rows])
        kind = self.first[antes[order]]
        for f in self.kinds:
            total = np.append(0, np.cumsum(kind == f))
            yield f, np.bincount(rows, weights=total[high] - total[low], minlength=r.n).astype(np.int64)

    def equal(self, name: str, code: np.ndarray) -> None:
        rows = np.flatnonzero(code >= 0)
        for f, n in self.found(rows, code[rows], rows, code[rows]):
            self.add(f"{name}=True", f, n)

    def distances(self) -> None:
        """Up to the cap antecedents are looked up by sentence, those further back are all others; sentences out of order are compared one by one."""
        r = self.r
        at, known = r.numbers("sent_id")
        rows = np.flatnonzero(known)
        if not len(rows):
            return
        at = at - at[rows].min() + self.cap
        far = [np.where(known, r.before(known & (self.first == f)), 0) for f in self.kinds]
        for d in range(self.cap):
            for f, n in self.found(rows, at[rows], rows, at[rows] - d):
                self.add(f"sentence_distance={d}", f, n)
                far[f] -= n
        top = np.maximum.accumulate(np.where(known, at, -1) + r.doc * (at.max() + 2)) - r.doc * (at.max() + 2)
        for i in rows[(top > at)[rows]].tolist():
            before = np.arange(r.first[i], r.tie[i])
            before = before[known[before] & (at[before] > at[i])]
            for (d, f), n in zip(*_counted(at[i] - at[before], self.first[before])):
                self.add(f"sentence_distance={d}", f, np.array([n]), np.array([i]))
                far[f][i] -= n
        for f in self.kinds:
            self.add(f"sentence_distance=>={self.cap}", f, far[f])

    def contained(self) -> None:
        """One string in the other, either way; equal ones once."""
        code, texts = self.r.codes("tokens_as_lowercase_string")
        rows = np.flatnonzero(code >= 0)
        within = contained_strings(texts, texts)
        anas, part = spread(rows, code[rows], within)
        antes, item = spread(rows, code[rows], [[j for j in x if j != i] for i, x in enumerate(within)])
        for found in (self.found(rows, code[rows], anas, part), self.found(antes, item, rows, code[rows])):
            for f, n in found:
                self.add("tokens_contained=True", f, n)


def _counted(*columns: np.ndarray) -> tuple[list[tuple], list[int]]:
    if not len(columns[0]):
        return [], []
    values, n = np.unique(np.stack(columns), axis=1, return_counts=True)
    return [tuple(v) for v in values.T.tolist()], n.tolist()
