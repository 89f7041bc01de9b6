"""How often relations hold among all pairs of a document, without the pairs.

The mentions of a document meet in one task, as numbers: what a relation asks of
both mentions is counted by equal keys and by running totals. The work grows
with the mentions, and nothing but one exchange of them goes to disk.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import features as X


class Rows:
    """The rows of whole documents in the order of (document, index), with columns as numbers; rows with equal ``_row`` at one place are one."""

    def __init__(self, batches: Iterable[pa.RecordBatch], doc: str = "doc_id", idx: str = "mention_idx") -> None:
        self.table = pa.Table.from_batches(batches)
        codes, self.docs = self._codes(doc)
        keys = [self.table.column(c).to_numpy() for c in ("_row", idx) if c in self.table.column_names] + [codes]
        self.order = np.lexsort(keys)
        if "_row" in self.table.column_names:
            self.order = self.order[np.append(True, np.any([k[self.order][1:] != k[self.order][:-1] for k in keys], axis=0))]
        self.doc, self.idx = codes[self.order], self.table.column(idx).to_numpy()[self.order]
        self.n = len(self.doc)
        opens = np.append(True, self.doc[1:] != self.doc[:-1])
        fresh = opens | np.append(True, self.idx[1:] != self.idx[:-1])
        at = np.arange(self.n)
        #: first row of the document, and first row of the same index
        self.first, self.tie = np.maximum.accumulate(np.where(opens, at, 0)), np.maximum.accumulate(np.where(fresh, at, 0))

    def _codes(self, name: str) -> tuple[np.ndarray, list]:
        a = self.table.column(name).combine_chunks().dictionary_encode()
        return a.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), a.dictionary.to_pylist()

    def codes(self, name: str) -> tuple[np.ndarray, list]:
        """(number of each row's value, -1 for null; the values)."""
        c, values = self._codes(name)
        return c[self.order], values

    def flags(self, name: str) -> np.ndarray:
        return self.table.column(name).fill_null(False).to_numpy().astype(bool)[self.order]

    def numbers(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether there is one)."""
        a = self.table.column(name).combine_chunks()
        return a.fill_null(0).to_numpy().astype(np.int64)[self.order], a.is_valid().to_numpy(zero_copy_only=False)[self.order]

    def before(self, what: np.ndarray) -> np.ndarray:
        """Of each row the sum of ``what`` over the rows of its document with a smaller index."""
        total = np.append(0, np.cumsum(what, dtype=np.int64))
        return total[self.tie] - total[self.first]

    def equal_before(self, anas: np.ndarray, of: np.ndarray, antes: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of each of ``anas`` (rows) the number of ``antes`` (rows) with its key, in its document and before it."""
        if not len(anas) or not len(antes):
            return np.zeros(len(anas), dtype=np.int64)
        width = int(max(of.max(), key.max())) + 1
        keys, dense = np.unique(self.doc[antes] * width + key, return_inverse=True)
        there = np.sort(dense * (self.n + 1) + antes)
        own = self.doc[anas] * width + of
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        low = at * (self.n + 1)
        n = np.searchsorted(there, low + self.tie[anas]) - np.searchsorted(there, low + self.first[anas])
        return np.where(keys[at] == own, n, 0)

    def below_before(self, anas: np.ndarray, limit: np.ndarray, value: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Of each of ``anas`` the rows before it in its document whose value is at most its limit; a pair is met at the highest bit in which their places differ."""
        out = np.zeros(len(anas), dtype=np.int64)
        rows = np.flatnonzero(valid)
        if not len(anas) or not len(rows):
            return out
        least = int(value[rows].min())
        width = int(value[rows].max()) - least + 2
        values, ranks = np.unique(self.doc[rows] * width + value[rows] - least, return_inverse=True)
        low = np.searchsorted(values, self.doc[anas] * width)
        high = np.maximum(low, np.searchsorted(values, self.doc[anas] * width + np.clip(limit - least, -1, width - 1), "right"))
        for bit in range(int(self.n).bit_length()):
            block, own = self.tie[rows] >> bit, (self.tie[anas] >> bit) - 1
            there = np.sort((block * len(values) + ranks)[block % 2 == 0])
            right = np.flatnonzero(own % 2 == 0)
            base = own[right] * len(values)
            out[right] += np.searchsorted(there, base + high[right]) - np.searchsorted(there, base + low[right])
        return out

    def sums(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A sum for each document."""
        return np.bincount(self.doc[rows], weights=n, minlength=len(self.docs)).astype(np.int64)


def spread(rows: np.ndarray, codes: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, item): each row once per item of the list that its code has."""
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.array([i for x in lists for i in x], dtype=np.int64)
    n = lengths[codes]
    starts = (np.cumsum(lengths) - lengths)[codes]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), flat[np.repeat(starts, n) + within] if len(flat) else flat


def contained_strings(parts: list[str], wholes: list[str], key: int = 3) -> list[list[int]]:
    """Of each whole the places of the parts that are in it: looked up by their first characters."""
    place = {p: i for i, p in enumerate(parts)}
    lengths = defaultdict(set)
    for p in parts:
        lengths[p[:key]].add(len(p))
    out = []
    for w in wholes:
        found = {place[""]} if "" in place else set()
        for i in range(len(w)):
            for k in range(1, key + 1):
                for n in lengths.get(w[i : i + k], ()):
                    if n == k or k == key:
                        j = place.get(w[i : i + n])
                        if j is not None:
                            found.add(j)
        out.append(sorted(found))
    return out


def contained_sets(sets: list[frozenset]) -> list[list[int]]:
    """Of each set the places of the sets that are in it, looked up by their rarest element; an empty one is in none."""
    often = defaultdict(int)
    for s in sets:
        for w in s:
            often[w] += 1
    by = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            by[min(s, key=lambda w: (often[w], w))].append(i)
    return [[i for w in s for i in by.get(w, ()) if sets[i] <= s] for s in sets]


def _acronyms(tokens: list) -> list[str]:
    """As :func:`..functions.features.acronyms` has them."""
    kept = [t for t in tokens if t is not None and not re.match(X.DESIGNATORS, t.lower())]
    capitals = [t[0] for t in kept if t and unicodedata.category(t[0]) == "Lu"]
    return [" ".join(kept), "".join(capitals), ".".join(capitals) + "."]


def _bare(tokens: list) -> str:
    return _text(tokens).replace(".", "")


def _text(tokens: list) -> str:
    return " ".join(t for t in tokens if t is not None)


def _is_alias(kind: str, a: list, b: list) -> bool:
    """The rule of :func:`..functions.features.alias` for the heads of an anaphor and an antecedent of one kind that differ in lower case."""
    same = lambda i: len(a) >= abs(i + (i >= 0)) and len(b) >= abs(i + (i >= 0)) and a[i] is not None and a[i] == b[i]
    if kind == "PERSON":
        titled = lambda x: len(x) == 2 and (x[0] or "").lower() in ("mr", "ms", "mr.", "ms.")
        if len(a) == 1 or len(b) == 1:
            return same(0) or same(-1)
        return same(-1) and (titled(a) or titled(b) or same(0) or same(-2))
    k = min(len(a), len(b))
    return a[:k] == b[:k] or _bare(a) == _bare(b) or (_text(b) in _acronyms(a) if len(a) > len(b) else _text(a) in _acronyms(b))


def aliased(names: list[tuple[int, str, list, int]]) -> list[list[int]]:
    """Of each name (document, kind, head, number of its string in lower case) the places of those that it is an alias of as their antecedent.

    Whatever is an alias shares its first or last token or its text without full stops, is the other one's short form, or has no tokens.
    """
    by, every = defaultdict(set), defaultdict(list)
    keys = []
    for i, (doc, kind, head, _) in enumerate(names):
        at, ends = (doc, kind), [("f", head[0]), ("l", head[-1])] if head else []
        own = ends if kind == "PERSON" else [*ends[:1], ("b", _bare(head)), ("t", _text(head))]
        keys.append([(at, k) for k in own])
        for k in keys[-1]:
            by[k].add(i)
        if kind != "PERSON":
            every[at].append(i)
            for t in _acronyms(head):
                by[at, ("s", t)].add(i)
    out = []
    for i, (doc, kind, head, lower) in enumerate(names):
        near = set().union(*[by[k] for k in keys[i]])
        if kind != "PERSON":
            near |= by.get(((doc, kind), ("s", _text(head))), set()).union(*[by.get(((doc, kind), ("t", t)), set()) for t in _acronyms(head)])
            near = near.union(every[doc, kind]) if not head else near | {j for j in by.get(((doc, kind), ("b", "")), ()) if not names[j][2]}
        out.append([j for j in near if names[j][3] != lower and _is_alias(kind, names[j][2], head)])
    return out


_AGREE = ("gender", "number", "semantic_class")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def relation_counts(mentions: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, a count per name): of all pairs of a document those for which a relation holds; documents without pairs are left out.

    ``mentions`` has what :func:`..functions.rules.with_rule_columns` adds, and ``_row``, by which repeated rows are known, where there are any.
    """
    m = mentions.filter("doc_id IS NOT NULL AND mention_idx > 0")
    kind, form = F.col("type"), F.col("citation_form")
    pro, alias_kind = _sure(kind == "PRO"), X.alias_kind(A.head_ner(F.col("ner"), F.col("head_index")))
    flags = {
        "nominal": ~_sure(kind.isin("PRO", "DEM", "VRB")), "pro": pro, "nam": _sure(kind == "NAM"), "numeric": _sure(F.col("semantic_class") == "NUMERIC"), "is_and": _sure((F.size("head") == 1) & (F.get("head", F.lit(0)) == "and")),
        "third": pro & _sure(form.isin("he", "she", "it", "they")), "anaphoric": _sure(kind.isin("NAM", "PRO") | ((kind == "NOM") & (F.col("fine_type") == "DEF"))), "may": _sure(F.col("fine_type").isin("REFL", "POSS", "POSS_ADJ")),
    }
    values = {
        "begin": F.col("span.begin"), "end": F.col("span.end"), "form": form, "spoken": F.when(F.col("speaker") != "-", F.col("speaker")), "function": F.col("grammatical_function"), "modifiers": F.to_json(F.array_sort("modifiers")),
        "alias": F.when((kind == "NAM") & F.col("head").isNotNull() & alias_kind.isNotNull(), F.to_json(F.struct(alias_kind.alias("kind"), "head"))), **{c: F.coalesce(c, F.lit("UNKNOWN")) for c in _AGREE},
    }
    asked = m.select("doc_id", "mention_idx", "sent_id", "clean", "head_text", "text", *[c for c in ("_row",) if c in m.columns], *[c.alias(n) for n, c in {**flags, **values}.items()])
    spark = m.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = asked.repartition(n, "doc_id").mapInArrow(_count, "doc_id string, relation string, n long")
    wide = counted.groupBy("doc_id").agg(*[F.sum(F.when(F.col("relation") == x, F.col("n"))).alias(x) for x in ("_pairs", *names)]).filter("_pairs > 0")
    return wide.select("doc_id", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in names])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    r = Rows(batches)
    found = {name: f(r) for name, f in COUNTS.items()}
    for name, n in found.items():
        kept = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([r.docs[i] for i in kept], pa.string()), pa.array([name] * len(kept), pa.string()), pa.array(n[kept], pa.int64())], ["doc_id", "relation", "n"])


def _alone(ana: Callable[[Rows], np.ndarray], ante: Callable[[Rows], np.ndarray]) -> Callable[[Rows], np.ndarray]:
    """Pairs of a relation that asks something of each mention alone."""
    return lambda r: r.sums(np.arange(r.n), ana(r) * r.before(ante(r)))


def _all(r: Rows) -> np.ndarray:
    return np.ones(r.n, dtype=np.int64)


def _does(r: Rows, what: str) -> np.ndarray:
    codes, values = r.codes("function")
    return codes == (values.index(what) if what in values else -2)


def _fits(r: Rows) -> np.ndarray:
    return ~r.flags("pro") | r.flags("third")


def _alike(r: Rows, anas: np.ndarray, antes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pairs of anaphors and antecedents (flags) with equal keys; -1 is no key."""
    a, b = np.flatnonzero(anas & (key >= 0)), np.flatnonzero(antes & (key >= 0))
    return r.sums(a, r.equal_before(a, key[a], b, key[b]))


def _forms(r: Rows) -> np.ndarray:
    return _alike(r, r.flags("pro"), r.flags("pro"), r.codes("form")[0] + 1)


def _strings(r: Rows) -> np.ndarray:
    return _alike(r, r.flags("nominal"), r.flags("nominal"), r.codes("clean")[0])


def _heads(r: Rows) -> np.ndarray:
    ok = r.flags("nominal") & ~r.flags("numeric")
    return _alike(r, ok & ~r.flags("is_and"), ok, r.codes("head_text")[0])


def _speakers(r: Rows) -> np.ndarray:
    """i, we and you of two speakers, or i and you of one."""
    codes, values = r.codes("form")
    who = r.codes("spoken")[0]
    said = {f: r.flags("pro") & (who >= 0) & (codes == (values.index(f) if f in values else -2)) for f in ("i", "we", "you")}
    out = _alike(r, said["i"], said["you"], who) + _alike(r, said["you"], said["i"], who)
    for x in said.values():
        out += r.sums(np.arange(r.n), x * r.before(x)) - _alike(r, x, x, who)
    return out


def _compatible(r: Rows) -> np.ndarray:
    """Pairs that differ in a known attribute, but for those of equal strings."""
    columns, rest = [r.codes(c) for c in _AGREE], np.arange(r.n)
    cells, cell = np.unique(np.stack([c for c, _ in columns]), axis=1, return_inverse=True)
    cell = cell.reshape(-1)
    unknown = [values.index("UNKNOWN") if "UNKNOWN" in values else -2 for _, values in columns]
    agree = lambda x, y: all(a == b or u in (a, b) for a, b, u in zip(cells[:, x], cells[:, y], unknown))
    clean = r.codes("clean")[0]
    # strings whose mentions have several cells
    key = np.where(clean >= 0, r.doc * (clean.max() + 1) + clean, -1)
    one = np.unique(np.stack([key, cell]), axis=1)[0]
    several = np.unique(one[1:][one[1:] == one[:-1]])
    mixed = np.isin(key, several) & (clean >= 0)
    own = [cell == c for c in range(cells.shape[1])]
    had, out = [r.before(x) for x in own], np.zeros(len(r.docs), dtype=np.int64)
    for x, y in product(range(len(own)), repeat=2):
        if not agree(x, y):
            rows = rest[own[x]]
            out += r.sums(rows, had[y][rows])
            a, b = np.flatnonzero(own[x] & mixed), np.flatnonzero(own[y] & mixed)
            if len(a) and len(b):
                out -= r.sums(a, r.equal_before(a, clean[a], b, clean[b]))
    return out


def _far_its(r: Rows) -> np.ndarray:
    """'it' and what is more than a sentence before it."""
    codes, values = r.codes("form")
    at, known = r.numbers("sent_id")
    its = np.flatnonzero(r.flags("pro") & (codes == (values.index("it") if "it" in values else -2)) & known)
    return r.sums(its, r.below_before(its, at[its] - 2, at, known))


def _embedding(r: Rows, block: int = 8, at_once: int = 1 << 20) -> np.ndarray:
    """Spans within those of earlier mentions, which share the block of their first token; a span that ends before it begins meets all."""
    (begin, b_known), (end, e_known) = r.numbers("begin"), r.numbers("end")
    whole = b_known & e_known
    out = np.zeros(len(r.docs), dtype=np.int64)
    inside = lambda a, b: (r.tie[b] < r.tie[a]) & (begin[b] <= begin[a]) & (end[a] <= end[b])
    b = np.flatnonzero(whole & (begin <= end))
    low = int(begin[b].min()) // block if len(b) else 0
    width = int(end[b].max()) // block - low + 2 if len(b) else 1
    n = end[b] // block - begin[b] // block + 1
    rows = np.repeat(b, n)
    keys = r.doc[rows] * width + begin[rows] // block - low + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    a = np.flatnonzero(whole & ~r.flags("may") & (begin <= end))
    place = begin[a] // block - low
    own = r.doc[a] * width + place
    left, right = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
    ends = np.cumsum(right - left)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, "right")))
        k = (right - left)[start:stop]
        x = np.repeat(a[start:stop], k)
        y = rows[np.repeat(left[start:stop], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        out += r.sums(x, inside(x, y).astype(np.int64))
        start = stop
    for x in np.flatnonzero(whole & ~r.flags("may") & (begin > end)):
        y = np.arange(r.first[x], r.tie[x])
        out[r.doc[x]] += np.count_nonzero(inside(x, y) & whole[y])
    return out


def _modifiers(r: Rows) -> np.ndarray:
    """Nominals with a modifier that the antecedent lacks; two names are none of them."""
    codes, values = r.codes("modifiers")
    sets = [frozenset(json.loads(v)) for v in values]
    some = r.flags("nominal") & np.append([bool(s) for s in sets], False)[codes]
    known, nam = r.flags("nominal") & (codes >= 0), r.flags("nam")
    out = r.sums(np.arange(r.n), (some & ~nam) * r.before(known) + (some & nam) * r.before(known & ~nam))
    within = contained_sets(sets)
    for anas, antes in ((some & ~nam, some), (some & nam, some & ~nam)):
        a, b = np.flatnonzero(anas), np.flatnonzero(antes)
        rows, item = spread(b, codes[b], within)
        out -= r.sums(a, r.equal_before(a, codes[a], rows, item))
    return out


def _alias(r: Rows) -> np.ndarray:
    """Names of a document are compared once."""
    codes, values = r.codes("alias")
    rows = np.flatnonzero(codes >= 0)
    items, firsts, item = np.unique(r.doc[rows] * (len(values) + 1) + codes[rows], return_index=True, return_inverse=True)
    parsed, lower = [json.loads(v) for v in values], r.codes("head_text")[0]
    names = [(int(r.doc[i]), parsed[codes[i]]["kind"], parsed[codes[i]]["head"], int(lower[i])) for i in rows[firsts]]
    antes, other = spread(rows, item, aliased(names))
    return r.sums(rows, r.equal_before(rows, item, antes, other))


def _substring(r: Rows) -> np.ndarray:
    """Names that contain a later nominal's string: different strings are compared once."""
    (clean, cleans), (text, texts) = r.codes("clean"), r.codes("text")
    ok = r.flags("nominal") & ~r.flags("numeric")
    a, b = np.flatnonzero(ok & ~r.flags("is_and") & (clean >= 0)), np.flatnonzero(ok & r.flags("nam") & (text >= 0))
    parts, wholes = np.unique(clean[a]), np.unique(text[b])
    within = contained_strings([cleans[i] for i in parts], [texts[i] for i in wholes])
    rows, item = spread(b, np.searchsorted(wholes, text[b]), within)
    return r.sums(a, r.equal_before(a, np.searchsorted(parts, clean[a]), rows, item))


COUNTS: dict[str, Callable[[Rows], np.ndarray]] = {
    "_pairs": _alone(_all, _all),
    "not_modifier": _modifiers,
    "not_compatible": _compatible,
    "not_embedding": _embedding,
    "not_speaker": _speakers,
    "not_pronoun_distance": _far_its,
    "not_anaphoric": _alone(lambda r: ~r.flags("anaphoric"), _all),
    "alias": _alias,
    "non_pronominal_string_match": _strings,
    "head_match": _heads,
    "pronoun_same_canonical_form": _forms,
    "anaphor_pronoun": _alone(lambda r: r.flags("third"), _fits),
    "antecedent_is_subject": _alone(lambda r: r.flags("third"), lambda r: _fits(r) & _does(r, "SUBJECT")),
    "antecedent_is_object": _alone(lambda r: r.flags("third"), lambda r: _fits(r) & _does(r, "OBJECT")),
    "substring": _substring,
    "pronoun_parallelism": lambda r: sum(_alone(lambda r, w=w: r.flags("third") & _does(r, w), lambda r, w=w: _fits(r) & _does(r, w))(r) for w in ("SUBJECT", "OBJECT")),
}
