"""Problem 2: variant spellings of the names of persons and organisations.

A spelling is parsed into an anchor (surname, or an organisation's first word)
and the rest.  Anchors one edit apart are found by a trie join: two such words
share their first or their last half, so words are sharded by both; a task
builds a trie per shard and walks it with the Levenshtein automaton of each word
(bounded rows of the edit matrix, neighbours swapped count as one edit).  Linked anchors are a block.
Within a block the rest is compared in any order of tokens: equal or one edit apart, short form and given name,
abbreviation and word, initials and words.  Initials that could stand for several
entities of a block link to none of them.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from .components import connected_components
from .given_names import short_forms

#: Anchors and other words shorter than these are compared exactly.
ANCHOR_FUZZY, WORD_FUZZY = 5, 4

# Titles of persons, legal forms of organisations.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sen senator rep sir dame lady lord hon rev fr sr sra srta herr frau mme mlle m monsieur madame judge gen col capt lt sgt gov pres president minister dean".split())
LEGAL_FORMS = frozenset("inc incorporated ltd limited plc llc llp lp sa s.a ag gmbh kg co nv bv ab oy as asa spa srl sarl pty pte kk corp s.p.a s.r.l n.v b.v a.g".split())


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


class Trie:
    """Words by character; the key '' of a node holds the word that ends there."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def neighbours(self, word: str, bound: int = 1):
        """Words within ``bound`` edits: the automaton's state is a row of the edit matrix, and a branch ends when its row exceeds the bound."""
        n = len(word)
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, before = stack.pop()
            if "" in node and row[n] <= bound:
                yield node[""]
            for c, below in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c))
                    if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= bound or (min(row) < bound):
                    stack.append((below, c, new, row))


def shard_keys(word: Column) -> Column:
    """Halves such that any two words one edit apart have one in common; longer words have those of the next shorter length too."""
    n = F.length(word)
    half = lambda d: F.greatest(F.floor((n - d) / 2), F.lit(1)).cast("int")
    ends = lambda k: [F.concat(F.lit("<"), F.substring(word, F.lit(1), k)), F.concat(F.lit(">"), F.substring(word, n - k + 1, k))]
    return F.array_distinct(F.array(*ends(half(1)), *ends(half(2))))


def _trie_join(batches):
    """(shard, word) rows, all of a shard in one partition -> pairs of neighbours, the smaller word first."""
    shards: dict[str, list[str]] = defaultdict(list)
    for b in batches:
        for s, w in zip(b.column("shard").to_pylist(), b.column("word").to_pylist()):
            shards[s].append(w)
    found = set()
    for words in shards.values():
        if len(words) > 1:
            trie = Trie(words)
            found.update((w, x) for w in words for x in trie.neighbours(w) if w < x)
    pairs = sorted(found)
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], names=["a", "b"])


def neighbour_words(words: DataFrame, column: str = "word") -> DataFrame:
    """(a, b), a < b: distinct words one edit apart, both at least ``ANCHOR_FUZZY`` long; nulls take no part."""
    long = words.select(F.col(column).alias("word")).filter(F.length("word") >= ANCHOR_FUZZY).distinct()
    sharded = long.select("word", F.explode(shard_keys(F.col("word"))).alias("shard"))
    return sharded.repartition(2 * words.sparkSession.sparkContext.defaultParallelism, "shard").mapInArrow(_trie_join, "a string, b string").distinct()


_MARKS = regex.compile(r"\p{M}+")
_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ı": "i", "’": "'"})
_INITIALS = regex.compile(r"(?:\p{L}\.)+|\p{L}")


def plain(s: str) -> str:
    """Lower case without accents."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", s.lower().translate(_PLAIN)))


def parse_person(spelling: str, given: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(surname, given name or initials) readings; a bare name has none."""
    s = regex.sub(r"((?:^|[\s,])(?:\p{L}\.)+)(?=\p{L}{2,})", r"\1 ", plain(spelling))  # f.last
    head, comma, tail = s.partition(",")
    clean = lambda part: [t for t in (x.strip("'\"()") for x in part.split()) if t and t.rstrip(".") not in TITLES or _INITIALS.fullmatch(t) and t.rstrip(".") == "m"]
    if comma:
        last, first = clean(head), clean(tail)
        return [("".join(last).replace("-", ""), first[0])] if last and first else []
    tokens = clean(s)
    if len(tokens) < 2:
        return []
    join = lambda ts: "".join(ts).replace("-", "")
    short = [bool(_INITIALS.fullmatch(t)) for t in tokens]
    if short[0]:
        rest = [t for t, i in zip(tokens[1:], short[1:]) if not i]
        return [(join(rest), tokens[0])] if rest else []
    if short[-1] and not all(short[1:]):  # last first m. / last f.
        tokens, short = tokens[:-1], short[:-1]
        if len(tokens) < 2:
            return []
    if all(short[1:]):
        return [(tokens[0].replace("-", ""), tokens[1])]
    body = [t for t, i in zip(tokens, short) if not i]
    forward, backward = (join(body[1:]), body[0]), (join(body[:-1]), body[-1])
    known = lambda t: 2 if t in given else 1 if len(t) >= 3 and any(within_one(t, g) for g in given if g[:1] == t[:1] or g[1:2] == t[:1] or g[:1] == t[1:2]) else 0
    a, b = known(body[0]), known(body[-1])
    return [forward] if a > b else [backward] if b > a else [forward, backward] if not a else [forward]


def parse_organisation(spelling: str) -> list[tuple[str, str]]:
    """(distinctive word, the other words joined by blanks); a legal form after at least three words is left out.

    The distinctive word is the first one, or the one after "of" ("union of x" is "x union").
    """
    text = plain(spelling)
    front, of, back = text.rpartition(" of ")
    tokens = [t for t in regex.split(r"[\s,\-/&]+", f"{back} {front}" if of else text) if t and t not in ("the", "and", "of")]
    while len(tokens) > 3 and tokens[-1].rstrip(".") in LEGAL_FORMS:
        tokens.pop()
    if len(tokens) == 3 and tokens[2].rstrip(".") in LEGAL_FORMS and _INITIALS.fullmatch(tokens[1]):
        tokens.pop()
    return [(tokens[0].strip("."), " ".join(tokens[1:]))] if len(tokens) > 1 else []


def _parse(batches):
    given = short_forms()
    for b in batches:
        rows = []
        for s, kind in zip(b.column("spelling").to_pylist(), b.column("kind").to_pylist()):
            for anchor, rest in parse_person(s, given) if kind == "PERSON" else parse_organisation(s):
                if anchor:
                    rows.append((s, kind, anchor, rest))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["spelling", "kind", "anchor", "rest"])


def _fuzzy(word: str, words, least: int = WORD_FUZZY) -> list[str]:
    return [w for w in words if min(len(word), len(w)) >= 3 and max(len(word), len(w)) >= least and within_one(word, w)]


def _persons(rows: list[tuple[str, str]], given: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """Groups of spellings of a block by (spelling, given name or initials)."""
    full: dict[str, set[str]] = defaultdict(set)
    later, initials = [], []
    for spelling, g in rows:
        if _INITIALS.fullmatch(g):
            initials.append((spelling, g[0]))
            continue
        names = given.get(g) or tuple(dict.fromkeys(n for w in _fuzzy(g, given, 3) for n in given[w]))
        if names == (g,) or not names:
            full[g].add(spelling)
        elif g in given and len(names) == 1:
            full[names[0]].add(spelling)
        else:
            later.append((spelling, g, names))
    for g in sorted(g for g in full if g not in given):  # unknown names: one edit apart is the same
        close = [x for x in full if x != g and _fuzzy(g, [x])]
        if close:
            full[min(close)] |= full.pop(g)
    for spelling, g, names in later:
        present = [n for n in names if n in full]
        full[(present or names)[0] if len(present) < 2 else g].add(spelling)
    loose: dict[str, set[str]] = defaultdict(set)
    for spelling, i in initials:
        fits = [n for n in full if n[0] == i]
        (full[fits[0]] if len(fits) == 1 else loose[i]).add(spelling)
    return [sorted(x) for x in [*full.values(), *loose.values()]]


# Abbreviations that are also written without a full stop.
UNDOTTED = frozenset("assn assoc bros corp dept grp hldgs inst intl labs mfg univ wks".split())


def _abbreviates(short: str, word: str) -> bool:
    """The letters of an abbreviation occur in the word in this order, from its first letter."""
    s = short.rstrip(".").replace(".", "")
    if not (short.endswith(".") or short in UNDOTTED) or len(s) < 2 or len(s) >= len(word) or s[0] != word[0]:
        return False
    letters = iter(word)
    return all(c in letters for c in s)


def _same_words(a: list[str], b: list[str]) -> bool:
    """Each word of one side has its own counterpart on the other, in any order."""
    if len(a) != len(b):
        return False
    left = list(b)
    for w in sorted(a, key=lambda w: (w.endswith("."), w)):
        match = next((x for x in left if x == w), None) or next((x for x in left if _abbreviates(w, x) or _abbreviates(x, w) or (x.rstrip(".") == w.rstrip(".")) or _fuzzy(w, [x])), None)
        if match is None:
            return False
        left.remove(match)
    return True


def _organisations(rows: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of spellings of a block by (spelling, other words)."""
    full: list[tuple[list[str], set[str]]] = []
    by_words: dict[tuple[str, ...], set[str]] = defaultdict(set)
    shortened, initials = [], []
    for spelling, rest in rows:
        words = rest.split()
        if len(words) == 1 and regex.fullmatch(r"(?:\p{L}\.){2,}|\p{L}{2,3}", words[0]) and len(words[0].replace(".", "")) > 1:
            initials.append((spelling, "".join(sorted(words[0].replace(".", "")))))
        elif any(w.endswith(".") or w in UNDOTTED for w in words):
            shortened.append((spelling, words))
        else:
            by_words[tuple(sorted(words))].add(spelling)
    for words, spellings in sorted(by_words.items()):
        home = next((g for g in full if _same_words(g[0], list(words))), None)
        if home:
            home[1].update(spellings)
        else:
            full.append((list(words), set(spellings)))
    loose: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for spelling, words in shortened:
        homes = [g for g in full if _same_words(words, g[0])]
        (homes[0][1] if len(homes) == 1 else loose[tuple(sorted(words))]).add(spelling)
    for spelling, letters in initials:
        homes = [g for g in full if "".join(sorted(w[0] for w in g[0])) == letters]
        (homes[0][1] if len(homes) == 1 else loose[(letters,)]).add(spelling)
    return [sorted(g) for g in [*[s for _, s in full], *loose.values()]]


def _group(batches):
    """Rows sorted by block -> (spelling, entity); the entity is named by block and its smallest spelling."""
    given = short_forms()
    block, rows = None, []

    def flush():
        if not rows:
            return [], []
        groups = _persons(rows, given) if block[0] == "PERSON" else _organisations(rows)
        named = [(s, f"{block[0]}|{block[1]}|{g[0]}") for g in groups for s in g]
        return [s for s, _ in named], [e for _, e in named]

    for b in batches:
        a, e = [], []
        for k, i, s, r in zip(*(b.column(c).to_pylist() for c in ("kind", "block", "spelling", "rest"))):
            if (k, i) != block:
                x, y = flush()
                a += x
                e += y
                block, rows = (k, i), []
            rows.append((s, r))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(e, pa.string())], names=["spelling", "entity"])
    a, e = flush()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(e, pa.string())], names=["spelling", "entity"])


def spellings(mentions: DataFrame, tokens: str = "tokens", kind: str = "type", tags: str = "ner") -> DataFrame:
    """(typed, spelling, kind) of the distinct name spellings.

    ``typed`` is the spelling as it stands: the tokens joined by blanks, without a
    final "'s".  ``spelling`` is the same trimmed and in lower case, which is what
    variants are compared by; kind is PERSON or ORG, by the tag that most tokens
    of all mentions of it have.  Null and empty token lists and names of other
    kinds are left out.
    """
    t = F.col(tokens)
    core = F.when(F.element_at(t, -1) == "'s", F.slice(t, 1, F.size(t) - 1)).otherwise(t)
    count = lambda tag: F.coalesce(F.size(F.filter(F.col(tags), lambda x: F.upper(x) == tag)), F.lit(0))
    named = mentions.filter((F.upper(F.trim(F.col(kind))) == "NAM") & (F.size(t) > 0)).select(F.array_join(core, " ").alias("typed"), F.greatest(count("PERSON"), F.lit(0)).alias("p"), F.greatest(count("ORG"), F.lit(0)).alias("o"))
    each = named.groupBy("typed").agg(F.sum("p").alias("p"), F.sum("o").alias("o")).withColumn("spelling", F.lower(F.trim("typed"))).filter("spelling <> ''")
    folded = each.groupBy("spelling").agg(F.sum("p").alias("p"), F.sum("o").alias("o"), F.collect_list("typed").alias("typed"))
    kinds = F.when((F.col("p") > 0) & (F.col("p") >= F.col("o")), "PERSON").when(F.col("o") > 0, "ORG")
    return folded.select(F.explode("typed").alias("typed"), "spelling", kinds.alias("kind")).filter("kind IS NOT NULL")


def entities(found: DataFrame, **grid) -> DataFrame:
    """(spelling, entity) of the spellings that can be read as a name; ``found`` has ``spelling`` and ``kind``, each spelling once."""
    # stated numbers of partitions: adaptive execution would merge few bytes, however much there is to compute on them
    n = 2 * found.sparkSession.sparkContext.defaultParallelism
    parsed = write_table(found.repartition(n, "spelling").mapInArrow(_parse, "spelling string, kind string, anchor string, rest string"), "parsed")
    close = neighbour_words(parsed.select("anchor").distinct(), "anchor")
    # blocks are named by a hash; should two collide, their spellings are still told apart by their words
    links = connected_components(close.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst")), **grid)
    own = F.xxhash64("anchor")
    blocked = parsed.withColumn("vertex", own).join(links, "vertex", "left").select("kind", F.coalesce("component", "vertex").alias("block"), "spelling", "rest")
    return blocked.repartition(n, "kind", "block").sortWithinPartitions("kind", "block").mapInArrow(_group, "spelling string, entity string").distinct()


def spelling_pairs(mentions: DataFrame, **grid) -> DataFrame:
    """(spelling_a, spelling_b), a before b by code points: different spellings, as typed, of one person or organisation, each pair once.

    Spellings that differ only in letter case are different.
    """
    typed = write_table(spellings(mentions), "typed")
    e = entities(typed.select("spelling", "kind").distinct(), **grid)
    e = write_table(e.join(typed.select("spelling", "typed"), "spelling").select("entity", "typed"), "entities")
    a, b = e.select("entity", F.col("typed").alias("spelling_a")), e.select("entity", F.col("typed").alias("spelling_b"))
    return a.join(b, "entity").filter("spelling_a < spelling_b").select("spelling_a", "spelling_b").distinct()
