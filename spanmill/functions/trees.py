"""Phrase-structure trees, heads, and what mentions take from them.

A tree is a flat list of nodes with parent, label and leaf span; a node over one
word is a tag.  Pure Python: these run per sentence in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Labels that are searched for a phrase's head, in this order, and the direction (-1: from the right).
HEAD_PRIORITIES: dict[str, tuple[int, str]] = {
    "VP": (1, "TO VBD VBN MD VBZ VB VBG VBP VP ADJP NN NNS NP"),
    "ADJP": (1, "NNS QP NN $ ADVP JJ VBN VBG ADJP JJR NP JJS DT FW RBR RBS SBAR RB"),
    "QP": (1, "$ NNS NN IN JJ RB DT CD NCD QP JJR JJS"),
    "WHADVP": (-1, "CC WRB"),
    "S": (1, "TO IN VP S SBAR ADJP UCP NP"),
    "SBAR": (1, "WHNP WHPP WHADVP WHADJP IN DT S SQ SINV SBAR FRAG"),
    "SBARQ": (1, "SQ S SINV SBARQ FRAG"),
    "SQ": (1, "VBZ VBD VBP VB MD VP SQ"),
    "ADVP": (-1, "RB RBR RBS FW ADVP TO CD JJR JJ IN NP JJS NN"),
    "WHNP": (-1, "WDT WP WP$ WHADJP WHPP WHNP"),
    "PP": (-1, "IN TO VBG VBN RP FW"),
    "X": (-1, "S VP ADJP JJP NP SBAR PP X"),
    "FRAG": (-1, "*"),
    "INTJ": (1, "*"),
    "UCP": (-1, "*"),
}
PHRASES = {*HEAD_PRIORITIES, "NP", "NML"}

# For entity types, tags that open a name's head and tags that close it.
_NOUN, _CLOSE = "NN(S)?|NNP(S)?", r"CC|,|\.|:|;|V.*|IN|W.*|ADVP|NN$"
NAME_RULES: list[tuple[str, str, str]] = [
    ("ORG.*|GPE.*|FAC.*|NORP.*|PRODUCT|EVENT|MONEY|WORK_OF_ART|LOC.*|LAW|LANGUAGE", _NOUN, "V.*|IN|W.*|ADVP|,|-LRB-"),
    ("PERSON$", _NOUN, r"IN|CC|,|\.|:|;|V.*|W.*|-LRB-"),
    ("DATE|TIME", f"{_NOUN}|CD", _CLOSE),
    ("ORDINAL", "NN|JJ|RB", _CLOSE),
    ("CARDINAL", "CD", _CLOSE),
    ("QUANTITY|PERCENT", "CD|JJ|NN", _CLOSE),
    ("NONE$", f"{_NOUN}|CD", _CLOSE),
]


@dataclass
class Tree:
    """Nodes in preorder; ``end`` is inclusive, ``word`` is set for tags only."""

    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    words: list[str | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)

    def _open(self, label: str, parent: int) -> int:
        i = len(self.labels)
        for column, value in ((self.labels, label), (self.parents, parent), (self.begins, len(self.tags)), (self.ends, -1), (self.words, None), (self.children, [])):
            column.append(value)
        if parent >= 0:
            self.children[parent].append(i)
        return i

    def text(self, node: int = 0) -> str:
        """The bracketed form of a node."""
        if self.words[node] is not None:
            return f"({self.labels[node]} {self.words[node]})"
        return f"({self.labels[node]} {' '.join(map(self.text, self.children[node]))})"

    def leaves(self, node: int = 0) -> list[str]:
        return [self.words[t] for t in self.tags[self.begins[node] : self.ends[node] + 1]]

    def covering(self, begin: int, end: int) -> int:
        """The lowest node over the leaves of a span; over a single leaf the phrase of its tag."""
        node = self.tags[begin]
        while self.parents[node] >= 0 and (self.words[node] is not None or self.ends[node] < end or self.begins[node] > begin):
            node = self.parents[node]
        return node


_PIECE = re.compile(r"\(|\)|[^\s()]+")


def read_tree(text: str) -> Tree | None:
    """A tree from its bracketed form; null for text without a complete one. Empty labels are kept as ''."""
    tree, at, pending = Tree(), -1, None
    for piece in _PIECE.findall(text):
        if piece == "(":
            at = tree._open("", at)
            pending = at
        elif piece == ")":
            if at < 0:
                return None
            tree.ends[at] = len(tree.tags) - 1
            at, pending = tree.parents[at], None
            if at < 0:
                break
        elif pending is not None:
            tree.labels[at], pending = piece, None
        else:
            tree.words[at] = piece
            tree.tags.append(at)
    return tree if tree.labels and at < 0 and tree.tags else None


def assemble(bits: list[str | None], pos: list[str], tokens: list[str]) -> str:
    """The bracketed form from parse bits: '*' is the tagged token. Brackets in tokens are written -LRB- and -RRB-."""
    safe = {"(": "-LRB-", ")": "-RRB-"}
    word = lambda p, t: f" ({safe.get(p, p)} {safe.get(t, t)})"
    out = [(b or "*").replace("(", " (").replace("*", word(p or "XX", t or "-"), 1) for b, p, t in zip(bits, pos, tokens)]
    return "".join(out).strip().replace("(NOPARSE", "(S")


def head(tree: Tree, node: int, compat: bool = False) -> int:
    """The head of a node, a node again (a tag but for a conjunction that is a phrase).

    ``compat`` keeps what models were trained with: searches from the right try
    the first label only, and '$' is no label.
    """
    while True:
        kids, label = tree.children[node], tree.labels[node]
        if tree.words[node] is not None:
            return node
        if len(kids) == 1:
            node = kids[0]
            continue
        found = _noun_head(tree, node, compat) if label in ("NP", "NML") else _phrase_head(tree, node, compat) if label in HEAD_PRIORITIES else None
        if found is not None:
            return found
        node = kids[-1]


def _noun_head(tree: Tree, node: int, compat: bool) -> int | None:
    kids, label = tree.children[node], lambda k: tree.labels[k]
    search = [
        (kids, lambda x: x == "CC" and label(node) == "NP", "self"),
        (kids[::-1], lambda x: x.startswith(("NN", "JJR")) or x == "NX", "NX"),
        (kids, lambda x: x == "NP", "head"),
        (kids, lambda x: x == "NML", "head"),
        (kids, lambda x: x == "PRN", "first"),
        (kids[::-1], lambda x: x.startswith("CD"), "self"),
        (kids[::-1], lambda x: x.startswith(("JJ", "RB")) or x == "QP", "QP"),
    ]
    for order, wanted, how in search:
        k = next((k for k in order if wanted(label(k))), None)
        if k is not None:
            if how == "first":
                return head(tree, tree.children[k][0], compat) if tree.children[k] else k
            return head(tree, k, compat) if how in ("head", label(k)) else k
    return None


def _phrase_head(tree: Tree, node: int, compat: bool) -> int | None:
    way, priorities = HEAD_PRIORITIES[tree.labels[node]]
    kids, names = tree.children[node][::way], priorities.split()
    if compat:
        names = [n for n in (names if way > 0 else names[:1]) if n != "$"]
    for name in names:
        for k in kids:
            if name in ("*", tree.labels[k]):
                return head(tree, k, compat) if tree.labels[k] in PHRASES else k
    return None


def name_head(tokens: list[str], pos: list[str], ner: str, old: tuple[int, int], old_head: list[str]) -> tuple[tuple[int, int], list[str]]:
    """Span and tokens of a name's head: from the first opening tag up to a closing one.

    An entity type without a rule keeps the old head; a possessive mark at the end is left out.
    """
    if not pos:
        return (0, 0), ["NOHEAD"]
    rule = next(((a, b) for kind, a, b in NAME_RULES if re.match(kind, ner)), None)
    if rule is None:
        return old, old_head
    first = next((i for i, p in enumerate(pos) if re.match(rule[0], p)), None)
    if first is not None:
        stop = next((i for i in range(first + 1, len(pos)) if re.match(rule[1], pos[i])), None)
        if stop is not None:
            return (first, stop - 1), tokens[first:stop]
    last = len(pos) - (2 if pos[-1] == "POS" and len(pos) > 1 else 1)
    return (first or 0, last), tokens[first or 0 : last + 1]


def is_apposition(tree: Tree, node: int, compat: bool = False) -> bool | None:
    """Whether a noun phrase is 'NP NP', 'NP , NP' or 'NP , NP ,' with a name in it; null for other shapes."""
    kids = tree.children[node]
    if tree.labels[node] != "NP" or len(kids) not in (2, 3, 4):
        return None
    shape = [tree.labels[k] for k in kids]

    def named(k: int) -> bool:
        h = head(tree, k, compat)
        return tree.labels[tree.tags[tree.begins[h]]].startswith("NNP")

    if len(kids) == 2:
        return shape == ["NP", "NP"] and named(kids[1])
    if shape != ["NP", ",", "NP", ","][: len(kids)]:
        return False
    return any(map(named, kids)) and any(tree.labels[tree.tags[tree.begins[k]]] == "DT" for k in kids)


def head_information(tree: Tree, node: int, tokens: list[str], pos: list[str], ner: list[str], compat: bool = False) -> tuple[list[str], tuple[int, int], int]:
    """(head tokens, span of the head in the mention, index of the head's last token)."""
    at, found = 0, [tokens[0]]
    if tree.ends[node] - tree.begins[node] + 1 == len(tokens):
        h = head(tree, node, compat)
        word = tree.words[tree.tags[tree.begins[h]]]
        at = max((i for i, t in enumerate(tree.leaves(node)) if t == word), default=0)
        found = [tokens[at]]
    place = (at, at)
    if pos[at].startswith("NNP"):
        place, found = name_head(tokens, pos, ner[at], place, found)
    index = place[1]
    if is_apposition(tree, node, compat):
        kids = tree.children[node]
        size = lambda k: tree.ends[k] - tree.begins[k] + 1
        if len(kids) == 2:
            place = (size(kids[0]), len(tokens) - 1)
            return tree.leaves(kids[1]), place, place[1]
        start = 0
        for k in kids:
            if tree.labels[tree.tags[tree.begins[head(tree, k, compat)]]].startswith("NNP"):
                end = min(start + size(k), len(tokens))
                (a, b), found = name_head(tokens[start:end], pos[start:end], ner[end - 1], (place[0] - start, place[1] - start), found)
                return found, (a + start, b + start), end - 1
            start += size(k)
    return found, place, index


def noun_phrases(tree: Tree) -> list[tuple[int, int]]:
    """Spans of noun phrases and possessive pronouns."""
    return sorted({(tree.begins[i], tree.ends[i]) for i, x in enumerate(tree.labels) if x in ("NP", "PRP$")})
