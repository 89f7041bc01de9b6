import random

import pytest

from spanmill.llm import names
from spanmill.llm.given_names import short_forms


def edits(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def words(n=150):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    return sorted({*base, *[w[:2] + w[3:] for w in base[:40]], *[w[:1] + w[2:3] + w[1:2] + w[3:] for w in base[40:80]]})


def test_automaton_and_trie_match_brute_force():
    ws = words(60)
    trie = names.Trie(ws)
    for w in ws:
        assert set(trie.neighbours(w)) == {x for x in ws if edits(w, x) <= 1} == {x for x in ws if names.within_one(w, x)}


def test_trie_join_matches_brute_force(spark):
    ws = [w for w in words() if len(w) >= names.ANCHOR_FUZZY]
    df = spark.createDataFrame([(w,) for w in ws + ws[:5] + ["abc", None]], "word string")
    got = {tuple(r) for r in names.neighbour_words(df).collect()}
    assert got == {(a, b) for a in ws for b in ws if a < b and edits(a, b) <= 1}
    assert names.neighbour_words(spark.createDataFrame([], "word string")).count() == 0


@pytest.mark.parametrize(
    "spelling, want",
    [
        ("patrick somomoaro", ("somomoaro", "patrick")), ("somomoaro patrick", ("somomoaro", "patrick")), ("somomoaro , patrick", ("somomoaro", "patrick")), ("dr. p. somomoaro", ("somomoaro", "p.")),
        ("p.somomoaro", ("somomoaro", "p.")), ("somomoaro , p.", ("somomoaro", "p.")), ("patrick j. somomoaro", ("somomoaro", "patrick")), ("mr. patrick somomoaro", ("somomoaro", "patrick")), ("patrick somómoaro", ("somomoaro", "patrick")),
    ],
)
def test_person_readings(spelling, want):
    assert names.parse_person(spelling, short_forms())[0] == want


def test_bare_names_have_no_reading():
    assert names.parse_person("somomoaro", short_forms()) == [] and names.parse_person("", short_forms()) == [] and names.parse_organisation("x") == []


def mention(text, tag, kind="NAM"):
    t = text.split()
    return (t, [tag] * len(t), kind, 1)


def test_pairs(spark):
    people = ["Patrick Somomoaro", "patrick somomoaro", "Somomoaro Patrick", "Paddy Somomoaro", "PATRICK Somommoaro 's", "P. Somomoaro", "Margaret Somomoaro Unknown", "Susan Bubekist", "Margaret Bubekist", "S. Bubekist"]
    firms = ["Dilamoux Vehicle Group", "Dilamoux Vehicel Group", "Dilamoux Group , Vehicle", "Group of Dilamoux Vehicle", "Dilamoux V.G.", "Dilamoux Vehicle Grp.", "Dilamoux Vehicle Group Ltd.", "Dilamoux Cotton Institute"]
    rows = [mention(p, "PERSON") for p in people] + [mention(f, "ORG", " nam ") for f in firms] + [mention("Port Tovastad", "GPE"), mention("Port Tovasatd", "GPE"), mention("he", "NONE", "PRO")]
    rows += rows[:4] + [(None, None, "NAM", 1), ([], [], "NAM", 1), (["x"], None, None, 1), (["Zed Zad"], [None], "NAM", 1), mention("ZED ZAD", "PERSON"), (["Zed", "Zad"], None, "NAM", 1)]
    df = spark.createDataFrame(rows, "tokens array<string>, ner array<string>, type string, entity int")
    got = {tuple(r) for r in names.spelling_pairs(df).collect()}
    of = lambda group: {tuple(sorted((a, b))) for a in group for b in group if a != b}
    patrick = ["Patrick Somomoaro", "patrick somomoaro", "Somomoaro Patrick", "Paddy Somomoaro", "PATRICK Somommoaro", "P. Somomoaro"]
    group = ["Dilamoux Vehicle Group", "Dilamoux Vehicel Group", "Dilamoux Group , Vehicle", "Dilamoux V.G.", "Dilamoux Vehicle Grp.", "Dilamoux Vehicle Group Ltd."]
    assert of(patrick) | of(["Susan Bubekist", "S. Bubekist"]) | of(group) | {("ZED ZAD", "Zed Zad")} <= got
    assert not any("Margaret Bubekist" in p and "Susan Bubekist" in p for p in got) and not any("Tovas" in p[0] for p in got)
    assert not any("Dilamoux Cotton Institute" in p for p in got)
    assert names.spelling_pairs(df.limit(0)).count() == 0
