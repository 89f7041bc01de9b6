"""Relations are counted as all pairs would have them, without the pairs."""

import random

from pyspark.sql import functions as F
from test_counts import _no_pairs, _same
from test_pairs_and_rules import SCHEMA, m

from spanmill.functions import rules
from spanmill.operators import resolve
from spanmill.operators.pairs import backward_pairs
from spanmill.operators.counts import aliases
from spanmill.operators.relation_counts import aliased, relation_counts
from spanmill.plans import links

NAMES = [n for n in (*rules.NEGATIVE, *rules.POSITIVE, "pronoun_parallelism") if n not in ("not_singleton", "lexical", "speaker")]


def _odd(n: int = 260) -> list[tuple]:
    """Sentences out of order, spans that end before they begin or lack a part, indices that occur twice, nulls, 'and'."""
    r = random.Random(5)
    texts = [("Mr. Smith", "NNP NNP", "NAM", "Smith", "PERSON"), ("John Smith", "NNP NNP", "NAM", "John Smith", "PERSON"), ("IBM", "NNP", "NAM", "IBM", "ORG"), ("I.B.M.", "NNP", "NAM", "I.B.M.", "ORG"), ("Int Business Machines", "NNP NNP NNP", "NAM", "Int Business Machines", "ORG"),
             ("the old company", "DT JJ NN", "NOM", "company", "NONE"), ("the big old company", "DT JJ JJ NN", "NOM", "company", "NONE"), ("a company", "DT NN", "NOM", "company", "NONE"), ("the", "DT", "NOM", "the", "NONE"), ("Smith and", "NNP CC", "NOM", "and", "NONE"), ("And", "CC", "NAM", "And", "NONE")]
    out = []
    for i in range(n):
        text, pos, kind, head, ner = r.choice(texts)
        begin, more = r.randrange(60), dict(speaker=r.choice(["-", "a", "b", "John_Smith", None]), gender=r.choice(["MALE", "FEMALE", "UNKNOWN", None]), number=r.choice(["SINGULAR", "PLURAL"]), semantic_class=r.choice(["PERSON", "NUMERIC", None]), grammatical_function=r.choice(["SUBJECT", "OBJECT", "OTHER", None]))
        if i % 3 == 0:
            text = head = r.choice(["it", "he", "i", "you", "we"])
            pos, kind, ner = "PRP", "PRO", "NONE"
            more |= dict(citation_form=r.choice([text, text, None]), fine_type=r.choice(["PERS_NOM", "REFL", "POSS"]))
        elif kind == "NOM":
            more |= dict(fine_type=r.choice(["DEF", "INDEF", None]))
        if i % 17 == 0:
            more |= dict(type=r.choice([None, "DEM", "VRB"]))
        if i % 13 == 0:
            more |= dict(span=r.choice([None, (begin, None), (begin, begin - 3)]))
        at = i // 2 if i % 29 == 1 else i
        out.append((i, *m(at, text, pos, kind, begin, r.choice([i // 4, i // 4, i // 4, r.randrange(60), None]), head, ner, doc=r.choice("dde"), **more)))
    return out


def test_relations_of_odd_rows(spark):
    rows = spark.createDataFrame([*_odd(), (1000, *m(1, "alone", "NN", "NOM", 0, doc="f"))], f"mention_id int, {SCHEMA}")
    rows = rules.with_rule_columns(rows).localCheckpoint()
    assert rows.groupBy("doc_id", "mention_idx").count().filter("count > 1").count()
    every = {**rules.NEGATIVE, **rules.POSITIVE, "pronoun_parallelism": rules.pronoun_parallelism}
    p = backward_pairs(rows.withColumn("singleton_count", F.lit(None).cast("int")), resolve.COLUMNS)
    want = {r[0]: r.asDict() for r in p.groupBy("doc_id").agg(*[F.count(F.when(every[n](), 1)).alias(n) for n in NAMES]).collect()}
    got = {r[0]: r.asDict() for r in relation_counts(rows, NAMES).collect()}
    assert {(d, n): (got[d][n], want[d][n]) for d in want for n in NAMES if got[d][n] != want[d][n]} == {}
    assert set(got) == set(want) == {"d", "e"}
    assert all(any(got[d][n] for d in got) for n in NAMES)
    again = rows.unionByName(rows.filter("mention_idx % 5 = 0")).withColumn("_row", F.xxhash64("mention_id"))
    assert {r[0]: r.asDict() for r in relation_counts(again, NAMES).collect()} == want


def test_aliases_of_a_document(spark):
    heads = [[], ["IBM"], ["I.B.M."], ["Int", "Business", "Machines"], ["International", "Business", "Machines", "Corp"], ["Int"], ["."], ["int"], ["Mr.", "Smith"], ["John", "Smith"], ["Smith"], ["J.", "A.", "Smith"], ["John", "A.", "Smyth"], ["Ann", "Smith"], ["John", "Smith", "Co"]]
    names = [(d, k, h, " ".join(h).lower()) for d in (0, 1) for k in ("PERSON", "ORG", "LOC") for h in heads]
    got = sorted((d, k, names[j][2], h) for (d, k, h, _), near in zip(names, aliased(names)) for j in near)
    df = spark.createDataFrame([(str(d), k, h) for d, k, h, _ in names], "doc_id string, kind string, head array<string>")
    assert got == sorted((int(r[0]), r[1], list(r[2]), list(r[3])) for r in aliases(df).collect())
    assert len(got) > 40


def test_no_pairs_of_relations(spark, monkeypatch):
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    _same(spark, "rule_edges")
