"""Queries that count over pairs don't build them, and give what their SQL gives."""

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__
from spanmill.functions import features as X
from spanmill.operators import counts
from spanmill.plans import inventory, links



def _no_pairs(*_, **__):
    raise AssertionError("the pairs of a whole document are built")


def _oracle(name, folder=DATA):
    con = duckdb.connect()
    for t in ("mentions", "tokens"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    return rel.columns, rel.fetchall()


def _same(spark, name, folder=DATA):
    columns, rows = _oracle(name, folder)
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, folder).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert got


def test_before_adds_up_over_blocks(spark):
    rows = [("d", i, i % 3) for i in (1, 2, 5, 7, 8, 20)] + [("e", 4, 1)]
    df = spark.createDataFrame(rows, "doc_id string, i int, v int")
    got = {(r[0], r[1]): (r[3], r[4]) for r in counts.before(df, ["doc_id"], "i", {"s": df["v"]}, latest="last", block=4).collect()}
    for d, i, _ in rows:
        earlier = [(j, v) for e, j, v in rows if e == d and j < i]
        assert got[d, i] == (sum(v for _, v in earlier), max((j for j, _ in earlier), default=None))


@pytest.mark.parametrize("name", ["acronym_alias", "candidate_pairs_ranking", "candidate_pairs_train"])
def test_no_pairs_in_links(spark, monkeypatch, name):
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    _same(spark, name)


@pytest.mark.parametrize("name", ["coreference_agreement", "listed_relations"])
def test_no_pairs_in_inventory(spark, monkeypatch, name):
    monkeypatch.setattr(inventory, "backward_pairs", _no_pairs, raising=False)
    _same(spark, name)


def test_aliases_are_those_of_the_whole_rule(spark):
    heads = [[], ["IBM"], ["I.B.M."], ["Int", "Business", "Machines"], ["International", "Business", "Machines", "Corp"], ["Int"], ["Int", None], ["int"], ["Mr.", "Smith"], ["John", "Smith"], ["Smith"], ["J.", "A.", "Smith"], ["John", "A.", "Smyth"], ["Ann", "Smith"]]
    names = spark.createDataFrame([("d", k, h) for k in ("PERSON", "ORG", "LOC") for h in heads], "doc_id string, kind string, head array<string>")
    mention = F.struct("head", F.array("kind").alias("ner"), F.lit(0).alias("head_index"), F.lit("NAM").alias("type"))
    sides = names.select("kind", mention.alias("ana")).join(names.select("kind", mention.alias("ante")), "kind")
    whole = sides.filter(X.alias(X.pair_getter("ana"), X.pair_getter("ante"))).select("kind", "ana.head", F.col("ante.head").alias("other"))
    got = sorted(map(repr, links._aliases(names).select("kind", "head", "other").collect()))
    assert got == sorted(map(repr, whole.collect()))
    assert len(got) > 20


def test_no_pairs_of_speakers(spark, monkeypatch):
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    _same(spark, "speaker_relation")


def test_no_pairs_of_strings(spark, monkeypatch):
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    _same(spark, "pair_features_string")


def test_parts_of_strings(spark):
    texts = ["", "i", "it", "with", "white", "hit", "a b", "b a b", "ab", "abcdefghi", "xabcdefghij", "\u00e9t\u00e9", "l'\u00e9t\u00e9"]
    s = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(r) for r in counts.containing(s, s).collect()]
    assert sorted(got) == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if x in y)


def test_related_items_before(spark):
    items = [("d", i, i % 3 if i % 7 else None) for i in range(1, 30)] + [("e", i, 2) for i in range(1, 4)]
    rows = spark.createDataFrame(items, "doc_id string, mention_idx int, item int")
    relation = [(0, 1), (1, 1), (2, 0)]
    got = {(r[0], r[1]): r[2] for r in counts.related_before(rows, rows, spark.createDataFrame(relation, "item int, other int")).collect()}
    for d, i, x in items:
        assert got.get((d, i), 0) == sum(e == d and j < i and (x, y) in relation for e, j, y in items)


def test_mentions_of_an_entity_are_blocked_by_their_place(spark, monkeypatch):
    seen = []
    whole = links.backward_pairs

    def recorded(m, columns, **how):
        seen.append(m.agg(F.max(how.get("idx", "mention_idx"))).first()[0] < m.agg(F.max("mention_idx")).first()[0])
        return whole(m, columns, **how)

    monkeypatch.setattr(links, "backward_pairs", recorded)
    _same(spark, "feature_assembly")
    assert seen == [True]


@pytest.mark.parametrize("block", [4, 256])
def test_distances_without_far_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    monkeypatch.setattr(links, "BLOCK", block)
    _same(spark, "pair_features_distance")


def test_no_pairs_of_word_sets(spark, monkeypatch):
    monkeypatch.setattr(links, "backward_pairs", _no_pairs)
    _same(spark, "pair_features_overlap")


def test_long_sets_overlap_as_short_ones(spark):
    m = spark.createDataFrame([("d", i, sorted(set(w))) for i, w in enumerate(["abcdefgh", "ab", "abx", "x", "abcdefghi", "zabc", "b"], 1)], "doc_id string, mention_idx int, words array<string>")
    best = lambda short: {
        r[0]: round(r[1], 9) for r in m.join(links._first_overlaps(m, short), ["doc_id", "words"]).filter("_first < mention_idx").groupBy("mention_idx").agg(F.max("_o")).collect()
    }
    assert best(1) == best(3) == best(9) and best(9)[5] == round(8 / 9, 9)
