import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanmill.functions import attributes as A
from spanmill.functions import features as X
from spanmill.functions import rules
from spanmill.operators import analysis, cluster, context, decode, learn, pipeline, resolve
from spanmill.operators.pairs import backward_pairs, nothing_between, ranked, training_pairs, with_speakers_ahead
from spanmill.plans import links

SCHEMA = (
    "doc_id string, mention_idx int, span struct<begin:int,end:int>, sent_id int, tokens array<string>, pos array<string>, ner array<string>, head array<string>, head_span struct<begin:int,end:int>, head_index int, "
    "type string, fine_type string, citation_form string, number string, gender string, semantic_class string, grammatical_function string, speaker string, governor string, deprel string, ancestry string, "
    "annotated_set_id int, first_in_gold_entity boolean, head_as_lowercase_string string, tokens_as_lowercase_string string"
)


def m(i, text, pos, kind, begin, sent=0, head=None, ner="NONE", entity=None, doc="d", **more):
    tokens = text.split()
    h = (head or tokens[-1]).split()
    at = next(k for k in range(len(tokens)) if tokens[k : k + len(h)] == h)
    row = dict(
        doc_id=doc, mention_idx=i, span=(begin, begin + len(tokens) - 1), sent_id=sent, tokens=tokens, pos=pos.split(), ner=[ner] * len(tokens), head=h, head_span=(begin + at, begin + at + len(h) - 1), head_index=at + len(h) - 1,
        type=kind, fine_type=None, citation_form=None, number="SINGULAR", gender="UNKNOWN", semantic_class="UNKNOWN", grammatical_function="OTHER", speaker="-", governor="x", deprel="y", ancestry="z",
        annotated_set_id=entity, first_in_gold_entity=False, head_as_lowercase_string=" ".join(h).lower(), tokens_as_lowercase_string=text.lower(),
    )
    row.update(more)
    return tuple(row[c] for c in [x.split(" ")[0] for x in SCHEMA.replace("struct<begin:int,end:int>", "s").split(", ")])


def story(spark):
    rows = [
        m(1, "Mr. Smith", "NNP NNP", "NAM", 0, 0, "Smith", "PERSON", 1, gender="MALE", semantic_class="PERSON", grammatical_function="SUBJECT"),
        m(2, "the old company", "DT JJ NN", "NOM", 3, 0, entity=2, fine_type="DEF", gender="NEUTRAL", semantic_class="OBJECT", grammatical_function="OBJECT"),
        m(3, "he", "PRP", "PRO", 8, 1, entity=1, fine_type="PERS_NOM", citation_form="he", gender="MALE", semantic_class="PERSON", grammatical_function="SUBJECT"),
        m(4, "the company", "DT NN", "NOM", 10, 1, entity=2, fine_type="DEF", gender="NEUTRAL", semantic_class="OBJECT"),
        m(5, "John Smith", "NNP NNP", "NAM", 14, 2, "John Smith", "PERSON", 1, gender="MALE", semantic_class="PERSON"),
        m(6, "it", "PRP", "PRO", 18, 4, fine_type="PERS_NOM", citation_form="it", gender="NEUTRAL", semantic_class="OBJECT"),
        m(1, "it", "PRP", "PRO", 0, 0, doc="e", fine_type="PERS_NOM", citation_form="it"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def pairs_of(df):
    return {(r["doc_id"], r["ana_idx"], r["ante_idx"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_backward_pairs(spark, block):
    df = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 1), (None, 1), ("c", None)], "doc_id string, mention_idx int")
    got = backward_pairs(df, [], dummy=True, block=block)
    assert got.count() == len(pairs_of(got)) and pairs_of(got) == {("a", i, j) for i in range(1, 8) for j in range(i)} | {("b", 1, 0)}
    assert ("a", 3, 1) not in pairs_of(backward_pairs(df, [], least=2, block=block))
    assert backward_pairs(df.limit(0), [], dummy=True).count() == 0
    assert {r["rank"] for r in ranked(got).filter("ante_idx = ana_idx - 1").collect()} == {0}


def test_training_pairs(spark):
    df = spark.createDataFrame([("d", i, e) for i, e in enumerate([None, 5, 6, 5, None, 5, 0, 0], 0)], "doc_id string, mention_idx int, e int")
    p = backward_pairs(df, ["e"])
    assert pairs_of(training_pairs(p, "e")) == {("d", 2, 1), ("d", 3, 1), ("d", 3, 2), ("d", 5, 3), ("d", 5, 4), ("d", 7, 6)} | {("d", 6, j) for j in range(1, 6)}
    assert not {x for x in pairs_of(training_pairs(p, "e", zero_is_none=True)) if x[1] > 5}


def test_rules_resolve_the_story(spark):
    best = {(r["doc_id"], r["ana_idx"]): r["ante_idx"] for r in resolve.best_antecedents(resolve.edges(story(spark))).collect()}
    assert best[("d", 3)] == 1 and best[("d", 4)] == 2 and ("d", 6) not in best and ("e", 1) not in best
    assert best[("d", 5)] == 1  # alias
    kept = resolve.edges(story(spark), keep_negative=True)
    ruled_out = {(r["ana_idx"], r["ante_idx"]): r["neg_rel"] for r in kept.filter("size(neg_rel) > 0").collect()}
    assert "not_pronoun_distance" in ruled_out[6, 2] and "not_compatible" in ruled_out[3, 2]
    assert all(r["weight"] == float("-inf") for r in kept.filter("size(neg_rel) > 0").collect())
    assert not {x for x in pairs_of(resolve.edges(story(spark), fix_first_mention=False)) if x[2] == 1}
    got = {(r["mention_idx"], r["entity_id"]) for r in resolve.entities(resolve.best_antecedents(resolve.edges(story(spark)))).collect()}
    assert got == {(1, 1), (3, 1), (5, 1), (2, 2), (4, 2)}


def test_listed_pairs_make_edges(spark):
    listed = spark.createDataFrame([("mr. smith", "the company")], "lo string, hi string")
    rows = resolve.edges(story(spark), negative={}, positive={"lexical": rules.lexical}, listed=listed).filter("weight > 0").collect()
    assert [(r["ana_idx"], r["ante_idx"], r["pos_rel"]) for r in rows] == [(4, 1, ["lexical"])]


def test_speakers(spark):
    who = [("i", "A", 0), ("you", "B", 2), ("i", "A", 4), ("i", "B", 6)]
    rows = [m(k, w, "PRP", "PRO", b, 0, citation_form=w, speaker=s) for k, (w, s, b) in enumerate(who, 1)] + [m(5, "Ann Bell", "NNP NNP", "NAM", 8, 0, "Ann Bell"), m(6, "i", "PRP", "PRO", 11, 0, citation_form="i", speaker="Ann_Bell")]
    t = spark.createDataFrame([("d", i, "A" if i < 2 else "B" if i < 4 else "C" if i == 5 else "A") for i in range(12)], "doc_id string, tok_idx int, speaker string")
    df = with_speakers_ahead(spark.createDataFrame(rows, SCHEMA), t).withColumn("singleton_count", F.lit(None).cast("int"))
    p = backward_pairs(rules.with_rule_columns(df), [*resolve.COLUMNS, "speakers_ahead"]).withColumn("nothing_between", nothing_between())
    got = {(r["ana_idx"], r["ante_idx"]): (r["a"], r["b"]) for r in p.select("ana_idx", "ante_idx", rules.speaker().alias("a"), rules.not_speaker().alias("b")).collect()}
    assert got[2, 1] == (True, False) and got[3, 1] == (True, False) and got[4, 1] == (False, True) and got[6, 5] == (True, False)
    assert got[4, 2] == (False, True)


@pytest.mark.parametrize("block", [3, 8_192])
def test_third_speakers_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(context.islands, "__defaults__", (block,))
    rng = random.Random(5)
    said = {d: [rng.choice(who) for _ in range(n)] for d, who, n in (("a", ["A", "B"], 9), ("b", ["A", "B", None, "C"], 14), ("c", ["A", "A", "A", "B", "B", "D"], 24), ("d", ["A"], 4))}
    t = spark.createDataFrame([(d, i, s) for d, who in said.items() for i, s in enumerate(who)], "doc_id string, tok_idx int, speaker string")
    rows = [(d, k, (b, min(b + k % 2, len(who) - 1)), "PRO", rng.choice([who[b], who[b], None])) for d, who in said.items() for k, b in enumerate(rng.sample(range(len(who)), len(who)), 1)]
    df = spark.createDataFrame(rows, "doc_id string, mention_idx int, span struct<begin:int,end:int>, type string, speaker string")
    p = backward_pairs(with_speakers_ahead(df, t), ["span", "type", "speaker", "speakers_ahead"])
    n = 0
    for r in p.withColumn("new", nothing_between()).collect():
        who, a, b = said[r["doc_id"]], r["ana"], r["ante"]
        two = [x["speaker"] or who[x["span"]["begin"]] for x in (a, b)]
        want = all(s in two for s in who[min(a["span"]["begin"], b["span"]["begin"]) : max(a["span"]["end"], b["span"]["end"]) + 1])
        assert r["new"] == want, r
        n += not want
    assert n > 50


@pytest.mark.parametrize("name", ["rule_antecedent", "rule_clusters"])
def test_queries_see_third_speakers(spark, monkeypatch, name):
    rows = [m(1, "i", "PRP", "PRO", 0, citation_form="i", speaker="A"), m(2, "you", "PRP", "PRO", 2, citation_form="you", speaker="B"), m(3, "you", "PRP", "PRO", 5, citation_form="you", speaker="D")]
    t = spark.createDataFrame([("d", i, s) for i, s in enumerate("AABBCD")], "doc_id string, tok_idx int, speaker string")
    monkeypatch.setattr(links, "mentions", lambda s, sf, *columns: spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(links, "tokens", lambda s, sf, *columns: t)
    got = {tuple(r)[1:3] for r in links.QUERIES[name](spark, "").collect()}
    assert got == ({(2, 1)} if name == "rule_antecedent" else {(1, 1), (2, 1)})


def values(spark, expression, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    return df.select(expression(F.col("a"), F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, want", [("International Business Machines", "IBM", True), ("Bank Corp", "Bank", True), ("New York", "New Jersey", False), ("U.S.", "US", True), ("IBM", "Intel", False), ("International Business Machines", "I.B.M.", True)])
def test_abbreviations(spark, a, b, want):
    rule = lambda x, y: X.starts_with(x, y) | X.is_abbreviation(x, y)
    assert values(spark, rule, a.split(), b.split()) is want and values(spark, rule, b.split(), a.split()) is want


@pytest.mark.parametrize("a, b, want", [("Barack Obama", "Obama", True), ("Mr. Obama", "Barack Obama", True), ("Ann Obama", "Barack Obama", False), ("George W. Bush", "George Bush", True), ("Bush", "Obama", False)])
def test_person_alias(spark, a, b, want):
    assert values(spark, X.person_alias, a.split(), b.split()) is want


def test_feature_strings(spark):
    p = pipeline.arcs(story(spark), "latent", True, ["fine_type", "number"], ["head_match", "sentence_distance", "relative_overlap"], hashing=lambda s: F.transform(s, lambda x: F.length(x)))
    rows = {(r["ana_idx"], r["ante_idx"]): r for r in p.filter("doc_id = 'd'").collect()}
    n = 2 + 2 + 2 + 2
    assert len(rows[4, 2]["feats"]) == n + 3 * (n - 3) and len(rows[4, 2]["num_feats"]) == 4 and rows[4, 2]["num_feats"][0]["val"] == pytest.approx(2 / 3)
    assert rows[4, 0]["feats"] == [] and rows[4, 0]["cost"] == 2 and rows[4, 2]["cost"] == 0 and rows[4, 1]["cost"] == 1
    m2 = rules.with_rule_columns(story(spark)).withColumns({"preceding_token": F.lit(None).cast("string"), "next_token": F.lit(None).cast("string")}).withColumn("feature_values", X.mention_values(["fine_type"]))
    s = backward_pairs(m2, pipeline.FIELDS).filter("ana_idx = 4 AND ante_idx = 2").select(X.feature_strings(["fine_type"], ["head_match"]).alias("s")).first()["s"]
    assert s == ["ana_fine_type=DEF", "ante_fine_type=DEF", "ana_fine_type=DEF^ante_fine_type=DEF", "head_match=True", "ana_fine_type=DEF^head_match=True", "ante_fine_type=DEF^head_match=True", "ana_fine_type=DEF^ante_fine_type=DEF^head_match=True"]


def test_all_features_of_all_pairs(spark, monkeypatch):
    rows = [r.asDict() for r in story(spark).collect()]
    monkeypatch.setattr(links, "mentions", lambda s, sf, *columns: story(s))
    yes = lambda n, x: [f"{n}=True"] if x else []

    def values(x):
        return [{"NOM": x["fine_type"], "PRO": x["citation_form"]}.get(x["type"], x["type"]), x["gender"], x["number"], x["semantic_class"], x["head_as_lowercase_string"]]

    def strings(a, b):
        names = ["fine_type", "gender", "number", "sem_class", "head"]
        own, other = ([f"{k}_{n}={v}" for n, v in zip(names, values(x), strict=True)] for k, x in (("ana", a), ("ante", b)))
        t, u, h, i = (x[f"{k}_as_lowercase_string"] for k in ("tokens", "head") for x in (a, b))
        far = a["sent_id"] - b["sent_id"]
        plain = own + other + [f"{x}^{y}" for x, y in zip(own, other, strict=True)]
        plain += yes("exact_match", t == u) + yes("head_match", h == i) + yes("same_speaker", a["speaker"] == b["speaker"]) + [f"sentence_distance={'>=5' if far >= 5 else far}"] + yes("tokens_contained", t in u or u in t)
        return plain + [f"{plain[k]}^{x}" for k in (0, 5, 10) for j, x in enumerate(plain) if j not in (0, 5, 10)]

    want = {}
    for a in rows:
        every = [strings(a, b) for b in rows if b["doc_id"] == a["doc_id"] and b["mention_idx"] < a["mention_idx"]]
        if every:
            want[a["doc_id"], a["mention_idx"]] = (len(every), sum(map(len, every)), sum(zlib.crc32(x.encode()) for s in every for x in s))
    got = {(r["doc_id"], r["ana_idx"]): (r["n_pairs"], r["n_features"], r["crc_sum"]) for r in links.QUERIES["feature_assembly_all"](spark, "").collect()}
    assert got == want and sum(n for n, _, _ in got.values()) == 15


def test_murmur_and_names(spark):
    assert X.murmur3(b"") == 0 and X.murmur3(b"abcde") == (-392455434) & 0xFFFFFFFF and X.murmur3(b"abcd", 42) != X.murmur3(b"abcd")
    df = spark.createDataFrame([(["abcde", ""],), (None,)], "s array<string>")
    assert [r["h"] for r in df.select(X.hashed_murmur(F.col("s")).alias("h")).collect()] == [[X.murmur3(b"abcde") & 0xFFFFFF, 0], None]
    assert X.feature_names(["a.b.head_ner", "x.exact_match", ""]) == (["ner"], ["exact_match"])
    with pytest.raises(ValueError):
        X.feature_names(["nothing"])


def test_decoding_ties_and_labels(spark):
    rows = [("d", 1, 0, [], True), ("d", 2, 1, [1], False), ("d", 2, 0, [], True), ("d", 3, 2, [2], True), ("d", 3, 1, [2], True), ("d", 3, 0, [9], False)]
    arcs = spark.createDataFrame(rows, "doc_id string, ana_idx int, ante_idx int, feats array<int>, consistent boolean").withColumn("cost", decode.cost(F.col("consistent"), F.col("ante_idx") == 0))
    model = spark.createDataFrame([("+", 2, 0.5), ("+", 9, 0.5), ("-", 1, 1.0)], "label string, idx int, weight double")
    s = decode.score_arcs(arcs, model, None, ("+",)).join(arcs.select(*decode.KEY, "consistent"), decode.KEY)
    best = {r["ana_idx"]: (r["best"], r["gold"], r["is_consistent"]) for r in decode.best_arcs(s).collect()}
    assert best == {1: (0, 0, True), 2: (1, 0, False), 3: (2, 2, True)}
    assert {r["ana_idx"]: r["gold"] for r in decode.best_arcs_closest(s).collect()} == {1: 0, 2: 0, 3: 2}
    assert not decode.tree_consistency(decode.best_arcs(s)).first()["is_consistent"]
    lab = {(r["ana_idx"], r["ante_idx"]): r["label"] for r in decode.label_pairs(decode.score_arcs(arcs, model, None, ("+", "-"))).collect()}
    assert lab[2, 1] == "-" and lab[3, 1] == "+" and lab[1, 0] == "+"
    costly = decode.score_arcs(arcs, model, spark.createDataFrame([("+", 1.0)], "label string, prior double"), ("+",), 10.0)
    assert {(r["ana_idx"], r["ante_idx"]): r["score"] for r in costly.collect()}[2, 1] == 11.0


def test_forest_roots(spark):
    chain = [("d", i, i - 1) for i in range(2, 300)] + [("e", 5, 2), ("e", 3, None)]
    got = {(r["doc_id"], r["mention_idx"]): r["entity_id"] for r in cluster.forest_roots(spark.createDataFrame(chain, "doc_id string, child int, parent int")).collect()}
    assert got == {**{("d", i): 1 for i in range(1, 300)}, ("e", 5): 2, ("e", 2): 2}
    assert cluster.all_antecedents(spark.createDataFrame([("d", 1, 0), ("d", 2, 0)], "doc_id string, ana_idx int, ante_idx int")).count() == 0


@pytest.mark.parametrize("approach, shards", [("latent", 1), ("closest", 1), ("tree", 1), ("pair", 1), ("latent", 2)])
def test_training_separates_the_story(spark, approach, shards):
    names, both = ["fine_type", "gender"], ["head_match", "alias"]
    model, priors = pipeline.train(story(spark), approach, 5, shards=shards, cost_scaling=1.0, mention_features=names, pair_features=both)
    decisions, clusters = pipeline.predict(story(spark), model, priors, approach, mention_features=names, pair_features=both)
    got = {(r["doc_id"], r["mention_idx"]): r["entity_id"] for r in clusters.collect()}
    assert got[("d", 1)] == got[("d", 3)] == got[("d", 5)] and got[("d", 2)] == got[("d", 4)] and got[("d", 1)] != got[("d", 2)]
    assert decisions.groupBy("doc_id", "ana_idx").count().filter("count > 1").count() == 0
    with_ids = cluster.with_decisions(story(spark), clusters, decisions)
    assert with_ids.filter("set_id IS NOT NULL").count() == len(got)


def test_learning_from_nothing(spark):
    empty = spark.createDataFrame([], "doc_id string, ana_idx int, ante_idx int, feats array<int>, cost int, consistent boolean")
    model, priors = learn.fit(empty)
    assert model.count() == 0 and priors.count() == 0


def test_consistency_and_first_mentions(spark):
    df = spark.createDataFrame([(None, True), (None, False), (3, True), (3, False)], "s int, f boolean")
    got = [r["c"] for r in df.select(A.consistent(F.lit(False), F.lit(True), F.col("s"), F.col("f")).alias("c")).collect()]
    assert got == [True, True, True, False]
    firsts = decode.first_in_entity(spark.createDataFrame([("d", 1, 4), ("d", 2, None), ("d", 3, 4), ("d", 4, None)], "doc_id string, mention_idx int, annotated_set_id int"))
    assert {r["mention_idx"] for r in firsts.filter("first_in_gold_entity").collect()} == {1, 2}


def graph(spark):
    rows = [(0, 0, 0, "NAM"), (1, 1, 9, "NOM"), (2, 0, 8, "PRO"), (3, 1, 7, "NOM"), (4, 0, 0, "NOM"), (5, 2, None, "NAM"), (6, 2, 5, "NAM"), (7, 3, 5, "PRO")]
    return spark.createDataFrame([("d", i + 1, a, b, t) for i, a, b, t in rows], "doc_id string, mention_idx int, annotated_set_id int, set_id int, type string")


def test_error_analysis(spark):
    g = graph(spark)
    edges = analysis.entity_edges(g, "annotated_set_id")
    assert {x[1:] for x in pairs_of(edges)} == {(5, 3), (5, 1), (3, 1), (4, 2), (7, 6)}
    other = analysis.entity_edges(g, "set_id")
    assert {x[1:] for x in pairs_of(analysis.partition(edges, other))} == {(5, 1)}
    assert {x[1:] for x in pairs_of(analysis.difference(edges, other))} == {(5, 3), (3, 1), (4, 2), (7, 6)}
    closest = {(r["ana_idx"], r["ante_idx"], r["is_kept"]) for r in analysis.recall_closest(g, "annotated_set_id", "set_id").collect()}
    assert closest == {(3, 1, False), (5, 1, True), (4, 2, False), (7, 6, False)}
    by_type = spark.createDataFrame([("d", 1, 1, None, "NAM"), ("d", 2, 1, None, "NOM"), ("d", 3, 1, None, "PRO"), ("d", 4, 1, None, "NOM"), ("d", 5, 1, None, "PRO")], g.schema)
    assert {(r["ana_idx"], r["ante_idx"]) for r in analysis.recall_accessibility(by_type, "annotated_set_id", "set_id").collect()} == {(2, 1), (3, 2), (4, 1), (5, 4)}
    a = analysis.Analysis("closest", "closest").add_system("s1", g).add_system("s2", g)
    rows = a.get()
    assert rows.filter("kind = 'recall_errors' AND system = 's2'").count() == 3 and rows.filter("kind = 'precision_errors' AND system = 's1'").count() == 1
    merged = analysis.update(rows, rows.filter("system = 's1' AND kind = 'recall_errors'").limit(1))
    assert merged.filter("system = 's1' AND kind = 'recall_errors'").count() == 1 and merged.filter("system = 's2'").count() == rows.filter("system = 's2'").count()
    assert analysis.intersection(rows.filter("system = 's1'"), rows.filter("system = 's2'")).count() == rows.filter("system = 's1'").select(*analysis.EDGE).distinct().count()
    told = analysis.categorize(analysis.with_mentions(rows.filter("kind = 'recall_errors'"), g, ["type"]), F.col("ana.type"))
    total = analysis.counts(told, "system", "cat1", totals=True).filter("system IS NULL").first()["n_errors"]
    assert total == 6 and analysis.pivoted(told, "cat1", ["s1", "s2"]).count() == 3
    assert {r["json"] for r in analysis.as_json(rows.filter("system = 's1' AND kind = 'recall_errors'"), g).collect()} >= {'{"system":"s1","kind":"recall_errors","anaphor":2,"antecedent":0}'}
    with pytest.raises(ValueError):
        analysis.Analysis().get()


def test_precision_of_system_antecedents(spark):
    rows = [("d", 1, 1, 1, None), ("d", 2, 1, 1, 1), ("d", 3, 2, 1, 2), ("d", 4, 2, 9, 3)]
    df = spark.createDataFrame(rows, "doc_id string, mention_idx int, annotated_set_id int, set_id int, antecedent_idx int")
    got = {(r["ana_idx"], r["ante_idx"], r["is_kept"]) for r in analysis.precision_system_output(df, "set_id", "annotated_set_id").collect()}
    assert got == {(2, 1, True), (3, 2, False)}
