"""Contexts, attributes, extraction, skewed keys, streams, and the driver's contract."""

import importlib
import os
import sys

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spanmill.functions import attributes as A
from spanmill.functions import spans
from spanmill.operators import context, hotkeys
from spanmill.operators import mentions as men
from spanmill.sources import lookups
from spanmill.streaming import mentions as stream


def test_spans(spark):
    df = spark.createDataFrame([("(10, 12)",), ("(10,12)",), ("x",), (None,)], "t string").withColumn("s", spans.parse("t"))
    assert [r["x"] for r in df.select(spans.to_text("s").alias("x")).collect()] == ["(10, 12)", "(10, 12)", None, None]
    assert df.filter(spans.embeds("s", "s")).count() == 2 and df.filter(spans.embeds_strictly("s", "s")).count() == 0
    assert df.select(spans.length("s").alias("n")).first()["n"] == 3


@pytest.mark.parametrize("block", [2, 3, 100])
def test_islands_do_not_depend_on_blocks(spark, block):
    ids = [0, 1, 2, 0, 1, 0, 0, 1, 2, 3]
    t = spark.createDataFrame([("d", i, n) for i, n in enumerate(ids)] + [("e", 0, 5)], "doc_id string, tok_idx int, in_sent_idx int")
    got = {(r["doc_id"], r["sent_id"], r["begin"], r["end"]) for r in context.sentence_spans(t, block=block).collect()}
    assert got == {("d", 0, 0, 2), ("d", 1, 3, 4), ("d", 2, 5, 5), ("d", 3, 6, 9), ("e", 0, 0, 0)}
    assert context.sentence_spans(t.limit(0), block=block).count() == 0
    placed = context.place_in_document(t, "doc_id", F.col("tok_idx"), [F.col("tok_idx")], "at", block)
    assert {(r["tok_idx"], r["at"]) for r in placed.filter("doc_id = 'd'").collect()} == {(i, i + 1) for i in range(10)}


def test_context_and_governors(spark):
    words = [("the", "DT", 2), ("plan", "NN", 3), ("was", "VBD", 0), ("laid", "VBN", 3)]
    t = spark.createDataFrame([("d", 0, i, i, w, p, h) for i, (w, p, h) in enumerate(words)], "doc_id string, sent_id int, tok_idx int, in_sent_idx int, token string, pos string, head int")
    g = {r["token"]: (r["governor"], r["ancestry"]) for r in context.with_governors(t).collect()}
    assert g == {"the": ("plan", "-R-NN-R-VBD"), "plan": ("was", "-R-VBD-L-NONE"), "was": ("NONE", "-L-NONE"), "laid": ("was", "-L-VBD-L-NONE")}
    m = spark.createDataFrame([("d", 1, 1)], "doc_id string, b int, e int")
    near = lambda k: context.context(m, t, ["doc_id"], F.col("b"), F.col("e"), k).first()["context"]
    assert near(2) == ["was", "laid"] and near(0) is None and near(-1) == ["the"] and near(1000) is None and near(-2) is None


def test_pronouns(spark):
    rows = [("him", "PRP"), ("its", "PRP$"), ("mine", "PRP"), ("themselves", "PRP"), ("you", "PRP"), ("this", "DT"), ("freaks", "NNS"), ("running", "VBG"), ("Obama", "NNP")]
    df = spark.createDataFrame([([w], [p], ["NONE"], [w], 0) for w, p in rows], "tokens array<string>, pos array<string>, ner array<string>, head array<string>, i int")
    c = F.col
    df = df.withColumn("t", A.mention_type(c("pos"), c("ner"), c("i"))).withColumn("c", F.when(c("t") == "PRO", A.citation_form(c("tokens"))))
    df = df.withColumns({"f": A.fine_type(c("t"), c("tokens"), c("pos")), "n": A.number(c("t"), c("c"), c("head"), c("pos"), c("i")), "s": A.semantic_class(c("t"), c("c"), c("ner"), c("i"))})
    df = df.withColumn("g", A.gender(c("t"), c("n"), c("c"), c("tokens"), c("ner"), c("i"), c("s"), F.lit(None).cast("string")))
    got = {r["tokens"][0]: (r["t"], r["c"], r["f"], r["n"], r["g"]) for r in df.collect()}
    assert got["him"] == ("PRO", "he", "PERS_ACC", "SINGULAR", "MALE") and got["its"][2] == "POSS_ADJ" and got["its"][4] == "NEUTRAL" and got["mine"][2] == "POSS"
    assert got["themselves"] == ("PRO", "they", "REFL", "PLURAL", "PLURAL") and got["you"][3:] == ("SINGULAR", "PLURAL") and got["this"] == ("DEM", None, None, "SINGULAR", "NEUTRAL")
    assert got["freaks"][3] == "PLURAL" and got["running"][0] == "VRB" and got["Obama"][0] == "NAM"


def test_gender_list(spark):
    words = spark.createDataFrame([("Barbara Bush", "FEMALE"), ("Zidane", "MALE"), (" snafu ", "neutral"), ("snafu", "MALE"), (None, "MALE"), ("", "FEMALE")], "word string, gender string")
    lex = A.gender_lexicon(words)
    m = spark.createDataFrame([(1, ["Barbara", "Bush"], ["Bush"]), (2, ["Footballer", "Zidane"], ["Zidane"]), (3, ["snafu"], ["snafu"]), (4, ["x"], ["x"]), (5, ["a", "b"], ["b", "Zidane"])], "k int, tokens array<string>, head array<string>")
    got = {r["k"]: r["listed_gender"] for r in A.with_listed_gender(m, lex, ["k"]).collect()}
    assert got == {1: "FEMALE", 2: "MALE", 3: "NEUTRAL", 4: None, 5: "MALE"}
    assert A.with_listed_gender(m, lex.limit(0), ["k"]).filter("listed_gender IS NOT NULL").count() == 0


def test_lists(spark, tmp_path):
    (tmp_path / "m").write_text("Bob\n\n")
    assert [tuple(r) for r in lookups.gender_lists(spark, male=str(tmp_path / "m")).collect()] == [("Bob", "MALE")]
    (tmp_path / "f").write_text("x.y.fine_type\nx.y.alias\n")
    assert lookups.feature_list(spark, str(tmp_path / "f")) == (["fine_type"], ["alias"])
    pairs = lookups.coreferent_pairs(spark.createDataFrame([("b", "a"), ("a", "b"), (None, "c")], "a string, b string"))
    assert pairs.count() == 1
    p = spark.createDataFrame([(("b",), ("a",)), (("a",), ("c",))], "ana struct<head_text:string>, ante struct<head_text:string>")
    assert [r["is_listed_pair"] for r in lookups.with_listed_pairs(p, pairs).orderBy("ana").collect()] == [False, True]
    counts = spark.createDataFrame([("a b", 30)], "text string, n int")
    assert lookups.with_singleton_counts(spark.createDataFrame([(["a", "b"],), (["c"],)], "tokens array<string>"), counts).filter("singleton_count = 30").count() == 1


def sentence(spark, words):
    rows = [("c", "d", 0, i, i, w, p, n, "-", b, 0, "x") for i, (w, p, n, b) in enumerate(words)]
    return spark.createDataFrame(rows, "corpus string, doc_id string, sent_id int, tok_idx int, in_sent_idx int, token string, pos string, ner string, speaker string, parse_bit string, head int, deprel string")


def test_extraction(spark):
    words = [("Bill", "NNP", "PERSON", "(TOP(S(NP(NP*"), ("Gates", "NNP", "PERSON", "*)"), (",", ",", "NONE", "*"), ("the", "DT", "NONE", "(NP*"), ("founder", "NN", "NONE", "*))"), ("knew", "VBD", "NONE", "(VP*"), ("it", "PRP", "NONE", "(NP*)"), ("seems", "VBZ", "NONE", "*"), ("that", "IN", "NONE", "*"), ("um", "UH", "NONE", "(NP*)"), (".", ".", "NONE", "*)))")]
    t = sentence(spark, words)
    every = men.system_mentions(t, filtered=False)
    assert {tuple(r["span"]) for r in every.filter("mention_idx > 0").collect()} == {(0, 1), (0, 4), (3, 4), (6, 6), (9, 9)}
    kept = men.system_mentions(t, A.gender_lexicon(spark.createDataFrame([("Bill", "MALE")], "word string, gender string")))
    rows = {tuple(r["span"]): r for r in kept.filter("mention_idx > 0").collect()}
    assert set(rows) == {(0, 4)} and rows[0, 4]["is_apposition"] and rows[0, 4]["head"] == ["Bill", "Gates"] and rows[0, 4]["type"] == "NAM" and rows[0, 4]["gender"] == "MALE"
    assert kept.filter("mention_idx = 0").count() == 1
    damaged = sentence(spark, [(w, p, n, "((" if i == 1 else None) for i, (w, p, n, _) in enumerate(words)])
    assert {tuple(r["span"]) for r in men.system_mentions(damaged).filter("mention_idx > 0").collect()} == {(0, 1)}
    assert men.system_mentions(t.limit(0)).count() == 0


def test_heavy_keys(spark):
    rows = [("a", i, 0) for i in range(97)] + [("b", i, 0) for i in range(3)] + [("b", 2, 9)] * 50 + [(None, 1, 0), ("c", None, 0), ("z", -5, 0)]
    df = spark.createDataFrame(rows, "doc_id string, tok_idx int, n int")
    assert {r["doc_id"] for r in hotkeys.heavy_keys(df, "doc_id", "tok_idx", 0.03).collect()} == {"a"}
    assert {(r["doc_id"], r["k"]) for r in hotkeys.distinct_int_count(df, "doc_id", "tok_idx", "k").collect()} == {("a", 97), ("b", 3), ("z", 1)}
    assert hotkeys.heavy_keys(df.limit(0), "doc_id", "tok_idx", 0.03).count() == 0


def test_key_profile_of_one_sided_keys(spark):
    t = spark.createDataFrame([("a", 0, 0, "x"), ("a", 1, 0, "x"), ("a", 1, 0, "x")], "doc_id string, tok_idx int, sent_id int, token string")
    m = spark.createDataFrame([("b", 0), ("b", 1), (None, 2)], "doc_id string, mention_idx int")
    got = {tuple(r) for r in hotkeys.key_profile(t, m).collect()}
    assert got == {("a", 2, 1, 0, 1, True), ("b", 0, 0, 1, 0, False)}
    assert hotkeys.key_profile(t.limit(0), m.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one two\nthree")
    tokens = stream.token_stream(stream.read_texts(spark, str(src)), "path", "text")
    q = stream.for_each_batch(tokens, lambda b: b.select("token"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["token"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "three", "two"]
    batch = spark.createDataFrame([(1, "s", "a b", "2024-01-01 00:01:00"), (2, "s", "c", "2024-01-01 00:02:00")], "doc_id int, source string, text string, t string").withColumn("t", F.col("t").cast("timestamp"))
    row = stream.token_counts(stream.token_stream(batch), "t").first()
    assert row["n_tokens"] == 3 and row["n_documents"] == 2


def oracle():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


FAST = ["tokens_basic", "sentence_spans", "tag_runs", "mention_same_head", "mention_nested_anti", "gender_lookup", "recall_closest", "precision_errors", "error_rollup", "metric_b3", "cluster_forest", "coref_column", "candidate_pairs_train"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_registered_queries_match_sql(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    r = oracle().execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([clean(row[names.index(c)]) for c in sorted(names)]) for row in r.fetchall())
    assert sorted(repr([clean(row[c]) for c in sorted(names)]) for row in df.collect()) == want


def test_contract(monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "rule_clusters" in entry.queries()
    monkeypatch.setitem(sys.modules, "spanmill.llm", None)
    without = importlib.reload(entry)
    assert "tokens_basic" in without.queries() and not any(q.startswith(("p1_", "p7_")) for q in without.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_nothing_else_imports_the_llm_package():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "spanmill")
    for folder, _, files in os.walk(root):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert "import llm" not in text and ".llm" not in text, f
