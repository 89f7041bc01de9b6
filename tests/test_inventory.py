import os

import duckdb
import pytest
from conftest import DATA

from spanmill import storage
from spanmill.operators import analysis, decode
from spanmill.plans import inventory
from spanmill.sinks import html, writers


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", ["listed_relations", "coreference_agreement", "coreferent_across", "annotated_numbering", "antecedent_file", "gender_files", "feature_file", "model_roundtrip", "errors_by_anaphor"])
def test_queries_match_their_sql(spark, views, name):
    df = inventory.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    r = views.execute(inventory.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(str([dict(zip(names, x))[c] for c in columns]) for x in r.fetchall())
    assert sorted(str([x[c] for c in columns]) for x in df.collect()) == want and want


def test_filters_of_errors(spark):
    e = spark.createDataFrame([("a", "k", "d", 5, 1), ("a", "k", "d", 4, 3), ("a", "k", "e", 2, 1)], "system string, kind string, doc_id string, ana_idx int, ante_idx int")
    m = spark.createDataFrame([("d", 1, 0, 7), ("d", 3, 2, None), ("d", 4, 2, None), ("d", 5, 6, 7), ("e", 1, None, 1), ("e", 2, 3, 1)], "doc_id string, mention_idx int, sent_id int, annotated_set_id int")
    both = analysis.with_mentions(e, m, ["sent_id"])
    assert [(r["ana_idx"], r["ante_idx"]) for r in analysis.apart(both, 1).collect()] == [(5, 1)]
    assert [(r["ana_idx"], r["ante_idx"]) for r in analysis.apart(both, 0, 3).collect()] == [(4, 3)]
    gold = {(r["doc_id"], r["ana_idx"]): r["gold_anaphor"] for r in analysis.with_gold_anaphor(e, m).collect()}
    assert gold == {("d", 5): "is_gold", ("d", 4): "is_not_gold", ("e", 2): "is_gold"}
    assert analysis.with_gold_anaphor(e.limit(0), m).count() == 0


def test_written_tables_go_with_their_session(spark):
    df = storage.write_table(spark.range(3), "x")
    path = df._spanmill_path
    assert df.count() == 3 and os.path.exists(path)
    storage.drop_table(df)
    assert not os.path.exists(path)
    again = storage.write_table(spark.range(3), "x")._spanmill_path
    storage.release(spark)
    assert not os.path.exists(again) and storage.write_table(spark.range(3), "x").count() == 3


def test_pages_and_tagged_text(spark, tmp_path):
    t = spark.createDataFrame([("a/b.c; 0", 0, 0, "Ann"), ("a/b.c; 0", 0, 1, "<met>"), ("a/b.c; 0", 1, 2, "her"), ("e", 0, 0, None)], "doc_id string, sent_id int, tok_idx int, token string")
    m = spark.createDataFrame([("a/b.c; 0", 1, (0, 0), 0), ("a/b.c; 0", 2, (2, 2), 0), ("a/b.c; 0", 3, (0, 1), None), ("a/b.c; 0", 0, None, None)], "doc_id string, mention_idx int, span struct<begin:int,end:int>, set_id int")
    e = spark.createDataFrame([("s", "recall_errors", "a/b.c; 0", 2, 1)], "system string, kind string, doc_id string, ana_idx int, ante_idx int")
    pages = {r["doc_id"]: r for r in html.document_pages(t, m, e).collect()}
    page = pages["a/b.c; 0"]["page"]
    assert '<span class="m" id="m3" data-e=""><span class="m" id="m1" data-e="0">Ann</span> &lt;met&gt;</span>' in page and "s recall errors: 2 to 1" in page and page.count("<p>") == 2
    assert html.write_pages(html.document_pages(t, m), str(tmp_path / "pages")) == 2 and len(list((tmp_path / "pages").iterdir())) == 2
    assert html.document_pages(t.limit(0), m, e).count() == 0
    writers.write_tagged(writers.inline_tags(t.filter("token IS NOT NULL"), m), str(tmp_path / "tagged"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "tagged").rglob("*.txt"), key=lambda f: f.name))
    assert text.splitlines()[1].endswith(">her</mention>") and len(text.splitlines()) == 2


def test_a_small_model_scores_like_a_large_one(spark, monkeypatch):
    arcs = spark.createDataFrame([("d", 2, 1, [1, 2, 2], [(3, 0.5)], 1), ("d", 2, 0, [], [], 2), ("d", 3, 1, [9], [], 0)], "doc_id string, ana_idx int, ante_idx int, feats array<int>, num_feats array<struct<idx:int,val:float>>, cost int")
    model = spark.createDataFrame([("+", 1, 1.0), ("+", 2, -0.25), ("+", 3, 4.0), ("-", 2, 0.5), ("+", 1, 0.5)], "label string, idx int, weight double")
    priors = spark.createDataFrame([("+", 0.125)], "label string, prior double")
    rows = lambda: sorted(tuple(r) for r in decode.score_arcs(arcs, model, priors, ("+", "-"), 2.0, keep=("cost",)).collect())
    small = rows()
    monkeypatch.setattr(decode, "LITERAL_WEIGHTS", 1)
    assert rows() == small and ("d", 2, 1, "+", 5.125, 1) in small and len(small) == 6
