from pyspark.sql import functions as F

from spanmill.operators.mentions import annotated_mentions
from spanmill.sinks import writers
from spanmill.sources import conll, lookups, rawtext

COREF = "(0) - - (0|(1) 0) - (1)|(4 - (2) (2|(0 2)|4) 0) -".split()
WORDS = "A b c d e . F g h i j k .".split()
NUMBERS = [*range(6), *range(7)]


def body(coref=COREF, words=WORDS, numbers=NUMBERS, doc="(bn/voa/02/voa_0220); part 000", ner=None):
    lines = [f"#begin document {doc}"]
    for i, (n, w, c) in enumerate(zip(numbers, words, coref)):
        if i and n <= numbers[i - 1]:
            lines.append("")
        lines.append("\t".join(["bn/voa", "0", str(n), w, "NN", "(TOP(NP*" if n == numbers[0] else "*))" if i + 1 == len(words) or numbers[i + 1] <= n else "*", "-", "-", "-", "-", (ner or ["*"] * 99)[i], c]))
    return "\n".join([*lines, "", "#end document", ""])


def docs(spark, *texts):
    return conll.documents_of(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_nested_brackets_and_sentences(spark):
    t = conll.tokens(docs(spark, body()))
    got = {(r["span"]["begin"], r["span"]["end"]): r["set_id"] for r in conll.coreference_spans(t).collect()}
    assert got == {(0, 0): 0, (3, 3): 1, (3, 4): 0, (6, 6): 1, (8, 8): 2, (9, 10): 2, (6, 10): 4, (9, 11): 0}
    spans = {(r["span"]["begin"], r["span"]["end"]) for r in conll.sentences(t).collect()}
    assert spans == {(0, 5), (6, 12)}
    assert t.select("doc_id").distinct().first()["doc_id"] == "(bn/voa/02/voa_0220); part 000"


def test_numbers_from_one_are_shifted(spark):
    t = conll.tokens(docs(spark, body(numbers=[n + 1 for n in NUMBERS])))
    assert [r["in_sent_idx"] for r in t.orderBy("tok_idx").collect()] == NUMBERS


def test_entity_tags(spark):
    bits = ["(GPE)", "*", "(DATE*", "*", "*)", "*", "(ORG*", "*)", *["*"] * 5]
    t = conll.tokens(docs(spark, body(ner=bits)))
    assert [r["ner"] for r in t.orderBy("tok_idx").collect()] == ["GPE", "NONE", "DATE", "DATE", "DATE", "NONE", "ORG", "ORG", *["NONE"] * 5]


def test_round_trip(spark):
    t = conll.tokens(docs(spark, body(), body(doc="(x/y/z); part 001")))
    gold = conll.coreference_spans(t)
    again = conll.tokens(conll.documents_of(writers.conll_documents(t, gold).select("text")))
    key = lambda df: sorted((r["doc_id"], r["span"], r["set_id"]) for r in conll.coreference_spans(df).collect())
    assert key(t) == key(again) and again.count() == 26
    cells = lambda df: [(r["doc_id"], r["tok_idx"], r["coref"]) for r in df.orderBy("doc_id", "tok_idx").select("doc_id", "tok_idx", F.array_join(F.array_sort(F.split("coref", r"\|")), "|").alias("coref")).collect()]
    assert cells(t) == cells(again)


def test_strict_brackets(spark):
    t = conll.tokens(docs(spark, body(coref=["(1", *["-"] * 12])))
    assert conll.coreference_spans(t).count() == 0
    try:
        conll.coreference_spans(t, strict=True).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "bracket without a partner" in str(e)


def test_files(spark, tmp_path):
    (tmp_path / "a.conll").write_text(body() + body(doc="(q); part 002"))
    d = conll.read_documents(spark, str(tmp_path / "a.conll"))
    assert sorted(r["doc_id"] for r in d.collect()) == ["(bn/voa/02/voa_0220); part 000", "(q); part 002"]
    t = conll.tokens(d)
    writers.write_conll(t, conll.coreference_spans(t), str(tmp_path / "out"))
    assert conll.coreference_spans(conll.tokens(conll.read_documents(spark, str(tmp_path / "out")))).count() == 16
    assert conll.read_documents(spark, None).count() == 0


def test_antecedent_files(spark, tmp_path):
    t = conll.tokens(docs(spark, body()))
    m = annotated_mentions(conll.coreference_spans(t)).withColumn("antecedent_idx", F.when(F.col("mention_idx") == 3, 1))
    writers.write_antecedents(m, str(tmp_path / "a"))
    rows = lookups.read_antecedents(spark, str(tmp_path / "a")).collect()
    assert len(rows) == 1 and rows[0]["ana"] == (3, 4) and rows[0]["ante"] == (0, 0)
    (tmp_path / "b.tsv").write_text("d\t(3, 4)\t(0,0)\nd\t(7, 7)\t(3, 4)\nbroken\nd\t(9, 9)\t(8, 8)\n")
    pairs = lookups.read_antecedents(spark, str(tmp_path / "b.tsv"))
    known = spark.createDataFrame([("d", (0, 0), 5)], "doc_id string, span struct<begin:int,end:int>, set_id int")
    got = {r["span"]["begin"]: r["set_id"] for r in lookups.mentions_of_antecedents(known, pairs).collect()}
    assert got == {0: 5, 3: 5, 7: 5, 8: 6, 9: 6}


def test_inline_tags(spark):
    t = conll.tokens(docs(spark, body()))
    m = annotated_mentions(conll.coreference_spans(t))
    text = {r["sent_id"]: r["text"] for r in writers.inline_tags(t, m).collect()}
    assert text[0].startswith('<mention id="0" span_start="0" span_end="0" entity="0">A</mention> b c <mention id="2" span_start="3" span_end="4" entity="0"><mention id="1"')
    assert 'entity="0"' not in writers.inline_tags(t, m, zero_is_none=True).first()["text"]
    back = rawtext.tagged_mentions(spark.createDataFrame([("d", " ".join(text.values()))], "doc_id string, text string"))
    assert back.count() == 8


def test_tagged_text(spark):
    text = '<mention id="1" span_start="2" span_end="3" entity="4">x y</mention> z <mention id="2" span_start="5" span_end="5" antecedent="1">w</mention><mention>q</mention>'
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, text string")
    got = {r["id"]: (r["set_id"], r["antecedent"]) for r in rawtext.tagged_mentions(df).collect()}
    assert got == {1: (4, None), 2: (7, 1)}
    assert df.select(rawtext.untagged(F.col("text")).alias("t")).first()["t"] == "x y z wq"


def test_plain_text(spark):
    df = spark.createDataFrame([("d", "He left. Don't ask Mr. Smith!"), ("e", None), ("f", "")], "doc_id string, text string")
    t = rawtext.annotate(df)
    assert [r["token"] for r in t.orderBy("tok_idx").collect()][:6] == ["He", "left", ".", "Do", "n't", "ask"]
    assert {r["ner"] for r in t.collect()} == {"NONE"} and {r["deprel"] for r in t.collect()} == {"punc"}
    bad = spark.createDataFrame([("x", "{broken")], "doc_id string, json string")
    assert rawtext.annotated_json(bad).count() == 0


def test_identifiers(spark):
    df = spark.createDataFrame([("(bn/voa/02/voa_0220); part 000",)], "d string")
    row = df.select(writers.html_identifier(F.col("d")).alias("a"), writers.html_identifier_conll(F.col("d")).alias("b")).first()
    assert row["a"] == "(bn_voa_02_voa_0220); part 000" and row["b"] == "voa_0220_part_000"


SERVICE = """
import json, struct, sys
for line in sys.stdin:
    command, _, text = line.rstrip("\\n").partition("\\t")
    answer = b"{}" if command == "PING" else json.dumps({"sentences": [{"tokens": json.loads(text).split(), "ner": ["O", "GPE"], "deps_basic": [["nsubj", 1, 0], ["root", -1, 1]]}]}).encode()
    sys.stdout.buffer.write(struct.pack(">Q", len(answer)) + answer)
    sys.stdout.buffer.flush()
"""


def test_annotation_process(spark, tmp_path):
    import sys

    script = str(tmp_path / "service.py")
    (tmp_path / "service.py").write_text(SERVICE.replace("\\\\", "\\"))
    client = rawtext.AnnotationClient([sys.executable, script])
    assert client.ping() and client("a b")["sentences"][0]["tokens"] == ["a", "b"]
    client.close()
    python = sys.executable
    t = rawtext.annotate(spark.createDataFrame([("d", "Ann Rome")], "doc_id string, text string"), lambda: rawtext.AnnotationClient([python, script]))
    assert [(r["token"], r["ner"], r["head"], r["deprel"]) for r in t.orderBy("tok_idx").collect()] == [("Ann", "NONE", 2, "nsubj"), ("Rome", "GPE", 0, "root")]
