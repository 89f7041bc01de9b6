"""Queries over entities: graphs, errors, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trees as T
from ..operators import analysis as X
from ..operators import metrics
from ..sinks import writers
from ..sources import conll
from .base import E_, M, event_mentions, mentions, tokens

_SIDES = ["doc_id", "mention_idx", "annotated_set_id", "set_id", "type"]
_EDGE = X.EDGE


def _sides(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return mentions(spark, sf, *_SIDES, *more).filter("mention_idx > 0")


def entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    return X.entity_edges(_sides(spark, sf), "annotated_set_id").select(*_EDGE, F.col("entity").alias("set_id"))


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = _sides(spark, sf)
    return X.entity_edges(m, "annotated_set_id").select(*_EDGE), X.entity_edges(m, "set_id").select(*_EDGE)


def partition_semi(spark: SparkSession, sf: str) -> DataFrame:
    return X.partition(*_both(spark, sf))


def edge_difference(spark: SparkSession, sf: str) -> DataFrame:
    return X.difference(*_both(spark, sf))


def recall_closest(spark: SparkSession, sf: str) -> DataFrame:
    return X.recall_closest(_sides(spark, sf), "annotated_set_id", "set_id")


def recall_accessibility(spark: SparkSession, sf: str) -> DataFrame:
    return X.recall_accessibility(_sides(spark, sf), "annotated_set_id", "set_id")


def _with_antecedents(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with the index of their antecedent in the same document."""
    m = _sides(spark, sf, "antecedent")
    ante = m.select(F.col("mention_id").alias("antecedent"), "doc_id", F.col("mention_idx").alias("antecedent_idx"))
    return m.join(ante, ["antecedent", "doc_id"], "left")


def precision_errors(spark: SparkSession, sf: str) -> DataFrame:
    return X.precision_system_output(_with_antecedents(spark, sf), "set_id", "annotated_set_id")


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    m = _with_antecedents(spark, sf)
    return X.Analysis("closest", "system_output").add_system("set_id", m).get().filter("kind <> 'decisions'")


def analysis_rows(spark: SparkSession, sf: str) -> DataFrame:
    return X.Analysis("accessibility", "closest").add_system("set_id", _sides(spark, sf)).get()


def _categorized(spark: SparkSession, sf: str) -> DataFrame:
    e = X.with_mentions(_errors(spark, sf), _sides(spark, sf), ["type"])
    return X.categorize(X.categorize(e, F.coalesce("ana.type", F.lit("?")), 1), F.coalesce("ante.type", F.lit("?")), 2)


def error_categorize(spark: SparkSession, sf: str) -> DataFrame:
    return X.counts(_categorized(spark, sf), "kind", "cat1", "cat2")


def error_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return X.counts(_categorized(spark, sf), "kind", "cat1", "cat2", totals=True)


def error_pivot(spark: SparkSession, sf: str) -> DataFrame:
    e = _categorized(spark, sf).withColumn("system", F.col("kind"))
    return X.pivoted(e, "cat1", ["recall_errors", "precision_errors"])


def common_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Recall errors that two ways of choosing the spanning edge have in common."""
    m = _sides(spark, sf)
    a, b = (X.errors(f(m, "annotated_set_id", "set_id"), "s", "recall_errors") for f in (X.recall_closest, X.recall_accessibility))
    return X.intersection(a, b)


def other_errors(spark: SparkSession, sf: str) -> DataFrame:
    m = _sides(spark, sf)
    a, b = (X.errors(f(m, "annotated_set_id", "set_id"), "s", "recall_errors") for f in (X.recall_closest, X.recall_accessibility))
    return X.subtract(a, b)


def topk_heads(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, *_SIDES, "head").filter("mention_idx > 0")
    e = X.with_mentions(_errors(spark, sf), m, ["head"])
    top = X.top_heads(e, F.lower(F.array_join("ana.head", " ")), 10, ("kind",))
    return top.select("kind", "head", "n", F.col("rank").cast("long").alias("rank"))


def _events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = event_mentions(spark, sf)
    return tuple(e.select("doc_id", F.col("event_id").alias("mention"), F.col(c).cast("string").alias("entity")) for c in ("event_type", "response"))


def _mention_entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = _sides(spark, sf)
    return tuple(m.filter(F.col(c).isNotNull()).select("doc_id", F.col("mention_idx").alias("mention"), F.col(c).alias("entity")) for c in ("annotated_set_id", "set_id"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("metric", "doc_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def _metric(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(metrics.score(*_mention_entities(spark, sf), name, per_doc=True))

    return query


def metric_events(spark: SparkSession, sf: str) -> DataFrame:
    """B3 with every event as a mention: both sides have the same mentions."""
    return _rounded(metrics.score(*_events(spark, sf), "bcub", per_doc=True))


def metric_ceaf(spark: SparkSession, sf: str) -> DataFrame:
    k, r = _mention_entities(spark, sf)
    return _rounded(metrics.score(k, r, "ceafe", per_doc=True).unionByName(metrics.score(k, r, "ceafm", per_doc=True)))


def score_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(metrics.score(*_mention_entities(spark, sf), "all"))


def antecedent_lines(spark: SparkSession, sf: str) -> DataFrame:
    m = _with_antecedents(spark, sf).drop("span")
    spans = mentions(spark, sf, "span")
    return writers.antecedent_lines(m.join(spans, "mention_id")).select("doc_id", "value")


def coref_column(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf, "doc_id", "tok_idx")
    m = mentions(spark, sf, "doc_id", "span", "set_id").filter("span IS NOT NULL")
    return writers.coref_column(t, m).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "coref")


def conll_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens and annotated entities written as CoNLL text, read again, and decoded."""
    t = tokens(spark, sf)
    m = mentions(spark, sf, "doc_id", "span", "annotated_set_id").filter("span IS NOT NULL")
    text = writers.conll_documents(t, m, "annotated_set_id")
    again = conll.coreference_spans(conll.tokens(conll.documents_of(text)))
    return again.select("doc_id", F.col("span.begin").alias("span_begin"), F.col("span.end").alias("span_end"), "set_id")


def inline_tags(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, "doc_id", "mention_idx", "span", "set_id").filter("mention_idx > 0")
    return writers.inline_tags(tokens(spark, sf, "doc_id", "sent_id", "tok_idx", "token"), m)


def html_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    d = tokens(spark, sf, "doc_id", "tok_idx").select("doc_id").distinct()
    return d.select("doc_id", writers.html_identifier(F.col("doc_id")).alias("html_id"), writers.html_identifier_conll(F.col("doc_id")).alias("html_conll_id"))


_TREES = ["(NP (NNP NBC) (POS 's))", "(QP (CD forty) (HYPH -) (CD five))", "(X (NNS Men) (CC or) (: --))", "(UCP (JJ economic) (CC and) (NN trade))", "(NP (NP (DT the) (NN man)) (PP (IN in) (NP (NN town))))"]


def head_finder(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of literal trees."""
    import pandas as pd

    def run(batches):
        for b in batches:
            trees = [T.read_tree(x) for x in b["tree"]]
            yield pd.DataFrame({"tree": b["tree"], "head": [t.words[T.head(t, 0)] for t in trees]})

    return spark.createDataFrame([(t,) for t in _TREES], "tree string").mapInPandas(run, "tree string, head string")


QUERIES: dict = {
    f.__name__: f
    for f in (
        entity_edges, partition_semi, edge_difference, recall_closest, recall_accessibility, precision_errors, analysis_rows, error_categorize, error_rollup, error_pivot, common_errors, other_errors, topk_heads,
        metric_events, metric_ceaf, score_report, antecedent_lines, coref_column, conll_roundtrip, inline_tags, html_identifiers, head_finder,
    )
}
QUERIES |= {"metric_mentions": _metric("mentions"), "metric_muc": _metric("muc"), "metric_b3": _metric("bcub"), "metric_blanc": _metric("blanc")}

_G = "g AS (SELECT doc_id, annotated_set_id AS s, mention_idx AS i, type FROM m WHERE mention_idx > 0 AND annotated_set_id IS NOT NULL)"
_EE = lambda s, n: f"{n} AS (SELECT a.doc_id, a.mention_idx AS ana_idx, b.mention_idx AS ante_idx, a.{s} AS set_id FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.{s} = b.{s} AND b.mention_idx < a.mention_idx WHERE b.mention_idx > 0)"
_TWO = f"WITH {M}, {_EE('annotated_set_id', 'ge')}, {_EE('set_id', 'se')}"
_SPAN = f"""{_TWO}, k AS (SELECT ge.doc_id, ge.ana_idx, ge.ante_idx, t.type AS ante_type, a.type AS ana_type, se.ana_idx IS NOT NULL AS kept FROM ge LEFT JOIN se USING (doc_id, ana_idx, ante_idx)
    JOIN m t ON t.doc_id = ge.doc_id AND t.mention_idx = ge.ante_idx JOIN m a ON a.doc_id = ge.doc_id AND a.mention_idx = ge.ana_idx),
    rc AS (SELECT doc_id, ana_idx, coalesce(max(CASE WHEN kept THEN ante_idx END), max(ante_idx)) AS ante_idx, bool_or(kept) AS is_kept FROM k GROUP BY doc_id, ana_idx),
    ra AS (SELECT doc_id, ana_idx, coalesce(max(CASE WHEN kept THEN ante_idx END), CASE WHEN coalesce(any_value(ana_type) IN ('PRO', 'DEM'), false) THEN max(ante_idx)
           ELSE coalesce(max(CASE WHEN ante_type = 'NAM' THEN ante_idx END), max(CASE WHEN ante_type = 'NOM' THEN ante_idx END), max(ante_idx)) END) AS ante_idx, bool_or(kept) AS is_kept FROM k GROUP BY doc_id, ana_idx),
    pe AS (SELECT a.doc_id, a.mention_idx AS ana_idx, b.mention_idx AS ante_idx, coalesce(a.annotated_set_id = b.annotated_set_id, false) AS is_kept FROM m a JOIN m b ON a.antecedent = b.mention_id AND a.doc_id = b.doc_id
           WHERE a.set_id = b.set_id AND b.mention_idx < a.mention_idx AND b.mention_idx > 0),
    er AS (SELECT 'recall_errors' AS kind, doc_id, ana_idx, ante_idx FROM rc WHERE NOT is_kept UNION ALL SELECT 'precision_errors', doc_id, ana_idx, ante_idx FROM pe WHERE NOT is_kept),
    ca AS (SELECT er.*, coalesce(a.type, '?') AS cat1, coalesce(b.type, '?') AS cat2, a.head_text FROM er JOIN m a ON a.doc_id = er.doc_id AND a.mention_idx = er.ana_idx JOIN m b ON b.doc_id = er.doc_id AND b.mention_idx = er.ante_idx)"""

_SUMS = """
    o AS (SELECT k.doc_id, k.entity AS ke, r.entity AS re, count(*) AS n FROM k JOIN r ON k.doc_id = r.doc_id AND k.mention = r.mention GROUP BY ALL),
    ks AS (SELECT doc_id, entity, count(*) AS n FROM k GROUP BY ALL), rs AS (SELECT doc_id, entity, count(*) AS n FROM r GROUP BY ALL),
    dd AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM k UNION ALL SELECT doc_id FROM r)),"""
_SETS = f"WITH {M}, k AS (SELECT doc_id, mention_idx AS mention, annotated_set_id AS entity FROM m WHERE mention_idx > 0 AND annotated_set_id IS NOT NULL), r AS (SELECT doc_id, mention_idx AS mention, set_id AS entity FROM m WHERE mention_idx > 0 AND set_id IS NOT NULL)," + _SUMS
_EVENTS = f"WITH {E_}, k AS (SELECT doc_id, event_id AS mention, CAST(event_type AS VARCHAR) AS entity FROM e WHERE event_type IS NOT NULL), r AS (SELECT doc_id, event_id AS mention, CAST(response AS VARCHAR) AS entity FROM e WHERE response IS NOT NULL)," + _SUMS


def _rates(name: str, per_doc: str) -> str:
    return f"""
    c AS ({per_doc}), u AS (SELECT doc_id, coalesce(sum(rn), 0) AS rn, coalesce(sum(rd), 0) AS rd, coalesce(sum(pn), 0) AS pn, coalesce(sum(pd), 0) AS pd FROM c GROUP BY GROUPING SETS ((doc_id), ())),
    v AS (SELECT doc_id, coalesce(rn / nullif(rd, 0), 0.0) AS recall, coalesce(pn / nullif(pd, 0), 0.0) AS precision FROM u)
    SELECT '{name}' AS metric, doc_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(coalesce(2 * recall * precision / nullif(recall + precision, 0), 0.0), 6) AS f1 FROM v"""


_D = lambda x: f"CAST(coalesce({x}, 0) AS DOUBLE)"
_PER_DOC = {
    "muc": f"""SELECT dd.doc_id, {_D('x')} AS rn, {_D('a')} AS rd, {_D('x')} AS pn, {_D('b')} AS pd FROM dd LEFT JOIN (SELECT doc_id, sum(n - 1) AS x FROM o GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(n - 1) AS a FROM ks GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n - 1) AS b FROM rs GROUP BY 1) USING (doc_id)""",
    "bcub": f"""SELECT dd.doc_id, {_D('x')} AS rn, {_D('a')} AS rd, {_D('y')} AS pn, {_D('b')} AS pd FROM dd
        LEFT JOIN (SELECT o.doc_id, sum(CAST(o.n * o.n AS DOUBLE) / ks.n) AS x, sum(CAST(o.n * o.n AS DOUBLE) / rs.n) AS y FROM o JOIN ks ON ks.doc_id = o.doc_id AND ks.entity = ke JOIN rs ON rs.doc_id = o.doc_id AND rs.entity = re GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(n) AS a FROM ks GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n) AS b FROM rs GROUP BY 1) USING (doc_id)""",
    "mentions": f"""SELECT dd.doc_id, {_D('x')} AS rn, {_D('a')} AS rd, {_D('x')} AS pn, {_D('b')} AS pd FROM dd LEFT JOIN (SELECT doc_id, sum(n) AS x FROM o GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(n) AS a FROM ks GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n) AS b FROM rs GROUP BY 1) USING (doc_id)""",
}
_TWO_OF = lambda x: f"({x} * ({x} - 1) / 2.0)"
_BLANC = f"""
    kk AS (SELECT doc_id, sum(n) AS mk, sum({_TWO_OF('n')}) AS ck FROM ks GROUP BY 1), rr AS (SELECT doc_id, sum(n) AS mr, sum({_TWO_OF('n')}) AS cr FROM rs GROUP BY 1),
    oo AS (SELECT doc_id, sum(n) AS mm, sum({_TWO_OF('n')}) AS cb FROM o GROUP BY 1),
    ok AS (SELECT doc_id, sum({_TWO_OF('s')}) AS sk FROM (SELECT doc_id, ke, sum(n) AS s FROM o GROUP BY ALL) GROUP BY 1), orr AS (SELECT doc_id, sum({_TWO_OF('s')}) AS sr FROM (SELECT doc_id, re, sum(n) AS s FROM o GROUP BY ALL) GROUP BY 1),
    c AS (SELECT dd.doc_id, {_D('cb')} AS cl, {_D('ck')} AS clk, {_D('cr')} AS clr, {_TWO_OF(_D('mm'))} - {_D('sk')} - {_D('sr')} + {_D('cb')} AS nl, {_TWO_OF(_D('mk'))} - {_D('ck')} AS nlk, {_TWO_OF(_D('mr'))} - {_D('cr')} AS nlr
          FROM dd LEFT JOIN kk USING (doc_id) LEFT JOIN rr USING (doc_id) LEFT JOIN oo USING (doc_id) LEFT JOIN ok USING (doc_id) LEFT JOIN orr USING (doc_id)),
    u AS (SELECT doc_id, sum(cl) AS cl, sum(clk) AS clk, sum(clr) AS clr, sum(nl) AS nl, sum(nlk) AS nlk, sum(nlr) AS nlr FROM c GROUP BY GROUPING SETS ((doc_id), ())),
    v AS (SELECT *, coalesce(cl / nullif(clk, 0), 0.0) AS rc, coalesce(cl / nullif(clr, 0), 0.0) AS pc, coalesce(nl / nullif(nlk, 0), 0.0) AS rn, coalesce(nl / nullif(nlr, 0), 0.0) AS pn FROM u),
    w AS (SELECT *, coalesce(2 * rc * pc / nullif(rc + pc, 0), 0.0) AS fc, coalesce(2 * rn * pn / nullif(rn + pn, 0), 0.0) AS fn FROM v)
    SELECT 'blanc' AS metric, doc_id, """ + ", ".join(f"round(CASE WHEN clk = 0 AND nlk = 0 THEN 0.0 WHEN nlk = 0 THEN {a} WHEN clk = 0 THEN {b} ELSE ({a} + {b}) / 2 END, 6) AS {n}" for a, b, n in (("rc", "rn", "recall"), ("pc", "pn", "precision"), ("fc", "fn", "f1"))) + " FROM w"

_E3 = "doc_id, ana_idx, ante_idx"
ORACLE = {
    "entity_edges": f"{_TWO} SELECT {_E3}, set_id FROM ge",
    "partition_semi": f"{_TWO} SELECT {_E3} FROM ge SEMI JOIN se USING (doc_id, ana_idx, ante_idx)",
    "edge_difference": f"{_TWO} SELECT {_E3} FROM ge ANTI JOIN se USING (doc_id, ana_idx, ante_idx)",
    "recall_closest": f"{_SPAN} SELECT {_E3}, is_kept FROM rc",
    "recall_accessibility": f"{_SPAN} SELECT {_E3}, is_kept FROM ra",
    "precision_errors": f"{_SPAN} SELECT {_E3}, is_kept FROM pe",
    "error_categorize": f"{_SPAN} SELECT kind, cat1, cat2, count(*) AS n_errors FROM ca GROUP BY ALL",
    "error_rollup": f"{_SPAN} SELECT kind, cat1, cat2, count(*) AS n_errors FROM ca GROUP BY ROLLUP (kind, cat1, cat2)",
    "error_pivot": f"{_SPAN} SELECT cat1, nullif(count(CASE WHEN kind = 'recall_errors' THEN 1 END), 0) AS recall_errors, nullif(count(CASE WHEN kind = 'precision_errors' THEN 1 END), 0) AS precision_errors FROM ca GROUP BY 1",
    "common_errors": f"{_SPAN} SELECT {_E3} FROM rc WHERE NOT is_kept INTERSECT SELECT {_E3} FROM ra WHERE NOT is_kept",
    "other_errors": f"{_SPAN} SELECT {_E3} FROM rc WHERE NOT is_kept EXCEPT SELECT {_E3} FROM ra WHERE NOT is_kept",
    "topk_heads": f"{_SPAN}, h AS (SELECT kind, head_text AS head, count(*) AS n FROM ca GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, head) AS rank FROM h) SELECT kind, head, n, rank FROM z WHERE rank <= 10",
    "metric_events": _EVENTS + _rates("bcub", _PER_DOC["bcub"]),
    "metric_mentions": _SETS + _rates("mentions", _PER_DOC["mentions"]),
    "metric_muc": _SETS + _rates("muc", _PER_DOC["muc"]),
    "metric_b3": _SETS + _rates("bcub", _PER_DOC["bcub"]),
    "metric_blanc": _SETS + _BLANC,
    "antecedent_lines": f"""WITH {M} SELECT a.doc_id, a.doc_id || chr(9) || '(' || a.span.begin || ', ' || a.span."end" || ')' || chr(9) || '(' || b.span.begin || ', ' || b.span."end" || ')' AS value
        FROM m a JOIN m b ON a.antecedent = b.mention_id AND a.doc_id = b.doc_id WHERE a.mention_idx > 0 AND b.mention_idx > 0""",
    "coref_column": f"""WITH {M}, t AS (SELECT DISTINCT doc_id, tok_idx FROM tokens WHERE doc_id IS NOT NULL AND tok_idx IS NOT NULL),
        x AS (SELECT doc_id, span.begin AS p, CASE WHEN span.begin = span."end" THEN '(' || set_id || ')' ELSE '(' || set_id END AS s FROM m WHERE set_id IS NOT NULL AND span IS NOT NULL
              UNION ALL SELECT doc_id, span."end", set_id || ')' FROM m WHERE set_id IS NOT NULL AND span.begin <> span."end"),
        y AS (SELECT doc_id, p, array_to_string(list_sort(list(s)), '|') AS s FROM x GROUP BY ALL)
        SELECT t.doc_id, CAST(tok_idx AS BIGINT) AS tok_idx, coalesce(s, '-') AS coref FROM t LEFT JOIN y ON y.doc_id = t.doc_id AND p = tok_idx""",
    "conll_roundtrip": f"""WITH {M} SELECT doc_id, span.begin AS span_begin, span."end" AS span_end, annotated_set_id AS set_id FROM m WHERE annotated_set_id IS NOT NULL AND span IS NOT NULL""",
    "html_identifiers": """WITH d AS (SELECT DISTINCT doc_id FROM tokens WHERE doc_id IS NOT NULL AND tok_idx IS NOT NULL), s AS (SELECT doc_id, split_part(split_part(doc_id, '/', -1), ' ', 1) AS f, split_part(doc_id, ' ', -1) AS l FROM d)
        SELECT doc_id, translate(doc_id, './', '__') AS html_id, left(f, length(f) - 2) || '_part_' || l AS html_conll_id FROM s""",
}
