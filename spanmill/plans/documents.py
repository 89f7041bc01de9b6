"""Queries along documents: tokens, sentences, runs, mentions and their attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..operators import context, decode
from ..operators import mentions as men
from ..session import table
from ..sources.rawtext import tagged_mentions, tokenized
from .base import M, T, mentions, tokens, with_strings


def tokens_basic(spark: SparkSession, sf: str) -> DataFrame:
    w = tokenized(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(w, F.array().cast("array<string>")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"), F.get("w", 0).alias("first_token"))


def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = context.sentence_spans(tokens(spark, sf, "doc_id", "tok_idx", "in_sent_idx"))
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_no"), F.col("begin").cast("long").alias("span_begin"), F.col("end").cast("long").alias("span_end"))


def tag_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = context.entity_runs(tokens(spark, sf, "doc_id", "sent_id", "tok_idx", "pos", "ner"))
    return r.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("begin").cast("long").alias("span_begin"), F.col("end").cast("long").alias("span_end"), "ner")


def context_window(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, "doc_id", "mention_idx", "span").filter("mention_idx > 0")
    t = tokens(spark, sf, "doc_id", "tok_idx", "token")
    key = ["mention_id"]
    m = context.with_offsets(m, t, key, F.col("span.begin"), {"preceding": -1})
    m = context.with_offsets(m, t, key, F.col("span.end"), {"following": 1})
    m = context.context(m, t, key, F.col("span.begin"), F.col("span.end"), 2)
    return m.select("mention_id", "preceding", "following", F.array_join("context", " ").alias("next_two"))


def governors(spark: SparkSession, sf: str) -> DataFrame:
    g = context.with_governors(tokens(spark, sf, "doc_id", "sent_id", "tok_idx", "in_sent_idx", "token", "pos", "head"))
    return g.select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "governor", "ancestry")


def pronoun_attributes(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, "mention_idx", "tokens", "pos", "ner", "head", "head_index").filter("mention_idx > 0")
    c = F.col
    m = m.withColumn("kind", A.mention_type(c("pos"), c("ner"), c("head_index")))
    m = m.withColumn("form", F.when(c("kind") == "PRO", A.citation_form(c("tokens"))))
    m = m.withColumns({"fine": A.fine_type(c("kind"), c("tokens"), c("pos")), "num": A.number(c("kind"), c("form"), c("head"), c("pos"), c("head_index")), "cls": A.semantic_class(c("kind"), c("form"), c("ner"), c("head_index"))})
    m = m.withColumn("gen", A.gender(c("kind"), c("num"), c("form"), c("tokens"), c("ner"), c("head_index"), c("cls"), F.lit(None).cast("string")))
    return m.select("mention_id", c("kind").alias("type"), c("form").alias("citation_form"), c("fine").alias("fine_type"), c("num").alias("number"), c("cls").alias("semantic_class"), c("gen").alias("gender"))


def gender_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, "mention_idx", "tokens", "head").filter("mention_idx > 0")
    lex = A.gender_lexicon(table(spark, sf, "gender_list"))
    return A.with_listed_gender(m, lex, ["mention_id"]).select("mention_id", "listed_gender")


def mention_strings(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, "mention_idx", "tokens", "pos", "head", "span", "head_span").filter("mention_idx > 0")
    c = F.col
    mods = F.array_sort(A.modifiers(c("tokens"), c("pos"), c("span"), c("head_span")))
    return with_strings(m).select("mention_id", A.lowercase_string(A.cleaned_tokens(c("tokens"), c("pos"))).alias("clean"), F.array_join(mods, " ").alias("modifiers"), "head_as_lowercase_string", "tokens_as_lowercase_string")


def _filterable(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf, "doc_id", "mention_idx", "sent_id", "span", "tokens", "pos", "ner", "head_span", "head_index", "is_apposition", "type").filter("mention_idx > 0")


def mention_same_head(spark: SparkSession, sf: str) -> DataFrame:
    return men.same_head_largest(_filterable(spark, sf)).select("mention_id")


def mention_embedded_head(spark: SparkSession, sf: str) -> DataFrame:
    return men.embedded_head(_filterable(spark, sf)).select("mention_id")


def mention_filters(spark: SparkSession, sf: str) -> DataFrame:
    return men.no_noises(men.no_numeric_names(men.no_adjective_heads(_filterable(spark, sf)))).select("mention_id")


def mention_nested_anti(spark: SparkSession, sf: str) -> DataFrame:
    m = _filterable(spark, sf).withColumns({"tree": F.lit(""), "child_trees": F.array(F.lit("-"), F.lit("-"))})
    return men.no_parts_of_appositions(m).select("mention_id")


def pleonastic_filter(spark: SparkSession, sf: str) -> DataFrame:
    return men.no_pleonastic(_filterable(spark, sf), tokens(spark, sf, "doc_id", "tok_idx", "token")).select("mention_id")


def first_in_entity(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf, "doc_id", "mention_idx", "annotated_set_id").filter("mention_idx > 0")
    return decode.first_in_entity(m, out="is_first").select("mention_id", "is_first")


def tagged_text(spark: SparkSession, sf: str) -> DataFrame:
    m = tagged_mentions(table(spark, sf, "documents"))
    return m.select("doc_id", "id", F.col("span.begin").alias("span_begin"), F.col("span.end").alias("span_end"), "set_id", "antecedent")


def system_mentions(spark: SparkSession, sf: str) -> DataFrame:
    m = men.system_mentions(tokens(spark, sf), A.gender_lexicon(table(spark, sf, "gender_list")))
    return m.select("doc_id", "mention_idx", "span", "type", "fine_type", "citation_form", "number", "gender", "semantic_class", "grammatical_function", "governor", "ancestry", "head_as_lowercase_string")


QUERIES = {
    f.__name__: f
    for f in (
        tokens_basic, sentence_spans, tag_runs, context_window, governors, pronoun_attributes, gender_lookup, mention_strings, mention_same_head, mention_embedded_head, mention_filters,
        mention_nested_anti, pleonastic_filter, first_in_entity, tagged_text, system_mentions,
    )
}

_PRO = "CASE WHEN w IN ('he','him','himself','his') THEN 'he' WHEN w IN ('she','her','herself','hers') THEN 'she' WHEN w IN ('it','itself','its') THEN 'it' WHEN w IN ('they','them','themselves','theirs','their') THEN 'they' WHEN w IN ('i','me','myself','mine','my') THEN 'i' WHEN w IN ('you','yourself','yourselves','yours','your') THEN 'you' WHEN w IN ('we','us','ourselves','ours','our') THEN 'we' END"

ORACLE = {
    "tokens_basic": """
        WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+') IF x <> ''] AS w FROM documents)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS n_chars, w[1] AS first_token FROM w""",
    "sentence_spans": f"""
        WITH {T}, f AS (SELECT doc_id, tok_idx, CASE WHEN lag(in_sent_idx) OVER w IS NULL OR in_sent_idx <= lag(in_sent_idx) OVER w THEN 1 ELSE 0 END AS s FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)),
             g AS (SELECT doc_id, tok_idx, sum(s) OVER (PARTITION BY doc_id ORDER BY tok_idx) - 1 AS sent_no FROM f)
        SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST(min(tok_idx) AS BIGINT) AS span_begin, CAST(max(tok_idx) AS BIGINT) AS span_end FROM g GROUP BY ALL""",
    "tag_runs": f"""
        WITH {T}, x AS (SELECT doc_id, sent_id, tok_idx, coalesce(ner, 'NONE') AS n, lag(coalesce(ner, 'NONE')) OVER w AS b, lead(pos) OVER w AS p FROM t WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_idx)),
             y AS (SELECT *, sum(CASE WHEN b IS NULL OR n <> b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx) AS r FROM x)
        SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(min(tok_idx) AS BIGINT) AS span_begin, CAST(max(tok_idx) + CASE WHEN arg_max(coalesce(p, ''), tok_idx) = 'POS' THEN 1 ELSE 0 END AS BIGINT) AS span_end, min(n) AS ner
        FROM y WHERE n <> 'NONE' GROUP BY doc_id, sent_id, r""",
    "context_window": f"""
        WITH {T}, {M}
        SELECT mention_id, a.token AS preceding, b.token AS "following", b.token || ' ' || c.token AS next_two FROM m
        LEFT JOIN t a ON a.doc_id = m.doc_id AND a.tok_idx = m.span.begin - 1 LEFT JOIN t b ON b.doc_id = m.doc_id AND b.tok_idx = m.span."end" + 1 LEFT JOIN t c ON c.doc_id = m.doc_id AND c.tok_idx = m.span."end" + 2
        WHERE mention_idx > 0""",
    "governors": f"""
        WITH {T}
        SELECT t.doc_id, CAST(t.tok_idx AS BIGINT) AS tok_idx, CASE WHEN t.head = 0 THEN 'NONE' ELSE lower(a.token) END AS governor,
               CASE WHEN t.head = 0 THEN '-L-NONE' ELSE CASE WHEN t.head > t.in_sent_idx + 1 THEN '-R-' ELSE '-L-' END || a.pos ||
                    CASE WHEN a.head = 0 THEN '-L-NONE' ELSE CASE WHEN a.head > t.head THEN '-R-' ELSE '-L-' END || b.pos END END AS ancestry
        FROM t LEFT JOIN t a ON a.doc_id = t.doc_id AND a.sent_id = t.sent_id AND a.in_sent_idx + 1 = t.head LEFT JOIN t b ON b.doc_id = t.doc_id AND b.sent_id = t.sent_id AND b.in_sent_idx + 1 = a.head""",
    "pronoun_attributes": f"""
        WITH {M}, a AS (SELECT mention_id, lower(tokens[1]) AS w, pos[1] AS p1, pos[head_index + 1] AS p, coalesce(ner[head_index + 1], 'NONE') AS n, lower(head[1]) AS h FROM m WHERE mention_idx > 0),
             b AS (SELECT *, CASE WHEN p LIKE 'NNP%' OR n <> 'NONE' THEN 'NAM' WHEN p LIKE 'PRP%' THEN 'PRO' WHEN p LIKE 'DT%' THEN 'DEM' WHEN p LIKE 'VB%' THEN 'VRB' ELSE 'NOM' END AS kind FROM a),
             c AS (SELECT *, CASE WHEN kind = 'PRO' THEN {_PRO} END AS form FROM b),
             d AS (SELECT *, CASE WHEN kind = 'NOM' THEN CASE WHEN w IN ('the','this','that','these','those','my','your','his','her','its','our','their') OR p1 = 'NNP' THEN 'DEF' ELSE 'INDEF' END
                        WHEN kind = 'PRO' THEN CASE WHEN w IN ('i','you','he','she','it','we','they') THEN 'PERS_NOM' WHEN w IN ('me','you','him','her','it','us','them') THEN 'PERS_ACC'
                             WHEN w IN ('myself','yourself','yourselves','himself','herself','itself','ourselves','themselves') THEN 'REFL'
                             WHEN p1 = 'PRP' AND w IN ('','mine','yours','his','hers','its','ours','theirs') THEN 'POSS' WHEN p1 = 'PRP$' AND w IN ('my','your','his','her','its','our','their') THEN 'POSS_ADJ' END END AS fine,
                        CASE WHEN p = 'CC' THEN 'PLURAL' WHEN kind = 'PRO' THEN CASE WHEN form IN ('i','you','he','she','it') THEN 'SINGULAR' ELSE 'PLURAL' END
                             WHEN kind = 'DEM' THEN CASE WHEN h IN ('this','that') THEN 'SINGULAR' ELSE 'PLURAL' END
                             WHEN kind IN ('NOM','NAM') THEN CASE WHEN p IN ('NNS','NNPS') THEN 'PLURAL' ELSE 'SINGULAR' END ELSE 'UNKNOWN' END AS num,
                        CASE WHEN kind = 'PRO' THEN CASE WHEN form IN ('i','you','he','she','we') THEN 'PERSON' WHEN form = 'it' THEN 'OBJECT' ELSE 'UNKNOWN' END WHEN kind = 'DEM' THEN 'OBJECT'
                             WHEN n <> 'NONE' THEN CASE WHEN n = 'PERSON' THEN 'PERSON' WHEN regexp_matches(n, '^(DATE|TIME|NUMBER|QUANTITY|MONEY|PERCENT)') THEN 'NUMERIC' ELSE 'OBJECT' END ELSE 'UNKNOWN' END AS cls FROM c),
             e AS (SELECT *, CASE WHEN num = 'PLURAL' THEN 'PLURAL' WHEN kind = 'PRO' THEN CASE WHEN form = 'he' THEN 'MALE' WHEN form = 'she' THEN 'FEMALE' WHEN form IN ('you','we','they') THEN 'PLURAL' END
                        WHEN kind = 'NAM' THEN CASE WHEN w IN ('mr','mr.') THEN 'MALE' WHEN w IN ('miss','ms','mrs','miss.','ms.','mrs.') THEN 'FEMALE' END END AS g FROM d)
        SELECT mention_id, kind AS type, form AS citation_form, fine AS fine_type, num AS number, cls AS semantic_class,
               CASE WHEN coalesce(g, 'NEUTRAL') = 'NEUTRAL' AND cls = 'PERSON' THEN 'UNKNOWN' ELSE coalesce(g, 'NEUTRAL') END AS gender FROM e""",
    "gender_lookup": f"""
        WITH {M}, r AS (SELECT * FROM (VALUES ('MALE', 1), ('FEMALE', 2), ('NEUTRAL', 3), ('PLURAL', 4)) AS r(g, k)),
             l AS (SELECT trim(word) AS word, arg_max(g, k) AS gender FROM gender_list JOIN r ON g = upper(trim(gender)) WHERE trim(word) <> '' GROUP BY 1),
             p AS (SELECT mention_id, 0 AS s, array_to_string(tokens, ' ') AS word FROM m WHERE mention_idx > 0 UNION ALL SELECT mention_id, 1, array_to_string(head, ' ') FROM m WHERE mention_idx > 0
                   UNION ALL SELECT mention_id, 2 + i, h FROM (SELECT mention_id, unnest(head) AS h, generate_subscripts(head, 1) AS i FROM m WHERE mention_idx > 0) WHERE regexp_matches(h, '^\\p{{Lu}}')),
             b AS (SELECT mention_id, arg_min(gender, s) AS g FROM p JOIN l USING (word) GROUP BY 1)
        SELECT m.mention_id, b.g AS listed_gender FROM m LEFT JOIN b USING (mention_id) WHERE mention_idx > 0""",
    "mention_strings": f"""
        WITH {M}, i AS (SELECT *, range(1, len(tokens) + 1) AS ix FROM m WHERE mention_idx > 0)
        SELECT mention_id, lower(array_to_string([tokens[i] FOR i IN ix IF coalesce(pos[i], '') NOT IN ('DT', 'POS')], ' ')) AS clean,
               array_to_string(list_sort(list_distinct([lower(tokens[i]) FOR i IN ix IF lower(tokens[i]) NOT IN ('the','this','that','those','these','a','an') AND coalesce(pos[i], '') NOT IN ('POS', 'IN')
                   AND (i - 1 < head_span.begin - span.begin OR i - 1 > head_span."end" - span.begin)])), ' ') AS modifiers, head_text AS head_as_lowercase_string, text AS tokens_as_lowercase_string FROM i""",
    "mention_same_head": f"""
        WITH {M}, r AS (SELECT mention_id, row_number() OVER (PARTITION BY doc_id, head_span ORDER BY span."end" - span.begin DESC, span.begin DESC, span."end" DESC) AS k FROM m WHERE mention_idx > 0)
        SELECT mention_id FROM r WHERE k = 1""",
    "mention_embedded_head": f"""
        WITH {M} SELECT mention_id FROM (SELECT mention_id, head_span.begin AS b, min(head_span.begin) OVER (PARTITION BY doc_id, head_span."end") AS f FROM m WHERE mention_idx > 0) WHERE b = f""",
    "mention_filters": f"""
        WITH {M} SELECT mention_id FROM m WHERE mention_idx > 0 AND NOT coalesce(pos[head_index + 1], '') LIKE 'JJ%'
             AND NOT (coalesce(type, '') = 'NAM' AND coalesce(ner[head_index + 1], '') IN ('QUANTITY','CARDINAL','ORDINAL','MONEY','PERCENT'))
             AND text NOT IN ('mm','hmm','ahem','um') AND array_to_string(tokens, ' ') NOT IN ('US','U.S.')""",
    "mention_nested_anti": f"""
        WITH {M} SELECT mention_id FROM m WHERE mention_idx > 0 AND (coalesce(type, '') = 'PRO' OR NOT EXISTS (
            SELECT 1 FROM m a WHERE a.is_apposition AND a.mention_idx > 0 AND a.doc_id = m.doc_id AND a.sent_id = m.sent_id AND a.span.begin <= m.span.begin AND a.span."end" >= m.span."end" AND a.span <> m.span))""",
    "pleonastic_filter": f"""
        WITH {T}, {M} SELECT mention_id FROM m LEFT JOIN t a ON a.doc_id = m.doc_id AND a.tok_idx = m.span."end" + 1 LEFT JOIN t b ON b.doc_id = m.doc_id AND b.tok_idx = m.span."end" + 2
             LEFT JOIN t c ON c.doc_id = m.doc_id AND c.tok_idx = m.span."end" + 3
        WHERE mention_idx > 0 AND NOT (text = 'it' AND (coalesce(b.token, '') = 'that' OR coalesce(c.token, '') = 'that')) AND NOT (text = 'you' AND coalesce(a.token, '') = 'know')""",
    "first_in_entity": f"""
        WITH {M} SELECT mention_id, mention_idx = min(mention_idx) OVER (PARTITION BY doc_id, annotated_set_id) AS is_first FROM m WHERE mention_idx > 0""",
    "tagged_text": r"""
        WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '<mention\b([^>]*)>', 1)) AS a FROM documents),
             v AS (SELECT doc_id, TRY_CAST(regexp_extract(a, '(?:^|\s)id="?(-?\d+)"?', 1) AS INT) AS id, TRY_CAST(regexp_extract(a, '(?:^|\s)span_start="?(-?\d+)"?', 1) AS INT) AS span_begin,
                          TRY_CAST(regexp_extract(a, '(?:^|\s)span_end="?(-?\d+)"?', 1) AS INT) AS span_end, TRY_CAST(regexp_extract(a, '(?:^|\s)entity="?(-?\d+)"?', 1) AS INT) AS entity,
                          TRY_CAST(regexp_extract(a, '(?:^|\s)antecedent="?(-?\d+)"?', 1) AS INT) AS antecedent FROM a),
             k AS (SELECT * FROM v WHERE id IS NOT NULL AND span_begin IS NOT NULL AND span_end IS NOT NULL)
        SELECT doc_id, id, span_begin, span_end, coalesce(entity, coalesce(max(entity) OVER (PARTITION BY doc_id), 0) + 1 + id) AS set_id, antecedent FROM k""",
}
