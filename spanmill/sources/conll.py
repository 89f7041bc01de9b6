"""CoNLL-2012 text: documents, tokens, sentences, entity tags, coreference spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import span
from ..operators.context import islands, rebased, sentence_spans
from ..storage import write_table

BEGIN, END = "#begin document", "#end document"


def read_documents(spark: SparkSession, path: str | None) -> DataFrame:
    """(doc_id, body): a document per row, split at the header line by the scan itself; no path gives no rows."""
    if path is None:
        return spark.createDataFrame([], "doc_id string, body string")
    raw = spark.read.option("lineSep", BEGIN).text(path)
    return documents_of(raw, "value")


def documents_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, body) of texts that hold whole documents; the header line names a document."""
    parts = texts.select(F.explode(F.split(F.col(column), BEGIN)).alias("part")).filter("trim(part) <> ''")
    head = F.substring_index("part", "\n", 1)
    return parts.select(F.trim(head).alias("doc_id"), F.expr("substring(part, length(substring_index(part, '\n', 1)) + 2)").alias("body"))


def rows(documents: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, cols): the token rows, cut at white space; blank lines and the footer are skipped."""
    lines = F.filter(F.split("body", "\n"), lambda x: (F.trim(F.regexp_replace(x, r"\s+", " ")) != "") & ~F.ltrim(x).startswith(END))
    return documents.select("doc_id", F.posexplode(lines).alias("tok_idx", "line")).select("doc_id", "tok_idx", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("cols"))


def _entity_tags(t: DataFrame, bit: str = "ner_bit") -> DataFrame:
    """Adds ``ner``: a tag opens at '(', holds up to the row with ')', and is NONE elsewhere."""
    opens = F.contains(F.col(bit), F.lit("("))
    r = islands(t, "doc_id", "tok_idx", opens, "_run", {})
    run = r.groupBy("doc_id", "_run").agg(F.min_by(bit, "tok_idx").alias("_first"), F.min(F.when(F.contains(F.col(bit), F.lit(")")), F.col("tok_idx"))).alias("_close"))
    tag = F.regexp_replace("_first", r"[()*]", "")
    held = F.contains(F.col("_first"), F.lit("(")) & (F.col("tok_idx") <= F.coalesce("_close", F.lit(2**31 - 1)))
    return r.join(run, ["doc_id", "_run"]).withColumn("ner", F.when(held, tag).otherwise("NONE")).drop("_run", "_first", "_close")


def tokens(documents: DataFrame, corpus: str = "corpus") -> DataFrame:
    """The ``tokens`` table of (doc_id, body) rows, with the coreference column as ``coref``.

    In-sentence numbers that start at another number than 0 are shifted; a
    sentence starts where the number doesn't grow.
    """
    col = lambda i: F.get("cols", i)
    t = rows(documents).select(
        F.lit(corpus).alias("corpus"), "doc_id", "tok_idx", col(2).cast("int").alias("in_sent_idx"), col(3).alias("token"), col(4).alias("pos"), col(5).alias("parse_bit"),
        col(9).alias("speaker"), col(10).alias("ner_bit"), F.element_at("cols", -1).alias("coref"), F.col("cols").alias("raw_cols"),
    )
    # both steps below read their input several times; written, the text is cut up once
    t = write_table(_entity_tags(write_table(rebased(t), "rows")), "tagged")
    spans = sentence_spans(t)
    at = spans.select("doc_id", "sent_id", F.explode(F.sequence("begin", "end")).alias("tok_idx"))
    return t.join(at, ["doc_id", "tok_idx"]).drop("ner_bit")


def coreference_spans(t: DataFrame, column: str = "coref", strict: bool = False) -> DataFrame:
    """(doc_id, span, set_id): decoded brackets; a closing one ends the innermost open one of its entity.

    A span of several entities keeps the one that closes last.  ``strict`` raises
    an error on brackets without a partner (when rows are read) and leaves out
    pieces like '(1+2)'; otherwise such brackets are left out.
    """
    piece = F.col("x.p")
    pieces = t.filter(F.col(column).isNotNull() & (F.col(column) != "-")).select("doc_id", "tok_idx", F.posexplode(F.split(F.col(column), r"\|")).alias("k", "p")).select("doc_id", "tok_idx", F.struct("k", F.trim("p").alias("p")).alias("x"))
    pieces = pieces.withColumn("set_id", F.regexp_extract(piece, r"^\(?(\d+)\)?$", 1)).filter("set_id <> ''").withColumn("set_id", F.col("set_id").cast("int"))
    opens, closes = piece.startswith("("), piece.endswith(")")
    single = pieces.filter(opens & closes).select("doc_id", span("tok_idx", "tok_idx").alias("span"), "set_id", F.struct("tok_idx", "x.k").alias("_at"))
    events = pieces.filter(opens != closes).withColumn("_d", F.when(opens, 1).otherwise(-1))
    w = Window.partitionBy("doc_id", "set_id").orderBy("tok_idx", "x.k")
    # depth of the bracket: after an opening, before a closing one; at one depth they alternate
    events = events.withColumn("_depth", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("_d") < 0, 1).otherwise(0))
    level = Window.partitionBy("doc_id", "set_id", "_depth").orderBy("tok_idx", "x.k")
    events = events.withColumns({"_open": F.lag("tok_idx").over(level), "_was": F.lag("_d").over(level), "_next": F.lead("_d").over(level)})
    lost = ((F.col("_d") > 0) & ~F.col("_next").eqNullSafe(-1)) | ((F.col("_d") < 0) & ~F.col("_was").eqNullSafe(1))
    pairs = events.filter((F.col("_d") < 0) & (F.col("_was") == 1)).select("doc_id", span("_open", "tok_idx").alias("span"), "set_id", F.struct("tok_idx", "x.k").alias("_at"))
    if strict:  # rows of their own, so that no other filter can come before the error
        alone = F.raise_error(F.concat(F.lit("bracket without a partner in "), "doc_id", F.lit(", entity "), F.col("set_id").cast("string"))).cast("int")
        pairs = pairs.unionByName(events.filter(lost).select("doc_id", span(alone, "tok_idx").alias("span"), "set_id", F.struct("tok_idx", "x.k").alias("_at")))
    return single.unionByName(pairs).groupBy("doc_id", "span").agg(F.max_by("set_id", "_at").alias("set_id"))


def _bracketed(bit: Column) -> Column:
    word = F.concat(F.lit(" ("), F.coalesce("pos", F.lit("XX")), F.lit(" "), F.coalesce("token", F.lit("-")), F.lit(")"))
    return F.replace(F.replace(F.coalesce(bit, F.lit("*")), F.lit("("), F.lit(" (")), F.lit("*"), word)


def sentences(t: DataFrame) -> DataFrame:
    """(corpus, doc_id, sent_id, span, parse): sentences with their bracketed parse."""
    g = t.groupBy("corpus", "doc_id", "sent_id").agg(F.min("tok_idx").alias("b"), F.max("tok_idx").alias("e"), F.array_sort(F.collect_list(F.struct("tok_idx", _bracketed(F.col("parse_bit")).alias("x")))).alias("xs"))
    return g.select("corpus", "doc_id", "sent_id", span("b", "e").alias("span"), F.trim(F.array_join(F.transform("xs", lambda x: x["x"]), "")).alias("parse"))
