"""CoNLL text, antecedent lines, inline tags, models, scores, viewer tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import to_text


def coref_column(tokens: DataFrame, mentions: DataFrame, entity: str = "set_id") -> DataFrame:
    """Tokens with ``coref``: sorted brackets joined by '|', '-' where none; mentions without entity are left out."""
    m = mentions.filter(F.col(entity).isNotNull() & F.col("span").isNotNull())
    e = F.col(entity).cast("string")
    one = F.col("span.begin") == F.col("span.end")
    marks = F.when(one, F.array(F.struct(F.col("span.begin").alias("p"), F.concat(F.lit("("), e, F.lit(")")).alias("s")))).otherwise(
        F.array(F.struct(F.col("span.begin").alias("p"), F.concat(F.lit("("), e).alias("s")), F.struct(F.col("span.end").alias("p"), F.concat(e, F.lit(")")).alias("s")))
    )
    cells = m.select("doc_id", F.explode(marks).alias("x")).groupBy("doc_id", F.col("x.p").alias("tok_idx")).agg(F.array_join(F.array_sort(F.collect_list("x.s")), "|").alias("coref"))
    return tokens.drop("coref").join(cells, ["doc_id", "tok_idx"], "left").withColumn("coref", F.coalesce("coref", F.lit("-")))


def conll_documents(tokens: DataFrame, mentions: DataFrame, entity: str = "set_id") -> DataFrame:
    """(doc_id, text): whole CoNLL documents with the last column from the mentions.

    Rows are ``raw_cols`` where the tokens have them, else built from the
    columns.  A blank line stands between sentences.
    """
    t = coref_column(tokens, mentions, entity)
    c = lambda n, d: F.coalesce(F.col(n).cast("string"), F.lit(d)) if n in t.columns else F.lit(d)
    path = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("doc_id", r"^\((.*)\)", 1), r"\s+", "_"), F.lit("")), F.lit("-"))
    built = F.array(path, F.lit("0"), c("in_sent_idx", "0"), c("token", "-"), c("pos", "XX"), c("parse_bit", "*"), F.lit("-"), F.lit("-"), F.lit("-"), c("speaker", "-"), F.lit("*"))
    cells = F.when(F.col("raw_cols").isNotNull(), F.slice("raw_cols", F.lit(1), F.size("raw_cols") - 1)).otherwise(built) if "raw_cols" in t.columns else built
    line = F.concat(F.array_join(F.concat(cells, F.array("coref")), "\t"), F.lit("\n"))
    rows = t.select("doc_id", "sent_id", "tok_idx", line.alias("line")).groupBy("doc_id", "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "line"))), lambda x: x["line"]), "").alias("s"))
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "s"))), lambda x: x["s"]), "\n").alias("b"))
    return body.select("doc_id", F.concat(F.lit("#begin document "), "doc_id", F.lit("\n"), "b", F.lit("\n#end document\n")).alias("text"))


def write_conll(tokens: DataFrame, mentions: DataFrame, path: str, entity: str = "set_id") -> None:
    conll_documents(tokens, mentions, entity).select(F.rtrim("text").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def antecedent_lines(mentions: DataFrame, antecedent: str = "antecedent_idx") -> DataFrame:
    """(doc_id, value): 'identifier TAB span TAB span' of each mention with an antecedent."""
    ante = mentions.select("doc_id", F.col("mention_idx").alias(antecedent), F.col("span").alias("_ante"))
    m = mentions.filter(F.col(antecedent).isNotNull()).join(ante, ["doc_id", antecedent])
    return m.select("doc_id", F.concat_ws("\t", "doc_id", to_text("span"), to_text("_ante")).alias("value"))


def write_antecedents(mentions: DataFrame, path: str, antecedent: str = "antecedent_idx") -> None:
    antecedent_lines(mentions, antecedent).select("value").write.mode("overwrite").text(path)


def _tagged(words: list[str], found: list[tuple[int, int, int, int | None, int | None]], base: int, zero_is_none: bool) -> str:
    opens: dict[int, list] = {}
    closes: dict[int, int] = {}
    for i, b, e, entity, ante in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        attributes = f'id="{i}" span_start="{b}" span_end="{e}"'
        if entity is not None and (entity or not zero_is_none):
            attributes += f' entity="{entity}"'
        if ante is not None:
            attributes += f' antecedent="{ante}"'
        opens.setdefault(b - base, []).append(f"<mention {attributes}>")
        closes[e - base] = closes.get(e - base, 0) + 1
    return " ".join("".join(opens.get(k, [])) + w + "</mention>" * closes.get(k, 0) for k, w in enumerate(words))


def inline_tags(tokens: DataFrame, mentions: DataFrame, entity: str = "set_id", antecedent: str = "antecedent_idx", zero_is_none: bool = False) -> DataFrame:
    """(doc_id, sent_id, text): a sentence per row with nested mention tags; ids count from 0 without the dummy.

    ``zero_is_none`` leaves the entity 0 out, as some files were made.
    """
    s = tokens.groupBy("doc_id", "sent_id").agg(F.min("tok_idx").alias("base"), F.max("tok_idx").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]).alias("words"))
    m = mentions.filter("mention_idx > 0 AND span IS NOT NULL")
    own = F.col(antecedent) - 1 if antecedent in m.columns else F.lit(None)
    m = m.select("doc_id", F.struct((F.col("mention_idx") - 1).cast("int").alias("i"), F.col("span.begin").alias("b"), F.col("span.end").alias("e"), F.col(entity).cast("int").alias("x"), own.cast("int").alias("a")).alias("m"), F.col("span.begin").alias("_b"))
    at = tokens.select("doc_id", F.col("tok_idx").alias("_b"), "sent_id")
    per = m.join(at, ["doc_id", "_b"]).groupBy("doc_id", "sent_id").agg(F.collect_list("m").alias("ms"))
    none = lambda v: None if v is None or pd.isna(v) else int(v)

    def run(batches):
        for b in batches:
            text = [
                _tagged(list(w), [(int(x["i"]), int(x["b"]), int(x["e"]), none(x["x"]), none(x["a"])) for x in (ms if ms is not None else []) if x["e"] <= last], int(base), zero_is_none)
                for w, ms, base, last in zip(b["words"], b["ms"], b["base"], b["last"])
            ]
            yield pd.DataFrame({"doc_id": b["doc_id"], "sent_id": b["sent_id"], "text": text})

    return s.join(per, ["doc_id", "sent_id"], "left").mapInPandas(run, "doc_id string, sent_id int, text string")


def write_tagged(tags: DataFrame, path: str) -> None:
    """Writes sentences of :func:`inline_tags` as text, a folder per document, a line per sentence in their order."""
    in_order = tags.repartitionByRange("doc_id", "sent_id").sortWithinPartitions("doc_id", "sent_id")
    in_order.select("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_model(model: DataFrame, priors: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(f"{path}/weights")
    priors.write.mode("overwrite").parquet(f"{path}/priors")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/priors")


def html_identifier(doc: Column) -> Column:
    """An identifier fit for HTML: dots and slashes become underscores."""
    return F.translate(doc, "./", "__")


def html_identifier_conll(doc: Column) -> Column:
    """As :func:`html_identifier` for CoNLL identifiers: last part of the path, '_part_', last word."""
    last = F.substring_index(doc, "/", -1)
    first = F.substring_index(last, " ", 1)
    return F.concat(F.regexp_replace(first, r"..$", ""), F.lit("_part_"), F.substring_index(doc, " ", -1))
