"""Lookups along a document: neighbours, runs, governors.

Documents differ in length by orders of magnitude, so nothing is windowed over a
whole document: positions are cut into blocks, windows run within a block, and
only one row per block is carried over.  Tokens and what is looked up in them meet in
merge joins: they grow with the data, and a small packed size says little of
what the driver would hold of them in a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8_192


def islands(df: DataFrame, doc: str, pos: str, starts: Column, out: str, previous: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Numbers runs of rows along ``pos``: a row opens a run where ``starts`` holds, or at a document's first row.

    ``previous`` maps new columns, which ``starts`` may use, to the column whose
    value of the preceding row they get (null at the first row).  (doc, pos) is
    unique.  Runs are numbered from 0.
    """
    b = F.floor(F.col(pos) / block).cast("long")
    within = Window.partitionBy(doc, "_block").orderBy(pos)
    rows = df.withColumn("_block", b)
    ends = rows.groupBy(doc, "_block").agg(*[F.max_by(c, pos).alias(f"_last_{n}") for n, c in previous.items()], F.count(F.lit(1)).alias("_k"))
    along = Window.partitionBy(doc).orderBy("_block")
    carried = ends.select(doc, "_block", *[F.lag(f"_last_{n}").over(along).alias(f"_carry_{n}") for n in previous], F.lag("_k").over(along).isNull().alias("_is_first_block"))
    rows = rows.withColumn("_rn", F.row_number().over(within)).join(carried, [doc, "_block"])
    for n, c in previous.items():
        rows = rows.withColumn(n, F.when(F.col("_rn") == 1, F.col(f"_carry_{n}")).otherwise(F.lag(c).over(within)))
    rows = rows.withColumn("_start", (((F.col("_rn") == 1) & F.col("_is_first_block")) | F.coalesce(starts, F.lit(False))).cast("int"))
    sums = rows.groupBy(doc, "_block").agg(F.sum("_start").alias("_n"))
    before = sums.select(doc, "_block", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = F.sum("_start").over(within.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("_local", local).join(before, [doc, "_block"])
    return numbered.withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("int")).drop("_block", "_rn", "_is_first_block", "_start", "_offset", "_local", *[f"_carry_{n}" for n in previous])


def sentence_spans(tokens: DataFrame, doc: str = "doc_id", pos: str = "tok_idx", number: str = "in_sent_idx", block: int = BLOCK) -> DataFrame:
    """(doc, sent_id, begin, end): a sentence starts where the number within the sentence doesn't grow."""
    rows = islands(tokens.select(doc, pos, number), doc, pos, F.col(number) <= F.col("_before"), "sent_id", {"_before": number}, block)
    return rows.groupBy(doc, "sent_id").agg(F.min(pos).alias("begin"), F.max(pos).alias("end"))


def rebased(tokens: DataFrame, doc: str = "doc_id", pos: str = "tok_idx", number: str = "in_sent_idx") -> DataFrame:
    """In-sentence numbers shifted so that a document's first one is 0."""
    first = tokens.groupBy(doc).agg(F.min_by(number, pos).alias("_first"))
    return tokens.join(first, doc).withColumn(number, F.col(number) - F.col("_first")).drop("_first")


def entity_runs(tokens: DataFrame, doc: str = "doc_id", sent: str = "sent_id", pos: str = "tok_idx", tag: str = "pos", ner: str = "ner") -> DataFrame:
    """(doc, sent, begin, end, ner): maximal runs of one entity tag in a sentence, with a possessive mark that follows.

    A null tag is none.  Adjacent entities of the same tag are one run.
    """
    t = F.coalesce(F.col(ner), F.lit("NONE"))
    w = Window.partitionBy(doc, sent).orderBy(pos)
    rows = tokens.select(doc, sent, pos, t.alias("_t"), F.lag(t).over(w).alias("_before"), F.lead(tag).over(w).alias("_next_tag"))
    rows = rows.withColumn("_run", F.sum((F.coalesce(F.col("_t") != F.col("_before"), F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_t <> 'NONE'")
    runs = rows.groupBy(doc, sent, "_run").agg(F.min(pos).alias("begin"), F.max(pos).alias("_end"), F.max_by("_next_tag", pos).alias("_next_tag"), F.min("_t").alias("ner"))
    return runs.select(doc, sent, "begin", (F.col("_end") + F.coalesce((F.col("_next_tag") == "POS").cast("int"), F.lit(0))).alias("end"), "ner")


def with_offsets(items: DataFrame, tokens: DataFrame, keys: list[str], anchor: Column, wanted: dict[str, int], doc: str = "doc_id", pos: str = "tok_idx", value: str = "token") -> DataFrame:
    """Adds the token at ``anchor + offset`` for each (name, offset) of ``wanted``; null beyond the document.

    An equi-join on (document, position), spread evenly however long a document is.
    """
    probes = items.select(*keys, F.col(doc).alias("_doc"), F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (anchor + k).alias("p")) for n, k in wanted.items()])).alias("x"))
    hits = probes.select(*keys, "_doc", "x.n", "x.p").join(tokens.select(F.col(doc).alias("_doc"), F.col(pos).alias("p"), F.col(value).alias("_v")).hint("merge"), ["_doc", "p"])
    found = hits.groupBy(*keys).agg(*[F.max(F.when(F.col("n") == n, F.col("_v"))).alias(n) for n in wanted])
    return items.join(found.hint("merge"), keys, "left")


def context(items: DataFrame, tokens: DataFrame, keys: list[str], begin: Column, end: Column, window: int, out: str = "context", doc: str = "doc_id", pos: str = "tok_idx", value: str = "token") -> DataFrame:
    """Adds the ``|window|`` tokens before (negative) or after a span, across sentences; null if they aren't all in the document or the window is 0."""
    k = abs(window)
    if k == 0:
        return items.withColumn(out, F.lit(None).cast("array<string>"))
    first = end + 1 if window > 0 else begin - k
    probes = items.select(*keys, F.col(doc).alias("_doc"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i + first)).alias("_p"))
    hits = probes.join(tokens.select(F.col(doc).alias("_doc"), F.col(pos).alias("_p"), F.col(value).alias("_v")).hint("merge"), ["_doc", "_p"])
    found = hits.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias(out)).filter(F.size(out) == k)
    return items.join(found.hint("merge"), keys, "left")


def with_governors(tokens: DataFrame, doc: str = "doc_id", sent: str = "sent_id", number: str = "in_sent_idx") -> DataFrame:
    """Adds ``governor`` (lower case, 'NONE' at the root) and ``ancestry`` (two steps of ``-L|R-tag``).

    ``head`` is 1-based within the sentence, 0 at the root; a step goes right
    where the governor stands behind.  A null head has no governor and no ancestry.
    """
    own = F.col(number) + 1
    up = tokens.select(F.col(doc).alias("_d"), F.col(sent).alias("_s"), own.alias("_i"), F.lower("token").alias("_form"), F.col("pos").alias("_tag"), F.col("head").alias("_head"))
    step = lambda k: up.select(F.col("_d").alias(doc), F.col("_s").alias(sent), F.col("_i").alias(f"_h{k}"), *[F.col(f"_{c}").alias(f"_{c}{k}") for c in ("form", "tag", "head")])
    t = tokens.withColumn("_h1", F.col("head")).join(step(1).hint("merge"), [doc, sent, "_h1"], "left").withColumn("_h2", F.col("_head1")).join(step(2).hint("merge"), [doc, sent, "_h2"], "left")
    side = lambda head, at: F.when(head > at, "-R-").otherwise("-L-")
    first = F.when(F.col("_h1") == 0, "-L-NONE").when(F.col("_tag1").isNotNull(), F.concat(side(F.col("_h1"), own), "_tag1"))
    second = F.when(F.col("_h1") == 0, "").when(F.col("_h2") == 0, "-L-NONE").when(F.col("_tag2").isNotNull(), F.concat(side(F.col("_h2"), F.col("_h1")), "_tag2"))
    governor = F.when(F.col("_h1") == 0, "NONE").otherwise(F.col("_form1"))
    return t.withColumns({"governor": governor, "ancestry": F.concat(first, second)}).drop(*[f"_{c}{k}" for c in ("form", "tag", "head", "h") for k in (1, 2)])


def place_in_document(df: DataFrame, doc: str, pos: Column, order: list[Column], out: str, block: int = BLOCK) -> DataFrame:
    """Adds the 1-based place of a row in its document, ordered by ``order``, which starts with ``pos``; rows rank within blocks."""
    rows = df.withColumn("_block", F.floor(pos / block).cast("long"))
    along = Window.partitionBy(doc).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(doc, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(doc, "_block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(doc, "_block").orderBy(*order)))
    return ranked.join(before, [doc, "_block"]).withColumn(out, (F.col("_offset") + F.col("_rn")).cast("int")).drop("_block", "_rn", "_offset")
