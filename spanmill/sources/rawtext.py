"""Plain and tagged text, and the output of an annotation service."""

from __future__ import annotations

import json
import re
import struct
import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, numbers with their separators, clitics, single marks.
_WORD = re.compile(r"[^\W\d_]+(?=n['’]t\b)|n['’]t\b|['’](?:s|m|re|ve|ll|d)\b|\d+(?:[.,:]\d+)*|(?:[^\W\d_]\.){2,}|\w+(?:-\w+)*|\S")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+(?=\S)|\n+")


def tokenized(column: Column) -> Column:
    """White-space tokens, null for null."""
    return F.filter(F.split(column, "[ \t\n\r]+"), lambda t: t != "")


def annotate_plain(text: str) -> dict:
    """The built-in annotator: sentences with tokens only, in the shape of the service's JSON."""
    out = []
    for part in _SENTENCE.split(text):
        words = _WORD.findall(part or "")
        if words:
            out.append({"tokens": words})
    return {"sentences": out}


class AnnotationClient:
    """A long-lived annotation process with a line protocol: 'PARSEDOC TAB json' in, 8-byte length and JSON out."""

    def __init__(self, command: list[str]) -> None:
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def _ask(self, line: str) -> bytes:
        self.process.stdin.write(line.encode() + b"\n")
        self.process.stdin.flush()
        size = self.process.stdout.read(8)
        if len(size) < 8:
            raise ConnectionError("the annotation process ended")
        (n,) = struct.unpack(">Q", size)
        return self.process.stdout.read(n)

    def ping(self) -> bool:
        return bool(self._ask("PING\t"))

    def __call__(self, text: str) -> dict:
        return json.loads(self._ask("PARSEDOC\t" + json.dumps(text)))

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait(10)


#: Fields of a sentence in the service's JSON.
SENTENCE_JSON = "sentences array<struct<tokens:array<string>,pos:array<string>,lemmas:array<string>,ner:array<string>,normner:array<string>,parse:string,char_offsets:array<array<int>>,deps_basic:array<array<string>>,deps_cc:array<array<string>>>>"


def annotated_json(df: DataFrame, json_column: str = "json", doc: str = "doc_id") -> DataFrame:
    """Tokens of the service's JSON: (doc_id, sent_id, in_sent_idx, tok_idx, token, pos, ner, head, deprel, parse, speaker).

    Entity tags O and MISC, and missing ones, are NONE; a token without
    dependency hangs on the root as 'punc'.  Damaged JSON gives no rows.
    """
    s = df.select(F.col(doc).alias("doc_id"), F.posexplode(F.from_json(json_column, f"struct<{SENTENCE_JSON.replace(' ', ':', 1)}>")["sentences"]).alias("sent_id", "s"))
    lengths = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", F.size("s.tokens").alias("n")))).alias("_n"))  # a short row per sentence
    offset = F.aggregate(F.filter("_n", lambda x: x["sent_id"] < F.col("sent_id")), F.lit(0), lambda a, x: a + x["n"])
    t = s.join(lengths, "doc_id").select("doc_id", "sent_id", "s", offset.alias("_o"), F.posexplode("s.tokens").alias("in_sent_idx", "token"))
    tag = F.get("s.ner", F.col("in_sent_idx"))
    dep = F.get(F.filter("s.deps_basic", lambda d: F.get(d, 2).cast("int") == F.col("in_sent_idx")), 0)
    return t.select(
        "doc_id", "sent_id", "in_sent_idx", (F.col("_o") + F.col("in_sent_idx")).alias("tok_idx"), "token", F.get("s.pos", F.col("in_sent_idx")).alias("pos"),
        F.when(tag.isNull() | tag.isin("O", "MISC"), "NONE").otherwise(tag).alias("ner"),
        F.coalesce(F.get(dep, 1).cast("int") + 1, F.lit(0)).alias("head"), F.coalesce(F.get(dep, 0), F.lit("punc")).alias("deprel"), F.col("s.parse").alias("parse"), F.lit("-").alias("speaker"),
    )


def annotate(documents: DataFrame, annotator: Callable[[], Callable[[str], dict]] = lambda: annotate_plain, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Tokens of plain texts; ``annotator`` makes the annotating function, once per Python worker."""

    def run(batches):
        f = annotator()
        for b in batches:
            yield pd.DataFrame({"doc_id": b[doc].astype(str), "json": [json.dumps(f(t)) for t in b[text]]})

    made = documents.select(doc, text).filter(F.length(text) > 0).mapInPandas(run, "doc_id string, json string")
    return annotated_json(made)


_TAG = r"<mention\b([^>]*)>|</mention>"


def tagged_mentions(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, id, span, set_id, antecedent) of ``<mention id span_start span_end entity? antecedent?>`` tags.

    A mention without entity gets one of its own behind the document's largest;
    tags without an id or a span are left out.
    """
    tags = documents.select(F.col(doc).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(r"<mention\b([^>]*)>"), F.lit(1))).alias("a"))
    value = lambda name: F.nullif(F.regexp_extract("a", rf'(?:^|\s){name}="?(-?\d+)"?', 1), F.lit("")).cast("int")
    m = tags.select("doc_id", value("id").alias("id"), value("span_start").alias("begin"), value("span_end").alias("end"), value("entity").alias("entity"), value("antecedent").alias("antecedent")).filter("id IS NOT NULL AND begin IS NOT NULL AND end IS NOT NULL")
    top = m.groupBy("doc_id").agg(F.coalesce(F.max("entity"), F.lit(0)).alias("_top"))
    own = F.coalesce(F.col("entity"), F.col("_top") + 1 + F.col("id"))
    return m.join(top, "doc_id").select("doc_id", "id", F.struct("begin", "end").alias("span"), own.alias("set_id"), "antecedent")


def untagged(text: Column) -> Column:
    return F.regexp_replace(text, _TAG, "")


