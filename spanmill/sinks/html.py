"""Self-contained pages to look at documents: entities in colour, errors and decisions as links."""

from __future__ import annotations

import html
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .writers import html_identifier

_STYLE = """
body { font-family: sans-serif; margin: 2em; display: flex; gap: 2em } main { max-width: 60em; line-height: 2 } nav { min-width: 18em; font-size: 90% }
.m { border-bottom: 2px solid; cursor: pointer; padding: 0 .1em } .lit { background: #ffe9a8 } .end { background: #ffc9b8 } li { cursor: pointer }
"""
_SCRIPT = """
const all = q => [...document.querySelectorAll(q)];
const clear = () => all('.lit, .end').forEach(x => x.classList.remove('lit', 'end'));
all('.m').forEach(x => { x.style.borderColor = x.dataset.e ? `hsl(${x.dataset.e * 137 % 360} 60% 45%)` : '#bbb';
  x.onclick = e => { e.stopPropagation(); clear(); if (x.dataset.e) all(`.m[data-e="${x.dataset.e}"]`).forEach(y => y.classList.add('lit')); }; });
all('li[data-a]').forEach(x => x.onclick = () => { clear(); all(`[id="m${x.dataset.a}"], [id="m${x.dataset.b}"]`).forEach(y => y.classList.add('end'));
  document.getElementById('m' + x.dataset.a)?.scrollIntoView({ block: 'center' }); });
"""


def _marked(words: list[str], found: list[tuple[int, int, int, int | None]], base: int) -> str:
    opens: dict[int, list[str]] = {}
    closes: dict[int, int] = {}
    for i, b, e, entity in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        opens.setdefault(b - base, []).append(f'<span class="m" id="m{i}" data-e="{"" if entity is None else entity}">')
        closes[e - base] = closes.get(e - base, 0) + 1
    return " ".join("".join(opens.get(k, [])) + html.escape(w or "") + "</span>" * closes.get(k, 0) for k, w in enumerate(words))


def _sentences(batches):
    for b in batches:
        text = []
        for words, ms, base, last in zip(b["words"], b["ms"], b["base"], b["last"]):
            found = [(int(x["i"]), int(x["b"]), int(x["e"]), None if pd.isna(x["x"]) else int(x["x"])) for x in (ms if ms is not None else []) if x["e"] <= last]
            text.append(_marked(list(words), found, int(base)))
        yield pd.DataFrame({"doc_id": b["doc_id"], "sent_id": b["sent_id"], "text": text})


def document_pages(tokens: DataFrame, mentions: DataFrame, errors: DataFrame | None = None, entity: str = "set_id") -> DataFrame:
    """(doc_id, name, page): a page per document with its mentions and, by system, kind and category, its errors.

    ``errors`` has (system, kind, doc_id, ana_idx, ante_idx) and optionally
    ``cat1``.  A mention across sentences isn't marked; a null token is empty.
    """
    words = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", F.coalesce("token", F.lit("")).alias("token")))), lambda x: x["token"])
    s = tokens.groupBy("doc_id", "sent_id").agg(F.min("tok_idx").alias("base"), F.max("tok_idx").alias("last"), words.alias("words"))
    m = mentions.filter("mention_idx > 0 AND span IS NOT NULL")
    m = m.select("doc_id", F.col("span.begin").alias("_b"), F.struct(F.col("mention_idx").alias("i"), F.col("span.begin").alias("b"), F.col("span.end").alias("e"), F.col(entity).cast("int").alias("x")).alias("m"))
    per = m.join(tokens.select("doc_id", F.col("tok_idx").alias("_b"), "sent_id"), ["doc_id", "_b"]).groupBy("doc_id", "sent_id").agg(F.collect_list("m").alias("ms"))
    lines = s.join(per, ["doc_id", "sent_id"], "left").mapInPandas(_sentences, "doc_id string, sent_id int, text string")
    body = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "text"))), lambda x: F.concat(F.lit("<p>"), x["text"], F.lit("</p>"))), "\n").alias("body"))
    if errors is None:
        body = body.withColumn("items", F.lit(None).cast("string"))
    else:
        category = F.concat(F.lit(", "), F.col("cat1")) if "cat1" in errors.columns else F.lit("")
        label = F.concat_ws(" ", "system", F.translate("kind", "_", " "))
        item = F.format_string('<li data-a="%d" data-b="%d">%s: %d to %d%s</li>', "ana_idx", "ante_idx", label, "ana_idx", "ante_idx", F.coalesce(category, F.lit("")))
        items = errors.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("items"))
        body = body.join(items, "doc_id", "left")
    escaped = F.replace(F.replace(F.replace(F.col("doc_id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped, F.lit(f"</title><style>{_STYLE}</style></head><body><nav><h3>Links</h3><ul>"),
        F.coalesce("items", F.lit("")), F.lit("</ul></nav><main><h1>"), escaped, F.lit("</h1>"), F.col("body"), F.lit(f"</main><script>{_SCRIPT}</script></body></html>"),
    )
    return body.select("doc_id", F.regexp_replace(html_identifier(F.col("doc_id")), r"[^\w-]+", "_").alias("name"), page.alias("page"))


def write_pages(pages: DataFrame, folder: str) -> int:
    """Writes each page into a local folder, one document at a time, for somebody to look at; returns their number."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in pages.toLocalIterator():
        with open(os.path.join(folder, f"{r['name']}.html"), "w", encoding="utf-8") as f:
            f.write(r["page"])
        n += 1
    return n
