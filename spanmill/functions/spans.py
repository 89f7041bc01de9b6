"""Inclusive token spans as ``STRUCT<begin, end>``; struct order is span order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SpanLike = Column | str


def _c(x: SpanLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def span(begin: SpanLike, end: SpanLike) -> Column:
    return F.struct(_c(begin).cast("int").alias("begin"), _c(end).cast("int").alias("end"))


def length(s: SpanLike) -> Column:
    return _c(s)["end"] - _c(s)["begin"] + 1


def embeds(outer: SpanLike, inner: SpanLike) -> Column:
    """Whether ``inner`` lies in ``outer``; a span embeds itself."""
    o, i = _c(outer), _c(inner)
    return (o["begin"] <= i["begin"]) & (i["end"] <= o["end"])


def embeds_strictly(outer: SpanLike, inner: SpanLike) -> Column:
    return embeds(outer, inner) & (_c(outer) != _c(inner))


def parse(text: SpanLike) -> Column:
    """``(b, e)`` with or without the blank; null for anything else."""
    part = lambda i: F.regexp_extract(_c(text), r"^\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*$", i)
    return F.when(part(1) != "", span(part(1), part(2)))


def to_text(s: SpanLike) -> Column:
    """``(b, e)``; null for a null span."""
    return F.when(_c(s).isNotNull(), F.concat(F.lit("("), _c(s)["begin"].cast("string"), F.lit(", "), _c(s)["end"].cast("string"), F.lit(")")))
