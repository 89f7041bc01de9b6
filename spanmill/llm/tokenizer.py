"""Problem 7: the corpus encoded with a public byte-level BPE vocabulary, on the JVM.

A text is split into words by the vocabulary's pattern.  A distinct word is folded
once: its UTF-8 bytes (in hexadecimal, so that a rank is looked up by a string)
are the first pieces, and each step of ``aggregate`` joins all places of the pair
of lowest rank, from left to right, until no pair has a rank.  The rank map is a
literal of the plan: an array of small buckets addressed by a hash of the piece,
because a lookup in one Spark map of 50,000 entries would scan it.

The most frequent words are folded first, after one map-side combined count, and
become a second literal of bounded size.  One pass then codes every text: known
words as their ids, others as ``?`` and their bytes.  The others, a small part of
all occurrences, are a table of distinct words, folded once each, and their ids
are joined back to the texts that have them.  Texts with known words only are
never shuffled.
"""

from __future__ import annotations

import base64
import os

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: White space by the Unicode property, and the vocabulary's pattern with it; possessive runs, letters first.
_SPACE = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf" ?\p{{L}}++|'(?:[stmd]|re|ve|ll)| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Words of the dictionary literal at most, and bytes of one of them at most: some 20 MB.
DICTIONARY_WORDS = 65_536
DICTIONARY_BYTES = 48

#: Words of at most so many bytes are folded place by place, longer ones pair by pair; the ids are the same.
SHORT = 64

_BUCKETS = 65_536
_NO_RANK = 2_147_483_647

#: Separators inside the constants; a dictionary word never holds one of them.
_NEXT_BUCKET, _KEY, _VALUE = "\x01", "\x02", "\x03"


def _as_literal(pairs: list[tuple[str, str]]) -> Column:
    """A lookup as one constant: an array of strings, position = low bits of the key's 64-bit hash.

    A bucket is written ``KEY key VALUE value KEY KEY key VALUE value KEY``.  Plain
    strings keep the constant small in a task: a map would be unpacked again by each.
    """
    buckets = [""] * _BUCKETS
    for k, v in pairs:
        buckets[xxhash.xxh64_intdigest(k.encode(), seed=42) % _BUCKETS] += f"{_KEY}{k}{_VALUE}{v}{_KEY}"
    return F.split(F.lit(_NEXT_BUCKET.join(buckets)), _NEXT_BUCKET)


def _look_up(literal: Column, key: Column, missing: Column) -> Column:
    """The value of ``key`` as a string, ``missing`` where the lookup lacks it: an entry of it stands before the bucket, and the last one counts."""
    bucket = F.get(literal, F.xxhash64(key).bitwiseAND(F.lit(_BUCKETS - 1)).cast("int"))
    mark = F.concat(F.lit(_KEY), key, F.lit(_VALUE))
    after = F.call_function("substring_index", F.concat(mark, missing, F.lit(_KEY), bucket), mark, F.lit(-1))
    return F.call_function("substring_index", after, F.lit(_KEY), F.lit(1))


def ranks(path: str = TOKENIZERS, name: str = VOCABULARY) -> list[tuple[str, str]]:
    """(piece, rank): pieces in hexadecimal, as many as the vocabulary file has."""
    with open(os.path.join(path, name), "rb") as f:
        return [(base64.b64decode(a).hex().upper(), b.decode()) for a, b in map(bytes.split, f)]


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, by way of a one-element array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _fold_by_places(digits: Column, rank_literal: Column) -> Column:
    """Pieces of one word, given as the hexadecimal digits of its bytes: a step joins the leftmost pair of lowest rank and looks up its two neighbours.

    The pieces are copied at each step, so the time grows with the square of the length; for words of usual length it is the least.
    """
    rank = lambda piece: _look_up(rank_literal, piece, F.lit(str(_NO_RANK))).cast("int")
    size = (F.length(digits) / 2).cast("int")
    none = F.array().cast("array<int>")
    start = F.struct(
        F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(digits, i * 2 - 1, F.lit(2))).alias("p"),
        F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank(F.substring(digits, i * 2 - 1, F.lit(4))))).otherwise(none).alias("r"),
    )

    def joined(p: Column, r: Column, at: Column) -> Column:
        def with_piece(x: Column) -> Column:
            pieces = F.concat(F.slice(p, F.lit(1), at - 1), F.array(x), F.slice(p, at + 2, F.size(p)))
            left = F.when(at > 1, F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.concat(F.element_at(p, at - 1), x))))).otherwise(none)
            right = F.when(at + 1 < F.size(p), F.array(rank(F.concat(x, F.element_at(p, at + 2))))).otherwise(none)
            return F.struct(pieces.alias("p"), F.concat(left, right, F.slice(r, at + 2, F.size(r))).alias("r"))

        return _bound(F.concat(F.element_at(p, at), F.element_at(p, at + 1)), with_piece)

    def step(acc: Column, _: Column) -> Column:
        low = lambda m: F.when(m < _NO_RANK, _bound(F.array_position(acc["r"], m).cast("int"), lambda at: joined(acc["p"], acc["r"], at))).otherwise(acc)
        return F.when(F.size(acc["r"]) == 0, acc).otherwise(_bound(F.array_min(acc["r"]), low))

    return F.aggregate(F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(none), start, step)["p"]


def _fold_by_pairs(digits: Column, rank_literal: Column) -> Column:
    """Pieces of one word, as :func:`_fold_by_places` gives them, for words of any length.

    The state is the word as ``<piece><piece>...`` and the pairs that may still be
    joined with their ranks.  A step takes the pair of lowest rank and joins all its
    places from left to right, which is what joining one place after the other comes
    to: a vocabulary made by merges has no piece that ranks before a pair that it
    contains and that is still unjoined.  Only where several pairs of that rank are
    there, the leftmost place is joined alone.  Then the pairs that the new piece
    forms are added.  A word of n bytes brings up at most 3 n pairs and n joins of
    one place; each step takes time in proportion to n at most.
    """
    pair_type = "array<struct<r:int,x:string>>"
    ranked = lambda xs: F.filter(F.transform(xs, lambda x: F.struct(_look_up(rank_literal, F.translate(x, "<>", ""), F.lit(str(_NO_RANK))).cast("int").alias("r"), x.alias("x"))), lambda y: y["r"] < _NO_RANK)
    piece_list = lambda s: F.split(F.substring(s, F.lit(2), F.length(s) - 2), "><")

    def with_new(s: Column, rest: Column, piece: Column) -> Column:
        def around(parts: Column) -> Column:
            k = F.size(parts) - 1
            left = F.transform(F.slice(parts, F.lit(1), k), lambda g, i: F.when(g != "", F.concat(F.lit("<"), F.call_function("substring_index", g, F.lit("<"), F.lit(-1)), piece)).when(i > 0, F.concat(piece, piece)))
            right = F.transform(F.slice(parts, F.lit(2), k), lambda g: F.when(g != "", F.concat(piece, F.call_function("substring_index", g, F.lit(">"), F.lit(1)), F.lit(">"))))
            new = F.array_distinct(F.filter(F.concat(left, right), lambda x: x.isNotNull()))
            return F.struct(s.alias("s"), F.concat(rest, ranked(new)).alias("d"))

        return _bound(F.split(s, piece), around)

    def joined(s: Column, d: Column, low: Column) -> Column:
        others = F.filter(d, lambda y: y["r"] != low)
        places = F.transform(F.array_distinct(F.transform(F.filter(d, lambda y: y["r"] == low), lambda y: y["x"])), lambda x: F.struct(F.instr(s, x).alias("at"), x.alias("x")))

        def at_first(present: Column) -> Column:
            def join(first: Column) -> Column:
                x = first["x"]
                piece = F.replace(x, F.lit("><"), F.lit(""))
                one = F.concat(F.substring(s, F.lit(1), first["at"] - 1), piece, F.substring(s, first["at"] + F.length(x), F.length(s)))
                alone = F.size(present) == 1
                return _bound(F.when(alone, F.replace(s, x, piece)).otherwise(one), lambda t: with_new(t, F.when(alone, others).otherwise(d), piece))

            return F.when(F.size(present) == 0, F.struct(s.alias("s"), others.alias("d"))).otherwise(_bound(F.array_min(present), join))

        return _bound(F.filter(places, lambda y: y["at"] > 0), at_first)

    step = lambda acc, _: F.when(F.size(acc["d"]) == 0, acc).otherwise(_bound(F.array_min(acc["d"])["r"], lambda low: joined(acc["s"], acc["d"], low)))
    size = (F.length(digits) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.concat(F.lit("<"), F.substring(digits, i * 2 - 1, F.lit(2)), F.lit("><"), F.substring(digits, i * 2 + 1, F.lit(2)), F.lit(">")))
    start = F.struct(F.regexp_replace(digits, "(..)", "<$1>").alias("s"), F.when(size > 1, ranked(F.array_distinct(pairs))).otherwise(F.array().cast(pair_type)).alias("d"))
    return piece_list(F.aggregate(F.sequence(F.lit(1), size * 4), start, step)["s"])


def fold_word(digits: Column, rank_literal: Column) -> Column:
    """Ids, joined by blanks, of one word given as the hexadecimal digits of its bytes: ranked merges as a fold over the bytes."""
    pieces = F.when(F.length(digits) <= 2 * SHORT, _fold_by_places(digits, rank_literal)).otherwise(_fold_by_pairs(digits, rank_literal))
    in_steps = F.array_join(F.transform(pieces, lambda piece: _look_up(rank_literal, piece, F.lit(""))), " ")
    # a word that is itself a piece needs no steps
    return _bound(_look_up(rank_literal, digits, F.lit("")), lambda whole: F.when(whole != "", whole).otherwise(in_steps))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _folded(words: DataFrame, digits: str, rank_literal: Column) -> DataFrame:
    """Adds ``ids`` to distinct words.

    The number of partitions is stated: adaptive execution would merge few bytes, however much there is to compute on them.
    """
    n = 4 * words.sparkSession.sparkContext.defaultParallelism
    return words.repartition(n, digits).withColumn("ids", _bound(rank_literal, lambda r: fold_word(F.col(digits), r)))


def coded(
    documents: DataFrame, text: str = "text", out: str = "coded", path: str = TOKENIZERS, name: str = VOCABULARY,
    dictionary_words: int = DICTIONARY_WORDS, dictionary_bytes: int = DICTIONARY_BYTES, keep_text: bool = True,
) -> DataFrame:
    """Adds ``out``: the ids of the text joined by blanks, '' for an empty or null text; ``keep_text=False`` leaves the text out.

    Other columns pass through (one called like ``out`` is replaced).  Special
    tokens' strings in a text are ordinary text.
    """
    assert dictionary_words >= 0 and dictionary_bytes > 0
    spark = documents.sparkSession
    rank_literal = _as_literal(ranks(path, name))
    words = words_of(F.col(text))
    common = (
        documents.select(F.explode(words).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.octet_length("word") <= dictionary_bytes) & (F.col("_n") > 1) & ~F.col("word").rlike("[\x01-\x03]"))
        .orderBy(F.desc("_n"), "word").limit(dictionary_words)
        .select("word", F.hex("word").alias("digits"))
    )
    dictionary = _as_literal([(r["word"], r["ids"]) for r in _folded(common, "digits", rank_literal).select("word", "ids").collect()])
    one_pass = F.array_join(F.transform(words, lambda w: _look_up(dictionary, w, F.concat(F.lit("?"), F.hex(w)))), " ")
    kept = [F.col(f"`{c}`") for c in documents.columns if c != out and (keep_text or c != text)]
    first = write_table(documents.select(*kept, F.coalesce(one_pass, F.lit("")).alias("_coded")), "coded")

    others = first.filter(F.contains("_coded", F.lit("?")))
    keys = [F.xxhash64("_coded").alias("_h"), F.xxhash64("_coded", F.lit(1)).alias("_g")]  # 128 bits: equal codes need equal words
    places = others.select(*keys, F.posexplode(F.regexp_extract_all("_coded", F.lit(r"\?([0-9A-F]+)"), F.lit(1))).alias("_pos", "_digits")).distinct()
    known = _folded(places.select("_digits").distinct(), "_digits", rank_literal)
    back = places.join(known, "_digits").groupBy("_h", "_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "ids"))), lambda x: x["ids"]).alias("_ids"))
    between = F.split("_coded", r"\?[0-9A-F]+")
    joined = others.select("*", *keys).join(back, ["_h", "_g"]).withColumn(out, F.array_join(F.zip_with(between, "_ids", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    plain = first.filter(~F.contains("_coded", F.lit("?"))).withColumn(out, F.col("_coded"))
    columns = [F.col(f"`{c}`") for c in [*first.columns[:-1], out]]
    return plain.select(*columns).unionByName(joined.select(*columns))


def encode(documents: DataFrame, text: str = "text", out: str = "ids", **options) -> DataFrame:
    """Adds ``out`` (``array<int>``): ids without special tokens; an empty list for an empty or null text. Options as of :func:`coded`."""
    ids = F.when(F.col("_ids_text") != "", F.split("_ids_text", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded(documents, text, "_ids_text", **options).withColumn(out, ids).drop("_ids_text")


def sizes(documents: DataFrame, text: str = "text", out: str = "n_tokens", **options) -> DataFrame:
    """Adds ``out``: the number of ids, which are counted without being made."""
    c = F.col("_ids_text")
    n = F.when(c != "", F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).otherwise(0)
    return coded(documents, text, "_ids_text", **options).withColumn(out, n.cast("int")).drop("_ids_text")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Adds ``out``: the pieces of the ids joined as bytes and read as UTF-8; '' for an empty list, null for null.

    An id that the vocabulary lacks raises an error.
    """
    pieces = F.split(F.lit(" ".join(p for p, _ in sorted(ranks(path, name), key=lambda x: int(x[1])))), " ")
    text = F.decode(F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.element_at(pieces, i + 1)), "")), "UTF-8")
    return encoded.withColumn(out, text)
