"""Mention attributes as column expressions.

Every function takes columns and returns one; nothing leaves the JVM.  Null
tokens give null attributes.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pronouns by citation form.
CITATION_FORMS = {
    "i": "i me myself mine my",
    "you": "you yourself yourselves yours your",
    "he": "he him himself his",
    "she": "she her herself hers",
    "it": "it itself its",
    "we": "we us ourselves ours our",
    "they": "they them themselves theirs their",
}
# Pronouns by fine type, and the words that make a noun phrase definite.
NOMINATIVE = "i you he she it we they".split()
ACCUSATIVE = "me you him her it us them".split()
REFLEXIVE = "myself yourself yourselves himself herself itself ourselves themselves".split()
POSSESSIVE = ["", *"mine yours his hers its ours theirs".split()]
POSSESSIVE_ADJECTIVE = "my your his her its our their".split()
DEFINITE = "the this that these those my your his her its our their".split()
# Words that are no modifiers, and tags of words that are none.
NO_MODIFIERS = "the this that those these a an".split()
NO_MODIFIER_TAGS = ["POS", "IN"]
#: Later lists win where a word is in several.
GENDER_PRIORITY = ["MALE", "FEMALE", "NEUTRAL", "PLURAL"]

_FORMS = {w: form for form, words in CITATION_FORMS.items() for w in words.split()}


def at(array: Column, index: Column) -> Column:
    """Element at a 0-based index, null outside."""
    return F.get(array, index)


def citation_form(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(_FORMS.items())])
    return F.try_element_at(table, F.lower(F.get(tokens, 0)))


def mention_type(pos: Column, ner: Column, head_index: Column) -> Column:
    """NAM by tag or by entity, then PRO, DEM, VRB; NOM otherwise. A null entity tag counts as none."""
    p, n = at(pos, head_index), F.coalesce(at(ner, head_index), F.lit("NONE"))
    named = p.startswith("NNP") | (n != "NONE")
    return F.when(named, "NAM").when(p.startswith("PRP"), "PRO").when(p.startswith("DT"), "DEM").when(p.startswith("VB"), "VRB").otherwise("NOM")


def fine_type(kind: Column, tokens: Column, pos: Column) -> Column:
    """DEF/INDEF for NOM, case of a PRO, null for others."""
    first, tag = F.lower(F.get(tokens, 0)), F.get(pos, 0)
    noun = F.when(first.isin(DEFINITE) | (tag == "NNP"), "DEF").otherwise("INDEF")
    pronoun = (
        F.when(first.isin(NOMINATIVE), "PERS_NOM").when(first.isin(ACCUSATIVE), "PERS_ACC").when(first.isin(REFLEXIVE), "REFL")
        .when((tag == "PRP") & first.isin(POSSESSIVE), "POSS").when((tag == "PRP$") & first.isin(POSSESSIVE_ADJECTIVE), "POSS_ADJ")
    )
    return F.when(kind == "NOM", noun).when(kind == "PRO", pronoun)


def number(kind: Column, citation: Column, head: Column, pos: Column, head_index: Column) -> Column:
    tag = at(pos, head_index)
    one = lambda c: F.when(c, "SINGULAR").otherwise("PLURAL")
    return (
        F.when(tag == "CC", "PLURAL")
        .when(kind == "PRO", one(F.coalesce(citation.isin("i", "you", "he", "she", "it"), F.lit(False))))
        .when(kind == "DEM", one(F.lower(F.get(head, 0)).isin("this", "that")))
        .when(kind.isin("NOM", "NAM"), one(~F.coalesce(tag.isin("NNS", "NNPS"), F.lit(False))))
        .otherwise("UNKNOWN")
    )


def semantic_class(kind: Column, citation: Column, ner: Column, head_index: Column, noun_class: Column | None = None) -> Column:
    """``noun_class`` is the looked-up class of a NOM head, null where unknown."""
    tag = F.coalesce(at(ner, head_index), F.lit("NONE"))
    entity = F.when(tag == "PERSON", "PERSON").when(tag.rlike("^(DATE|TIME|NUMBER|QUANTITY|MONEY|PERCENT)"), "NUMERIC").otherwise("OBJECT")
    pronoun = F.when(citation.isin("i", "you", "he", "she", "we"), "PERSON").when(citation == "it", "OBJECT").otherwise("UNKNOWN")
    noun = noun_class if noun_class is not None else F.lit(None).cast("string")
    return (
        F.when(kind == "PRO", pronoun).when(kind == "DEM", "OBJECT").when(tag != "NONE", entity)
        .when((kind == "NOM") & noun.isNotNull(), noun).otherwise("UNKNOWN")
    )


def gender(
    kind: Column, number_: Column, citation: Column, tokens: Column, ner: Column, head_index: Column, semantic: Column, listed: Column, noun_gender: Column | None = None,
) -> Column:
    """``listed`` is the gender-list hit of the mention (see :func:`with_listed_gender`), ``noun_gender`` that of a NOM's lexicon."""
    first, tag = F.lower(F.get(tokens, 0)), F.coalesce(at(ner, head_index), F.lit("NONE"))
    noun = F.coalesce(noun_gender, listed) if noun_gender is not None else listed
    pronoun = F.when(citation == "he", "MALE").when(citation == "she", "FEMALE").when(citation.isin("you", "we", "they"), "PLURAL")
    name = F.when(first.isin("mr", "mr."), "MALE").when(first.rlike(r"^(miss|ms|mrs)\.?$"), "FEMALE").when(~tag.rlike("^(PERSON|NONE)"), "NEUTRAL").otherwise(listed)
    raw = F.when(number_ == "PLURAL", "PLURAL").when(kind == "PRO", pronoun).when(kind == "NAM", name).when(kind == "NOM", noun)
    raw = F.coalesce(raw, F.lit("NEUTRAL"))
    return F.when((raw == "NEUTRAL") & (semantic == "PERSON"), "UNKNOWN").otherwise(raw)


def gender_lexicon(listed: DataFrame, word: str = "word", gender_: str = "gender") -> DataFrame:
    """One row per trimmed, non-empty word; of several genders the one latest in ``GENDER_PRIORITY`` holds."""
    rank = F.array_position(F.array(*map(F.lit, GENDER_PRIORITY)), F.upper(F.trim(F.col(gender_))))
    clean = listed.select(F.trim(F.col(word)).alias("word"), rank.alias("_rank")).filter("word <> '' AND _rank > 0")
    return clean.groupBy("word").agg(F.max("_rank").alias("_rank")).select("word", F.element_at(F.array(*map(F.lit, GENDER_PRIORITY)), F.col("_rank").cast("int")).alias("gender"))


def with_listed_gender(mentions: DataFrame, lexicon: DataFrame, keys: list[str], tokens: str = "tokens", head: str = "head", out: str = "listed_gender") -> DataFrame:
    """Adds the gender-list hit: of the whole string, else of the head, else of the first capitalised head token that is listed.

    ``lexicon`` is from :func:`gender_lexicon`; ``keys`` identify a mention.
    """
    probes = F.concat(
        F.array(F.struct(F.lit(0).alias("step"), F.array_join(tokens, " ").alias("word")), F.struct(F.lit(1).alias("step"), F.array_join(head, " ").alias("word"))),
        F.filter(F.transform(F.col(head), lambda t, i: F.struct((i + 2).alias("step"), t.alias("word"))), lambda x: F.substring(x["word"], 1, 1).rlike(r"\p{Lu}")),
    )
    hits = mentions.select(*keys, F.explode(probes).alias("x")).select(*keys, "x.step", "x.word").join(lexicon, "word")
    best = hits.groupBy(*keys).agg(F.min_by("gender", "step").alias(out))
    return mentions.join(best.hint("merge"), keys, "left")


def head_index(tokens: Column, head_token: Column) -> Column:
    """0-based index of the last token that equals the head token; -1 where none does."""
    place = F.array_position(F.reverse(tokens), head_token).cast("int")
    return F.when(place > 0, F.size(tokens) - place).otherwise(-1)


def grammatical_function(parent_label: Column) -> Column:
    """SUBJECT under S* and FRAG* (a prefix, hence SBAR too), OBJECT under VP*."""
    return F.when(parent_label.rlike("^(S|FRAG)"), "SUBJECT").when(parent_label.startswith("VP"), "OBJECT").otherwise("OTHER")


def lowercase_string(words: Column) -> Column:
    return F.lower(F.array_join(words, " "))


def cleaned_tokens(tokens: Column, pos: Column) -> Column:
    """Tokens whose tag is neither DT nor POS."""
    return F.filter(tokens, lambda t, i: ~F.coalesce(F.get(pos, i).isin("DT", "POS"), F.lit(False)))


def modifiers(tokens: Column, pos: Column, span: Column, head_span: Column) -> Column:
    """Distinct lower-cased tokens outside the head that are no determiners, with other tags than POS and IN."""
    a, b = head_span["begin"] - span["begin"], head_span["end"] - span["begin"]
    outside = F.filter(tokens, lambda t, i: ((i < a) | (i > b)) & ~F.lower(t).isin(NO_MODIFIERS) & ~F.coalesce(F.get(pos, i).isin(NO_MODIFIER_TAGS), F.lit(False)))
    return F.array_distinct(F.transform(outside, F.lower))


def head_ner(ner: Column, head_index_: Column) -> Column:
    return at(ner, head_index_)


def coreferent(a_doc: Column, b_doc: Column, a_set: Column, b_set: Column) -> Column:
    """Same document and same non-null entity; false where an entity is null."""
    return F.coalesce((a_doc == b_doc) & (a_set == b_set), F.lit(False))


def consistent(coreferent_: Column, one_is_dummy: Column, other_set: Column, other_is_first: Column) -> Column:
    """Whether a link agrees with the annotation: coreferent, or dummy and a mention that starts an entity or is in none."""
    return coreferent_ | (one_is_dummy & (other_set.isNull() | F.coalesce(other_is_first, F.lit(False))))
