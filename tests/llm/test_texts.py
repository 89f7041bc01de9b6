import base64
import os
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from spanmill.llm import privacy, tokenizer

TEXTS = [
    "", None, " ", "Hello world", "don't we'll 's", "  two  spaces \n\n\t tab ", "这座城市的图书馆", "قال المتحدث", "naïve café été", "a" * 300, "1234 56,789.0", "x y　z ", "😀👍🏽 ok", "\x00\x01\x02\x03 ctl", "<|endoftext|>",
    "ﬁ ẞ İ ſ", "��", "tail ", "\n", "'S 'T '", "abc'd", "​zero‍", "…—“”",
]


@pytest.fixture(scope="module")
def reference():
    with open(os.path.join(tokenizer.TOKENIZERS, tokenizer.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("dictionary", [0, 3, 65_536])
def test_ids_match_a_public_encoder(spark, reference, dictionary):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abz éß'\n 19.世") for _ in range(60)) for _ in range(20)] + TEXTS[3:8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1))
    out = tokenizer.encode(df, dictionary_words=dictionary)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["decoded"] for r in tokenizer.decode(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_a_very_long_word(spark, reference):
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcde", 4000), ("a", 777), ("ab", 500), ("的一是不了在人有我他", 700), ("-=", 300), ("abcdefghijklmnopqrstuvwxyz", 12_000))]
    df = spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string")
    want = sorted((i, reference.encode_ordinary(t)) for i, t in enumerate(texts) for _ in "12")
    assert sorted((r["doc_id"], r["ids"]) for r in tokenizer.encode(df, keep_text=False).collect()) == want
    assert sorted((r["doc_id"], r["n"]) for r in tokenizer.sizes(df, out="n").collect()) == [(i, len(x)) for i, x in want]
    assert tokenizer.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("short", [0, 1000])
def test_both_folds_give_the_same_ids(spark, reference, monkeypatch, short):
    monkeypatch.setattr(tokenizer, "SHORT", short)
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for letters in ("a", "ab", "aab", "the", "é世a", "==-") for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in tokenizer.encode(df, dictionary_words=0).collect()} == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


FOUND = [
    ("Contact: yvonne.baseini@corpus-lab.test, 808.555.0175.", {("email", "yvonne.baseini@corpus-lab.test"), ("phone", "808.555.0175")}),
    ("mailto:lawrence1976@corpus-lab.test. Next", {("email", "lawrence1976@corpus-lab.test")}),
    ("<ulrich+coref AT quillon DOT invalid> and a (at) mail (dot) lowtide (dot) example", {("email", "ulrich+coref AT quillon DOT invalid"), ("email", "a (at) mail (dot) lowtide (dot) example")}),
    ("Follow @school_14 at noon", set()),
    ("Tax number XK6516558; phone +44 7700 900596;", {("id_number", "XK6516558"), ("phone", "+44 7700 900596")}),
    ("Her passport, QQ 00 26 71 B, was. SSN 927-23-1719 appears", {("id_number", "QQ 00 26 71 B"), ("id_number", "927-23-1719")}),
    ("Order 620 920 2462 for the bat; case number 3628-6747; 676:8691; Span (6920, 3391)", set()),
    ("lives at Flat 30, 629 Harbor View Ave, Basen, and. The court on Kestrel Street was left by 66 jetties from Mill Lane.", {("address", "Flat 30, 629 Harbor View Ave, Basen")}),
    ("to P.O. Box 67, Hurat 69174. Then 1638 St. Brannoc Ave, Muges, and", {("address", "P.O. Box 67, Hurat 69174"), ("address", "1638 St. Brannoc Ave, Muges")}),
    ("wohnhaft Kesslergasse 52c, D-13694 Banuick. Domicile : 89 bis boulevard Saint-Orme, 68628 Beoff.", {("address", "Kesslergasse 52c, D-13694 Banuick"), ("address", "89 bis boulevard Saint-Orme, 68628 Beoff")}),
    ("Dr. Susan Zuick's dog, Mei von Kuhanik and K. Paner; Beund, Wilhelmina left. Mr. Suges knew.", {("name", "Susan Zuick"), ("name", "Mei von Kuhanik"), ("name", "K. Paner"), ("name", "Beund, Wilhelmina")}),
    ("SUSAN DUDAIS and jennifer kosen told Verat Vehicle Company in Port Kaard", {("name", "SUSAN DUDAIS"), ("name", "jennifer kosen")}),
]


@pytest.mark.parametrize("text, want", FOUND)
def test_finder(text, want):
    assert {(k, text[a:b]) for a, b, k in privacy.finder()(text, privacy.words_in(text))[0]} == want


def test_find_and_redact(spark):
    rows = [(i, t) for i, (t, _) in enumerate(FOUND)] + [(90, None), (91, ""), (92, "Mei Paner, Mei Paner " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("found", F.lit(2))
    got = {(r["doc_id"], r["kind"], r["found"]) for r in privacy.find_personal(df, "s").collect()}
    assert got == {(i, *x) for i, (_, w) in enumerate(FOUND) for x in w} | {(92, "name", "Mei Paner")}
    out = {r["doc_id"]: r["text"] for r in privacy.redact_personal(df, "s").collect()}
    assert out[90] is None and out[91] == "" and out[3] == FOUND[3][0] and "Mei Paner" not in out[92]
    assert out[0].startswith("Contact: [EMAIL ") and out[0].endswith("].") and "808.555.0175" not in out[0]
    assert privacy.find_personal(df.limit(0), "s").count() == 0


LOWER = [
    ("Susan Huorg and K. Saorg met Tom Dearo, Peggy Page, dearo and Joe Smith.", {"Susan Huorg", "K. Saorg", "Tom Dearo", "Peggy Page", "Joe Smith"}),
    ("B: tom huorg and Senator mei dearo, photographed q. saorg and m. c. saorg's boat; huorg, q. said", {"tom huorg", "mei dearo", "q. saorg", "m. c. saorg", "huorg, q."}),
    ("They will huorg, rich dearo and bill smith.", {"will huorg", "rich dearo", "bill smith"}),
    ("whom v. unseenik watched, jon nihiith too. Bob Dearo", {"v. unseenik", "jon nihiith", "Bob Dearo"}),
    ("A plan b. then page the will page and art house of vitamin c. however, i.e. they, the house however", set()),
    ("mail tom huorg@x.test or will leave; the leave, then page", set()),
]


def test_names_in_lower_case_are_decided_by_the_corpus(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LOWER)] + [(None, LOWER[1][0]), (90, None), (91, "")], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["found"]) for r in privacy.find_personal(df, "s").filter("kind = 'name'").collect()}
    assert got == {(i, n) for i, (_, names) in enumerate(LOWER) for n in names} | {(None, n) for n in LOWER[1][1]}
    out = {r["doc_id"]: r["text"] for r in privacy.redact_personal(df, "s").collect()}
    assert len(out) == len(LOWER) + 3 and out[90] is None and out[91] == "" and out[4] == LOWER[4][0]
    for i, (text, names) in enumerate(LOWER):
        assert out[i].count("[NAME ") == len(names) and not any(n in out[i] for n in names), text
    assert out[None] == out[1] and privacy.redact_personal(df.limit(0), "s").count() == 0


@pytest.mark.parametrize("digits", ["", "7", "42", "0071234567", "123456789", "0" * 30])
def test_permutation_can_be_undone(digits):
    for key in (b"a", b"b"):
        out = privacy.permute_digits(digits, key)
        assert len(out) == len(digits) and privacy.permute_digits(out, key, inverse=True) == digits


def test_permutation_is_one_to_one():
    assert len({privacy.permute_digits(f"{i:03}", b"k") for i in range(1000)}) == 1000


def test_pseudonyms_link_equal_values():
    k = b"key"
    assert privacy.pseudonym("+44 7700 900596", "phone", k) == privacy.pseudonym("+44 7700 900596", "phone", k)
    assert privacy.pseudonym("Beund, Wilhelmina", "name", k) == privacy.pseudonym("wilhelmina BEUND", "name", k)
    assert privacy.pseudonym("X1", "id_number", k)[0] == "X"


MORE = [
    ("Her passport number, which she had kept in a drawer for years and years, was XK6516558. Call 030 12345678 or 020 7946 0958.", {("id_number", "XK6516558"), ("phone", "030 12345678"), ("phone", "020 7946 0958")}),
    ("SSN 000-12-3456, SSN 123-00-4567, SSN 666-12-3456; SSN 123-45-6789", {("id_number", "123-45-6789")}),
    ("The tax was due. Order 123456789 came; her passport is lost! Then 987654321", set()),
    ("号码 11010519491231002X and 110105194912310021, NIR 2 55 08 14 168 025 38", {("id_number", "11010519491231002X"), ("id_number", "2 55 08 14 168 025 38")}),
    ("Dr. Kwame Mensah met Ms Giulia Rossi.\nDear Ravi Subramanian,\nthanks\nBest regards,\nNgozi Adeyemi", {("name", "Kwame Mensah"), ("name", "Giulia Rossi"), ("name", "Ravi Subramanian"), ("name", "Ngozi Adeyemi")}),
    ("Write to Amara Okafor <amara@x.test>", {("name", "Amara Okafor"), ("email", "amara@x.test")}),
    ("von " + "Aber" * 40 + "feld, Susan left", {("name", "von " + "Aber" * 40 + "feld, Susan")}),
]


@pytest.mark.parametrize("text, want", MORE)
def test_numbers_and_names_by_structure(text, want):
    assert {(k, text[a:b]) for a, b, k in privacy.finder()(text, privacy.words_in(text))[0]} == want


def test_names_outside_the_list(spark):
    """Given names that are in no list: found where the surname is seen in a sure name anywhere in the corpus."""
    rng = random.Random(4)
    syllables = ["ka", "me", "no", "ri", "sha", "tu", "vo", "zi", "lan", "dor"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).capitalize()
    people = sorted({f"{word(2)} {word(3)}" for _ in range(120)})
    assert not {p.split()[0].lower() for p in people} & set(privacy.short_forms())
    texts = [(i, f"The council heard {p} about the plan. {word(2)} Vehicle Group and Port {word(2)} were named.", p) for i, p in enumerate(people)]
    texts += [(1000 + i, f"Then Dr. {p} spoke.", p) for i, p in enumerate(people) if i % 20]
    got = {(r["doc_id"], r["found"]) for r in privacy.find_personal(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), "s").filter("kind = 'name'").collect()}
    want = {(i, p) for i, _, p in texts}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.98 * len(got)


def test_permuted_numbers_keep_their_format():
    k = privacy.cipher_key("key")
    assert k != privacy.cipher_key("key2") and privacy.cipher_key("x" * 64 + "a") != privacy.cipher_key("x" * 64 + "b")
    for phone in ("+44 7700 900596", "+1 617 555 0197", "0044 7700 900 694", "+49-(0)30-23125-085", "030/23125838", "+351 21 234 5678"):
        out = privacy.pseudonym(phone, "phone", k)
        n = privacy.country_code(phone)
        assert out != phone and out[:n] == phone[:n] and n >= 1 and [c.isdecimal() for c in out] == [c.isdecimal() for c in phone] and privacy.valid_phone(out)
    assert len({privacy.pseudonym(f"{a:03}-12-3456", "id_number", k) for a in range(1, 666)}) == 665
    for number in ("11010519491231002X", "2 55 08 14 168 025 38"):
        out = privacy.pseudonym(number, "id_number", k)
        assert out != number and privacy._checks(out) and privacy._permute_checked(out, k, inverse=True) == number
    for day in ("12 March 1987", "3 août 2001", "1999-12-31", "05.03.1987", "March 1, 2000", "7 de mayo de 1999"):
        out = privacy.permute_date(day, k)
        assert out != day and privacy.date_of(privacy.DATE.fullmatch(out)) and privacy.permute_date(out, k, inverse=True) == day
    assert privacy.permute_date("31 February 1987", k) == "31 February 1987"
    assert len(privacy.pseudonym("Susan Zuick", "name", k)) == 32


def test_dates_are_replaced_on_demand(spark):
    df = spark.createDataFrame([(1, "Born 12 March 1987 in Basen"), (1, "Born 12 March 1987 in Basen"), (2, "Day 12.13.1987")], "doc_id long, text string")
    out = sorted(r["text"] for r in privacy.redact_personal(df, "s", dates=True).collect())
    assert out[0] == out[1] and out[0].startswith("Born [DATE ") and out[0].endswith("] in Basen") and "March 1987" not in out[0][:8] and out[2] == "Day 12.13.1987"
    assert {r["text"] for r in privacy.redact_personal(df, "s").collect()} == {"Born 12 March 1987 in Basen", "Day 12.13.1987"}
