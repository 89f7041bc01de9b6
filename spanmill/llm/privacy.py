"""Problem 9: personal information in free text, found and replaced.

One scan of the texts, in Arrow batches, gives each stretch with its kind and its
pseudonym; the found rows and the redacted texts are both made from it.  There is
a pattern per kind, run only on lines that have its signs; stretches that overlap
are resolved by kind.  A name is sure after a given name that is known, initials,
a title, a greeting or a closing, or beside an email address.  Other pairs of
capitalised words, and names in lower case, are candidates: what the corpus shows
of the surname decides (see :func:`_confirmed`), looked up by joins.  Numbers are
validated: identity numbers against what their issuers never give out, country
codes against the numbering plan.

Pseudonyms are keyed and preserve the format: the free digits of numbers are
permuted by an alternating Feistel network (country code, trunk zero, letters and
separators stay), dates within the calendar, and a permuted number is valid again;
so equal values stay linked across documents.  Emails, addresses and names get a
keyed tag of the normalised value.
"""

from __future__ import annotations

import datetime
import hashlib
import secrets
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import write_table
from .given_names import short_forms
from .names import TITLES

KINDS = ("email", "id_number", "phone", "address", "name")  # in order of precedence

_TLD = r"[A-Za-z]{2,24}"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:[ ]?[\[({][ ]?(?i:dot)[ ]?[\])}][ ]?|[ ](?:DOT|dot)[ ])"
_AT = r"(?:[ ]?[\[({][ ]?(?i:at)[ ]?[\])}][ ]?|[ ](?:AT|at)[ ]|[ ]?[@＠][ ]?)"
EMAIL = regex.compile(
    rf"(?<![\w.+%-])[A-Za-z0-9_%+](?:[\w.%+-]*[\w%+-])?(?:@{_LABEL}(?:\.{_LABEL})*\.{_TLD}|{_AT}{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*(?:{_DOT}|(?<=[\])}}][ ]?[A-Za-z0-9.-]+)\.){_TLD})(?![\w@-])", regex.ASCII
)

# Words before a number that is no phone number.
_NO_PHONE = "order|case(?: number)?|span|page|mention|cluster|version|commande|bestellung|pedido"
PHONE = regex.compile(
    r"(?=[+(\d])(?<![\w.:/+-])(?:"
    r"(?:\+1[ .-]?)\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|1[.-]\d{3}[.-]\d{3}[.-]\d{4}"
    r"|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}[2-9]\d{6}"
    r"|(?:\+44|0044)[ -]?(?:\(0\))?\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}|07\d{3}[ -]?\d{3}[ -]?\d{3}|0\d{2,3}[ ]\d{3,4}[ ]\d{4}"
    r"|(?:\+49|0049)[ -]?(?:\(0\))?[ -]?\d{2,5}[ /-]?\d{3,8}(?:[ -]\d{1,5})?|0\d{2,4}/\d{5,9}|0\d{2,4}[ ]\d{5}[ -]\d{2,4}|0\d{2,4}[ ]\d{6,8}"
    r"|(?:\+33|0033)[ .-]?(?:\(0\))?\d(?:[ .-]?\d{2}){4}|0\d(?:[ .]\d{2}){4}"
    r"|\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){2,3}"
    r")(?![\w/-]|[.:]\d)"
)
_BEFORE_NO_PHONE = regex.compile(rf"(?ri)(?:{_NO_PHONE})[ (]*")
_MANY_DIGITS = regex.compile(r"\d(?:[ ./()-]{0,3}\d){6}")

# Country calling codes of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(phone: str) -> int:
    """Characters of a number up to the end of its country code and trunk zero, which a permutation leaves alone; 0 without."""
    m = regex.match(r"(?:\+|00)(\d{1,3})", phone)
    if not m:
        return 1 if phone[:1] in ("0", "1") and len(phone) > 1 else 0
    n = next((k for k in (1, 2) if m[1][:k] in _CODES), 3)
    end = m.start(1) + n
    zero = regex.match(r"[ .-]*\(0\)", phone[end:])
    return end + (len(zero[0]) if zero else 0)


def valid_phone(phone: str) -> bool:
    """Between 7 and 15 digits with the code, a code that the plan has, and not one digit throughout."""
    digits = [c for c in phone if c.isdecimal()]
    code = regex.match(r"(?:\+|00)(\d)", phone)
    return 7 <= len(digits) <= 17 and len(set(digits[-7:])) > 1 and not (code and code[1] == "0")


# Words that announce an identity number in the languages of the corpus.
ID_LABELS = (
    "passport passports passeport pasaporte reisepass pass ausweis ausweisnummer personalausweis identity identité identidad cédula dni nif nie "
    "ssn social sécurité seguridad sozialversicherungsnummer tax taxpayer tin steuernummer steuer-id fiscal impuesto id 护照 护照号 护照号码 身份证 身份证号 身份证号码 税号 社保号 جواز هوية الهوية الضريبي"
).split()
_NIR = r"[12][ ]?\d{2}[ ]?\d{2}[ ]?\d[\dAB][ ]?\d{3}[ ]?\d{3}[ ]?\d{2}"
_ID = rf"(?:[A-Z]{{1,2}}\d{{7,8}}|QQ[ ]\d{{2}}[ ]\d{{2}}[ ]\d{{2}}[ ][A-Z]|[A-Z]{{2}}\d{{6}}[A-Z]|[A-Z]\d{{7}}-?[A-Z]|\d{{8}}-?[A-Z]|\d{{2}}/\d{{3}}/\d{{5}}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}[ ]\d{{2}}[ ]\d{{4}}|\d{{17}}[\dXx]|{_NIR}|[12]\d{{9}}|\d{{11}}|\d{{2}}[ ]\d{{3}}[ ]\d{{3}}[ ]\d{{3}}|\d{{9}})"
#: Numbers that are known by their own make-up, without a label.
ID_SURE = regex.compile(rf"(?=[A-Z\d])(?<![\w/-])(?:(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]|QQ)(?:\d{{6}}|[ ]\d{{2}}[ ]\d{{2}}[ ]\d{{2}}[ ])[A-D]|(?P<checked>\d{{17}}[\dXx]|{_NIR}))(?![\w/-])")
ID_NUMBER = regex.compile(rf"(?=[A-Z\d])(?<![\w/-]){_ID}(?![\w/]|-\d)")
_LABELS = regex.compile(rf"(?i:(?<![\p{{L}}])(?:{'|'.join(map(regex.escape, ID_LABELS))}))")
#: What ends the reach of a label: a digit, the end of a line or of a sentence.
_REACH = regex.compile(r"(?r)[\d\n;]|(?<=\p{L}{3})[.!?]['\"’”)]*[ \t]")  # "no." ends no sentence


def _checks(number: str) -> bool:
    """The check digits of a Chinese identity number or of a French social security number."""
    d = number.replace(" ", "").upper()
    if len(d) == 18:
        weights = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
        return "10X98765432"[sum(int(c) * w for c, w in zip(d, weights)) % 11] == d[17] and "1900" <= d[6:10] < "2100" and "01" <= d[10:12] <= "12" and "01" <= d[12:14] <= "31"
    body = int(d[:13].replace("2A", "19").replace("2B", "18")) if d[:13].replace("A", "").replace("B", "").isdecimal() else -1
    return len(d) == 15 and body >= 0 and 97 - body % 97 == int(d[13:])


def valid_id(number: str) -> bool:
    """Not a number that its issuer never gives out: a group of zeros, or area 666, in a social security number below 900; zeros throughout."""
    m = regex.fullmatch(r"(\d{3})[- ](\d{2})[- ](\d{4})", number)
    if m and m[1] < "900":
        return m[1] not in ("000", "666") and m[2] != "00" and m[3] != "0000"
    return any(c.isdecimal() and c != "0" for c in number)


_CITY = r"(?:(?:New|Old|Port|Lake|East|West|North|South|Mount|San|Saint|St\.|Bad|Fort)[ ])?\p{Lu}[\p{L}'’]+(?:-\p{Lu}?[\p{L}'’]+)*"
_WORD = r"(?:(?:St|Ste|Mt|Dr)\.[ ])?\p{Lu}[\p{L}'’]*(?:-\p{L}+)*"
_UNIT = r"(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Rm|No|#)\.?[ ]?#?\d+[A-Za-z]?"
_WAY = r"(?:Street|Str|St|Avenue|Ave|Lane|Ln|Road|Rd|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Row|Close|Crescent|Parkway|Pkwy|Highway|Hwy|Walk|Quay)"
_END = rf"(?:,[ ]?\n?|[ ]?\n[ ]?)(?:{_CITY}(?:,?[ ](?:[A-Z]{{2}}[ ])?\d{{4,5}}(?:-\d{{4}})?)?|(?:[A-Z]{{1,2}}-)?\d{{4,5}}[ ]{_CITY})"
ADDRESS = regex.compile(
    r"(?=[\d#AFUSRNPBCTpab])(?<![\w/.:-])(?:"
    rf"(?:{_UNIT},?[ ])?\d+[A-Za-z]?(?:-\d+)?[ ](?:{_WORD}[ ]){{1,4}}{_WAY}\b\.?(?:,?[ ]{_UNIT})?{_END}"
    rf"|(?i:P\.?[ ]?O\.?[ ]?Box|Post Office Box|Postfach|Apartado(?:[ ]de[ ]Correos)?|Boîte[ ]postale|B\.?P\.?)[ ]\d+{_END}"
    rf"|\d+(?:[ ](?:bis|ter|quater))?,?[ ](?i:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|route|square|passage)(?:[ ](?:d'|l'|(?:de|du|des|la|le|les)\b)|[ ]?{_WORD}){{1,6}}{_END}"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|C/)(?:[ ](?:de|del|la|las|el|los|y)\b|[ ]{_WORD}){{1,6}},?[ ](?:n\.?º[ ]?)?\d+(?:,[ ]?\d+[.ºª]*[ ]?[A-Z]?\b(?=,))?{_END}"
    r")"
)

_GERMAN = (
    r"(?<![\w/.:-])(?:"
    rf"(?:(?:Am|An[ ]der|Auf[ ]der|Im|In[ ]der|Zum|Zur)[ ](?:{_WORD}[ ]){{0,2}}{_WORD}|\p{{Lu}}[\p{{L}}-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring)|(?:{_WORD}[ ])?(?:Straße|Strasse|Gasse|Weg|Allee|Platz))[ ]\d+[ ]?[a-z]?{_END}"
    r")"
)
GERMAN_ADDRESS = regex.compile(_GERMAN)
#: A house number behind a word and before the end of a line or a comma, as German addresses have it.
_HOUSE = regex.compile(r"(?<=[\p{L}.] )\d+ ?[a-z]?(?:,| ?\n)")

_GAP = r"[ \t   ]"
_PARTICLE = rf"(?:(?:(?:van|von|de|del|della|der|den|di|da|dos|du|la|le|ten|ter|bin|ben|ibn|abu|zu|zum|zur|Van|Von|De|Al|VON|VAN|DE){_GAP})+|(?:al|el|Al|El|AL|EL|O'|D'|d'|O’|D’)-?)?"
_SURNAME = rf"{_PARTICLE}\p{{Lu}}[\p{{L}}\p{{M}}'’]+(?:-(?:al-)?\p{{Lu}}[\p{{L}}\p{{M}}'’]+)*"
_INITIAL = r"\p{Lu}\."
_POSSESSIVE = regex.compile(r"(?:['’][sS])$|['’]$")

# Words that stand after initials or a given name and make it no person's name.
_NOT_SURNAMES = frozenset(
    "box street avenue lane road drive company corporation inc ltd plc gmbh holdings university institute department association union group works laboratories manufacturing partners brothers international "
    "board authority tribunal committee the and of in on at from to his her with for she he it they".split()
)


# Words of greetings and closings, and words that follow them without being names.
_GREETINGS = "Dear|Hi|Hello|Hey|Lieber|Liebe|Chère|Cher|Estimado|Estimada|Querido|Querida"
_CLOSINGS = "Regards|Kind regards|Best regards|Best wishes|Sincerely|Yours sincerely|Yours truly|Yours faithfully|Cheers|Signed|Mit freundlichen Grüßen|Viele Grüße|Cordialement|Bien à vous|Atentamente|Saludos"
_NOT_GIVEN = TITLES | frozenset("the a an and or of in on at from to for with by dear sir madam customer team all friend friends colleague colleagues port lake east new west north south mount saint san old bad fort signed regards".split())
_LETTERS = r"[\p{L}\p{M}'’-]"


def _names(given: frozenset[str], plain: frozenset[str]):
    """A function text, its words -> (begin, end, is sure) of names; ``given`` in any usual case, ``plain`` also where all is lower case."""
    title = {g.capitalize() for g in given} | {g.upper() for g in given}
    # a capitalised word or initials; whether it is a given name is looked up, not matched
    opening = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.&'’-])(?:(?P<first>\p{{Lu}}\p{{L}}+)|{_INITIAL}(?:{_GAP}?{_INITIAL})*)")
    rest = regex.compile(rf"(?:{_GAP}{_INITIAL})*{_GAP}?(?<={_GAP}|\.){_SURNAME}")
    rest_initials = regex.compile(rf"{_GAP}?{_SURNAME}")
    front = regex.compile(rf"(?r)(?<![\p{{L}}\p{{N}}_@.&'’-]){_SURNAME},{_GAP}")
    before_front = regex.compile(r"(?r)(?<!\p{L})(?:Dear|In|On|At|From|To|Near|Port|Lake|East|New|West|North|South|Mount|Dr|Mr|Ms|Mrs|Prof)[. ]+")
    tail = regex.compile(rf"(?:{_GAP}{_INITIAL})*(?![\p{{L}}\p{{N}}'’-])(?!{_GAP}{_PARTICLE}\p{{Lu}}[\p{{L}}])")
    tail_initials = regex.compile(rf"(?!{_GAP}?\p{{Lu}})")
    lower = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.+-])(?:{'|'.join(map(regex.escape, sorted(plain, key=lambda g: (-len(g), g))))}){_GAP}(?:[a-z]\.{_GAP})?(?:(?:van|von|al-|de){_GAP}?)?\p{{Ll}}[\p{{L}}\p{{M}}-]{{3,}}(?![\p{{L}}@_+])") if plain else None
    lower_front = regex.compile(rf"(?r)(?<![\p{{L}}-])(?:(?:van|von|de|al){_GAP}|al-)?\p{{Ll}}[\p{{L}}-]{{3,}},{_GAP}")
    french = regex.compile(r"\b(?:selon|sauf|n['’]était|personne|déclaré|comité|après|entreprise|était|rapport|écrivez|appelez|veuillez|monsieur)\b", regex.I)
    # what makes a pair of capitalised words a name whatever its given name
    titled = "|".join(sorted({t.capitalize() for t in TITLES if len(t) > 1 and t not in ("fr", "pres")}, key=lambda t: (-len(t), t)))
    before_pair = regex.compile(rf"(?r)(?:(?<!{_LETTERS})(?:{titled})\.?{_GAP}|(?<!{_LETTERS})(?:{_GREETINGS}){_GAP}|(?:{_CLOSINGS})[,.!]?[ ]*\n+[ ]*(?:—|-|–)?[ ]*)")
    within = regex.compile(rf"(?r)[\p{{Ll}},]{_GAP}")
    after_pair = regex.compile(rf"{_GAP}?[<(\[]?[\w.+%-]+@[\w-]")

    def find(text: str, words: set[str]):
        is_french = "M." in text and len(set(x.lower() for x in french.findall(text))) >= 2
        end = 0
        for m in opening.finditer(text):
            first = m["first"]
            a, at = m.span()
            known = first is None or first in title
            if not known and (a < end or first.lower() in _NOT_GIVEN):
                continue
            if a >= end and (r := (rest if first else rest_initials).match(text, at)):
                word = _POSSESSIVE.sub("", text[a : r.end()])
                last = regex.split(rf"{_GAP}|\.", word)[-1]
                if not known:
                    if len(last) > 1 and last.lower() not in _NOT_SURNAMES and first.lower() not in words and not regex.match(rf"{_GAP}\p{{Lu}}", text[r.end() : r.end() + 2]):
                        sure = bool(before_pair.match(text, 0, a) or after_pair.match(text, r.end()))
                        if sure:
                            end = r.end()
                        # the first word of a sentence has its capital anyway, and a particle may be a preposition
                        if sure or (within.match(text, 0, a) and regex.fullmatch(rf"{_LETTERS}+(?:{_GAP}{_INITIAL})*{_GAP}\p{{Lu}}{_LETTERS}+", word)):
                            yield a, a + len(word), sure
                    continue
                end = r.end()
                if last.lower().strip("'’") in _NOT_SURNAMES or len(last) < 2:
                    pass
                elif is_french and regex.match(rf"M\.{_GAP}\p{{Lu}}[\p{{L}}'’-]+$", word):
                    pass  # Monsieur and a bare surname
                elif not regex.match(r"[\p{Lu}.]*P\.[ ]?O\.", word):
                    yield a, a + len(word), True
            if known and a > 2 and text[a - 2] == "," and (t := (tail if first else tail_initials).match(text, at)) and (f := front.match(text, 0, a)):
                begin = a - len(f[0])
                if f[0].split(",")[0].lower() not in _NOT_SURNAMES and not before_front.match(text, 0, begin):
                    yield begin, t.end(), True
        if lower and not plain.isdisjoint(words):
            for m in lower.finditer(text):
                last = regex.split(_GAP, m[0])[-1]
                before = lower_front.match(text, 0, m.start())
                if before and (last in _NOT_SURNAMES or regex.search(r"(?:ed|told|said|knew|sold|bought|found|left|paid|sued|sent|held|or|and)$", last)):
                    yield m.start() - len(before[0]), m.start() + len(regex.split(_GAP, m[0])[0]), True
                elif last not in _NOT_SURNAMES:
                    yield *m.span(), True

    return find


#: An address with its signs in words has one of these.
spelled = regex.compile(r"[\[({] ?(?i:at) ?[\])}]|[\[({] ?(?i:dot) ?[\])}]| (?:DOT|dot) ")

#: Short forms that are also words; in lower case they are no names.
_WORDS = frozenset("bill dick sue will rich pat hank mick kit rob ed ted hal ella nell jo lu ant mei art mark beth".split())


# Months in the languages that write them with Latin letters.
_MONTH_NAMES = [
    "january february march april may june july august september october november december".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
_DATE_MONTHS = {m: i + 1 for months in _MONTH_NAMES for i, m in enumerate(months)}
_MONTH = "|".join(sorted(_DATE_MONTHS, key=lambda m: (-len(m), m)))
DATE = regex.compile(
    rf"(?<![\w./-])(?:(?P<y1>(?:19|20)\d\d)-(?P<m1>\d\d)-(?P<d1>\d\d)|(?P<d2>\d\d?)(?P<sep>[./])(?P<m2>\d\d?)(?P=sep)(?P<y2>(?:19|20)\d\d)"
    rf"|(?P<d3>\d\d?)\.?[ ](?:de[ ])?(?P<m3>(?i:{_MONTH}))[ ](?:de[ ])?(?P<y3>(?:19|20)\d\d)|(?P<m4>(?i:{_MONTH}))[ ](?P<d4>\d\d?),[ ](?P<y4>(?:19|20)\d\d))(?![\w/-]|[.]\d)"
)


def date_of(m) -> datetime.date | None:
    """The day that a match of DATE names; null where the calendar has none."""
    y, mo, d = (next(m[f"{x}{i}"] for i in range(1, 5) if m[f"{x}{i}"]) for x in "ymd")
    try:
        return datetime.date(int(y), int(mo) if mo.isdecimal() else _DATE_MONTHS[mo.lower()], int(d))
    except ValueError:
        return None


class Stretches:
    """Disjoint stretches of a text, in order."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.rows: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.begins, b)
        return at == 0 or self.rows[at - 1][1] <= a

    def take(self, a: int, b: int, kind: str) -> None:
        if a < b and self.free(a, b):
            at = bisect_left(self.begins, a)
            self.begins.insert(at, a)
            self.rows.insert(at, (a, b, kind))


def words_in(text: str) -> set[str]:
    """Words between blanks without signs around them."""
    return {w.strip(_AROUND) for w in text.split()}


def finder(given: frozenset[str] | None = None, dates: bool = False):
    """(text, its words) -> sorted, disjoint (begin, end, kind), and (begin, end, given name, surname) of pairs that only the corpus can decide.

    An email beats a number, a number a date, a date an address, an address a name.
    """
    known = given or frozenset(short_forms())
    names = _names(known, frozenset(g for g in known if len(g) > 3 and g not in _WORDS))

    def find(text: str, words: set[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]]]:
        s = Stretches()
        if "@" in text or "＠" in text or spelled.search(text):
            at = 0
            for line in text.split("\n"):  # an address stands within a line
                if "@" in line or "＠" in line or spelled.search(line):
                    for m in EMAIL.finditer(line):
                        s.take(at + m.start(), at + m.end(), "email")
                at += len(line) + 1
        if regex.search(r"\d", text):
            for m in ID_NUMBER.finditer(text):
                stop = _REACH.search(text, 0, m.start())
                if _LABELS.search(text, stop.end() if stop else 0, m.start()) and valid_id(m[0]):
                    s.take(*m.span(), "id_number")
            for m in ID_SURE.finditer(text):
                if valid_id(m[0]) and (m["checked"] is None or _checks(m["checked"])):
                    s.take(*m.span(), "id_number")
            if _MANY_DIGITS.search(text):
                for m in PHONE.finditer(text):
                    if valid_phone(m[0]) and not _BEFORE_NO_PHONE.match(text, 0, m.start()):
                        s.take(*m.span(), "phone")
            if dates:
                for m in DATE.finditer(text):
                    if date_of(m):
                        s.take(*m.span(), "date")
            for m in ADDRESS.finditer(text):
                s.take(*m.span(), "address")
            if _HOUSE.search(text):
                for m in GERMAN_ADDRESS.finditer(text):
                    s.take(*m.span(), "address")
        found = list(names(text, words))
        for a, b, sure in sorted(found, key=lambda x: (x[0], -x[1])):
            if sure:
                s.take(a, b, "name")
        open_ = []
        for a, b, sure in found:
            if not sure and s.free(a, b):
                parts = regex.split(rf"{_GAP}", text[a:b])
                open_.append((a, b, parts[0].lower(), parts[-1].lower()))
        return s.rows, open_

    return find


def _round(key: bytes, i: int, half: str, size: int) -> int:
    digest = hashlib.blake2b(f"{i}:{size}:{half}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(digest, "big") % 10**size


def cipher_key(secret: str) -> bytes:
    """A key of 64 bytes from a secret of any length, all of which counts."""
    assert secret
    return hashlib.blake2b(secret.encode()).digest()


def permute_digits(digits: str, key: bytes, inverse: bool = False, rounds: int = 8) -> str:
    """A keyed permutation of the strings of as many digits (alternating Feistel); one digit is shifted."""
    n = len(digits)
    if n < 2:
        shift = _round(key, 0, "", 1) if n else 0
        return str((int(digits) + (-shift if inverse else shift)) % 10) if n else ""
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(rounds)) if inverse else range(rounds):
        if i % 2 == 0:
            f = _round(key, i, b, len(a))
            a = str((int(a) + (-f if inverse else f)) % 10 ** len(a)).zfill(len(a))
        else:
            f = _round(key, i, a, len(b))
            b = str((int(b) + (-f if inverse else f)) % 10 ** len(b)).zfill(len(b))
    return a + b


def _walk(value: str, key: bytes, fits, inverse: bool = False) -> str:
    """The permutation restricted to the strings that fit: it is applied again until one does, which ends as it is one-to-one and began with one."""
    while True:
        value = permute_digits(value, key, inverse)
        if fits(value):
            return value


def _with_digits(found: str, start: int, digits: str) -> str:
    it = iter(digits)
    return found[:start] + "".join(next(it) if c.isdecimal() else c for c in found[start:])


_DAY_ONE, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def permute_date(text: str, key: bytes, inverse: bool = False) -> str:
    """Another day of 1900 to 2099 in the same way of writing; text that names no day of the calendar stays."""
    m = DATE.fullmatch(text)
    day = m and date_of(m)
    if not day:
        return text
    new = _DAY_ONE + datetime.timedelta(int(_walk(str((day - _DAY_ONE).days).zfill(5), key, lambda v: int(v) < _DAYS, inverse)))
    parts = [v for n, v in m.groupdict().items() if v and n[0] in "md" and v.isdecimal()]
    # two digits each where all have two, in dates of numbers only, or one begins with 0
    width = 2 if any(v[0] == "0" for v in parts) or len(parts) == 2 and min(map(len, parts)) == 2 else 1
    out, at = [], 0
    for name, value in sorted(((n, v) for n, v in m.groupdict().items() if v and n != "sep"), key=lambda x: m.start(x[0])):
        part = {"y": new.year, "m": new.month, "d": new.day}[name[0]]
        if value.isdecimal():
            written = str(part).zfill(width)
        else:
            spoken = next(x for x in _MONTH_NAMES if value.lower() in x)[part - 1]
            written = spoken.capitalize() if value[0].isupper() else spoken
        out += [text[at : m.start(name)], written]
        at = m.end(name)
    return "".join(out) + text[at:]


def _permute_checked(number: str, key: bytes, inverse: bool = False) -> str:
    """A number with check digits: they follow from the others, which are permuted; a birthday stays in the calendar, sex and month stay."""
    if len(number) == 18:
        free = permute_digits(number[:6] + number[14:17], key, inverse)
        day = f"{number[6:10]}-{number[10:12]}-{number[12:14]}"
        body = free[:6] + permute_date(day, key, inverse).replace("-", "") + free[6:]
        return next(body + c for c in "0123456789X" if _checks(body + c))
    d = number.replace(" ", "")
    free = permute_digits(d[1:3] + d[7:13], key, inverse)
    body = d[0] + free[:2] + d[3:7] + free[2:]
    check = next(f"{c:02}" for c in range(1, 98) if _checks(f"{body}{c:02}"))
    it = iter(body + check)
    return "".join(c if c == " " else next(it) for c in number)


def pseudonym(found: str, kind: str, key: bytes) -> str:
    """Numbers and dates: permuted within their format; other kinds: a keyed tag of 128 bits of the value without case and blanks."""
    if kind == "date":
        return permute_date(found, key)
    if kind in ("phone", "id_number"):
        start = country_code(found) if kind == "phone" else 0
        valid = valid_phone if kind == "phone" else valid_id
        if kind == "id_number" and regex.fullmatch(rf"\d{{17}}[\dXx]|{_NIR}", found) and _checks(found):
            return _permute_checked(found, key)
        digits = "".join(c for c in found[start:] if c.isdecimal())
        return _with_digits(found, start, _walk(digits, key, lambda v: valid(_with_digits(found, start, v))))
    value = regex.sub(r"[\s.,<>()\[\]]+", "", found.casefold())
    if kind == "name":
        value = "".join(sorted(regex.findall(r"[\p{L}\p{M}]+", found.casefold())))
    return hashlib.blake2b(f"{kind}:{value}".encode(), key=key, digest_size=16).hexdigest()


_LAST = rf"(?:(?:van|von|de|al){_GAP}|al-)?(?P<last>\p{{Ll}}[\p{{L}}\p{{M}}-]+)(?<!-)"


#: An initial in lower case before a name, or after a comma.
_LOWER_INITIAL = regex.compile(r"(?<![\p{L}\p{N}_@.+&'’-])[a-z]\.")


def candidates(given: frozenset[str] | None = None):
    """text, its stretches -> (begin, end, kind of evidence needed, surname) of names in lower case that only the corpus can decide."""
    known = given or frozenset(short_forms())
    either = lambda names: "|".join(map(regex.escape, sorted(names, key=lambda g: (-len(g), g)))) or r"(?!)"
    words, short = either(known & _WORDS), either(g for g in known - _WORDS if len(g) <= 3)
    clear, initials = r"(?<![\p{L}\p{N}_@.+&'’-])", rf"[a-z]\.(?:{_GAP}?[a-z]\.)*"
    forward = regex.compile(rf"{clear}(?:(?:(?P<word>{words})|{short})(?:{_GAP}[a-z]\.)*|{initials}){_GAP}{_LAST}(?![\p{{L}}@_+]|\.\p{{L}})")
    back = regex.compile(rf"{clear}{_LAST},{_GAP}(?:{initials}|(?:{words}|{short})(?:{_GAP}[a-z]\.)*(?![\p{{L}}\p{{N}}@'’-]))")

    short_words = (known & _WORDS) | {g for g in known - _WORDS if len(g) <= 3}

    def find(text: str, taken: list[tuple[int, int, str]], words: set[str]) -> list[tuple[int, int, str, str]]:
        out, ends = [], set()
        if short_words.isdisjoint(words) and not _LOWER_INITIAL.search(text):
            return out
        for pattern in (forward, back):
            for m in pattern.finditer(text, overlapped=True):
                a, b = m.span()
                if (pattern, m.end("last")) in ends or m["last"] in _NOT_SURNAMES or any(a < y and x < b for x, y, _ in taken):
                    continue
                ends.add((pattern, m.end("last")))  # of equal ends the first begin
                out.append((a, b, "more" if pattern is back or m["word"] else "either" if len(m["last"]) > 3 else "seen", m["last"]))
        return out

    return find


def _capital_surname(name: str) -> str | None:
    """The surname in lower case of a name that writes it with a capital."""
    last = name.split(",")[0] if "," in name else regex.split(r"[ \t   .]", name)[-1]
    last = regex.split(r"[ \t   ]", last)[-1]
    return last.lower() if last[:1].isupper() else None


_SCANNED = "text_hash long, begin int, end int, role string, kind string, found string, pseudonym string, given string, surname string, n int"
_AROUND = ".,;:!?\"'()[]{}<>’‘“”*/"


def _scan_all(given, key: bytes, dates: bool, many: int = 50_000):
    """Rows of three roles: stretches that are sure ("first" in their text, or "again"), candidates (role: the evidence they need), and per surname or word that one was seen."""

    def run(batches):
        find, unsure = finder(given, dates), candidates(given)
        schema = None
        surnames: Counter[str] = Counter()  # texts that have it
        ordinary: Counter[str] = Counter()

        def seen():
            rows = [("surname", *x) for x in surnames.items()] + [("ordinary", *x) for x in ordinary.items()]
            surnames.clear()
            ordinary.clear()
            return pa.RecordBatch.from_pylist([{"role": r, "surname": w, "n": n} for r, w, n in rows], schema=schema)

        for batch in batches:
            name = batch.schema.field(0)
            schema = pa.schema([pa.field(name.name, name.type), ("text_hash", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())] + [(c, pa.string()) for c in ("role", "kind", "found", "pseudonym", "given", "surname")] + [("n", pa.int32())])
            rows = []
            for k, text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_in(text)
                spans, pairs = find(text, words)
                maybe = unsure(text, spans, words)
                had = set()
                for a, b, kind in spans:
                    found = text[a:b]
                    rows.append((k, h, a, b, "again" if (kind, found) in had else "first", kind, found, pseudonym(found, kind, key), None, None, None))
                    had.add((kind, found))
                    if kind == "name" and (x := _capital_surname(found)):
                        surnames[x] += (x, "seen") not in had
                        had.add((x, "seen"))
                rows += [(k, h, a, b, role, "name", text[a:b], pseudonym(text[a:b], "name", key), None, last, None) for a, b, role, last in maybe]
                rows += [(k, h, a, b, "pair", "name", text[a:b], pseudonym(text[a:b], "name", key), first, last, None) for a, b, first, last in pairs]
                rest, at = [], 0
                for a, b, *_ in sorted([*spans, *maybe]):
                    rest.append(text[at : max(at, a)])
                    at = max(at, b)
                for w in words_in(" ".join([*rest, text[at:]])) if rest else words:
                    if len(w) > 1 and w[0].islower():
                        ordinary[w[:-2] if w.endswith(("'s", "’s")) else w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
            if len(ordinary) + len(surnames) > many:
                yield seen()
        if schema:
            yield seen()

    return run


def _scanned(documents: DataFrame, key: str, text: str, secret: str, given: frozenset[str] | None, dates: bool) -> DataFrame:
    """What the one scan of all texts gives, written, as it is read for stretches, candidates and evidence."""
    kind = dict(documents.dtypes)[key]
    # a text without a Latin, Greek or Cyrillic letter, digit or at sign has nothing that a pattern begins with
    rows = documents.select(key, text, F.xxhash64(text).alias("_h")).filter(F.col(text).rlike(r"[\p{Lu}\p{Ll}\p{Nd}@＠]"))
    return write_table(rows.mapInArrow(_scan_all(given, cipher_key(secret), dates), f"`{key}` {kind}, {_SCANNED}").withColumnRenamed(key, "_key"), "personal")


def _confirmed(scanned: DataFrame) -> DataFrame:
    """(_key, text_hash, names): of each text the candidates that the corpus confirms, from left to right without overlaps.

    After initials and short given names the surname must be seen with a capital
    in a sure name, or nowhere as an ordinary word; after a given name that is
    also a word, and before a comma, in more texts as a surname than as a word;
    after a capitalised word within a sentence that is no listed given name, in a sure
    name, and that word nowhere in lower case.
    """
    many = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0))
    seen = scanned.filter(F.col("role").isin("surname", "ordinary")).groupBy("surname").agg(many("surname").alias("_named"), many("ordinary").alias("_plain"))
    c = scanned.filter(F.col("role").isin("either", "more", "seen", "pair")).join(seen, "surname", "left")
    c = c.join(seen.select(F.col("surname").alias("given"), F.col("_plain").alias("_given_plain"), F.col("_named").alias("_given_named")), "given", "left")
    named, plain = F.coalesce("_named", F.lit(0)), F.coalesce("_plain", F.lit(0))
    pair = (named > plain) & (F.coalesce("_given_plain", F.lit(0)) == 0) & (F.coalesce("_given_named", F.lit(0)) == 0)
    right: Column = F.when(F.col("role") == "pair", pair).when(F.col("role") == "more", named > plain).when(F.col("role") == "seen", named > 0).otherwise((named > 0) | (plain == 0))
    each = F.array_sort(F.collect_set(F.struct("begin", "end", "found", "pseudonym")))
    apart = F.aggregate("_all", F.expr("CAST(array() AS array<struct<begin:int,end:int,found:string,pseudonym:string>>)"), lambda t, x: F.when(F.get(t, F.size(t) - 1)["end"] > x["begin"], t).otherwise(F.concat(t, F.array(x))))
    return c.filter(right).groupBy("_key", "text_hash").agg(each.alias("_all")).select("_key", "text_hash", apart.alias("names"))


def _replace(batches):
    """(key, text, spans in order) -> (key, text) with placeholders."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, at = [], 0
            for x in spans or ():
                parts += [text[at : x["begin"]], f"[{x['kind'].upper()} {x['pseudonym']}]"]
                at = x["end"]
            out.append("".join(parts) + text[at:] if parts else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=batch.schema.names[:2])


def find_personal(documents: DataFrame, secret: str, key: str = "doc_id", text: str = "text", given: frozenset[str] | None = None) -> DataFrame:
    """(key, kind, found, pseudonym): the stretches, each once per document and kind; null and empty texts have none."""
    s = _scanned(documents, key, text, secret, given, False)
    more = _confirmed(s).select("_key", F.explode("names").alias("x")).select("_key", F.lit("name").alias("kind"), "x.found", "x.pseudonym").distinct()
    sure = s.filter("role = 'first'").select("_key", "kind", "found", "pseudonym")
    # a name may be sure in one place and a candidate in another
    names = sure.filter("kind = 'name'").select(F.col("_key").alias("_k"), F.col("found").alias("_f"))
    more = more.join(names, F.expr("_key <=> _k AND found = _f"), "left_anti")
    return sure.unionByName(more).withColumnRenamed("_key", key)


def redact_personal(documents: DataFrame, secret: str, key: str = "doc_id", text: str = "text", given: frozenset[str] | None = None, dates: bool = False) -> DataFrame:
    """(key, text): each stretch replaced by ``[KIND pseudonym]``, the rest unchanged; null and empty texts stay.

    ``dates`` replaces days of the calendar too.  Rows of equal key and text have equal results.
    """
    kind = dict(documents.dtypes)[key]
    s = _scanned(documents, key, text, secret, given, dates)
    sure = s.filter("role IN ('first', 'again')").select("_key", "text_hash", F.struct("begin", "end", "kind", "pseudonym").alias("x"))
    more = _confirmed(s).select("_key", "text_hash", F.explode("names").alias("n")).select("_key", "text_hash", F.struct("n.begin", "n.end", F.lit("name").alias("kind"), "n.pseudonym").alias("x"))
    spans = sure.unionByName(more).groupBy("_key", "text_hash").agg(F.array_sort(F.collect_set("x")).alias("spans"))
    rows = documents.select(key, text, F.xxhash64(text).alias("_h"))
    rows = rows.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("text_hash")), "left").select(key, text, "spans")
    return rows.mapInArrow(_replace, f"`{key}` {kind}, `{text}` string")


def session_secret(spark: SparkSession) -> str:
    """The session's ``spanmill.secret``; where it names none, one is drawn, so that equal values stay linked within the session."""
    if not spark.conf.get("spanmill.secret", None):
        spark.conf.set("spanmill.secret", secrets.token_hex(32))
    return spark.conf.get("spanmill.secret")
