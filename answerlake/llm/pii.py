"""Personal data in disguise: normalise, detect, map back.

Transducers rewrite a text and keep, for every character they put out, the
source characters it stands for: look-alike characters and foreign digits
become ASCII, runs of spelled digits become digits, so do letters that stand
in for digits among digits, "at" and "dot" in addresses become their signs. The detectors run on the plain text (base spans)
and on the rewritten one; spans found there are mapped back to the source and
added where no base span covers them.

Signs written as words or set apart by blanks count only where an address is
likely: see ``_address_edits`` and ``_number_edits``. "At this point in" or
"chapter 1 point 2 point 3 point 4" stay as they are.

Nulls and empty texts have no spans. Repeated rows are judged each for itself;
an empty table gives an empty result. All offsets are code points, end exclusive.
Ties: spans that start together are listed by kind. Very long texts are read
whole in time proportional to their length; addresses and numbers have any
number of parts and separators. The columns added win over clashing ones.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.llm import common

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans, leftmost and non-overlapping within each kind; linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- transducers ---------------------------------------------------------------------------------------------------

#: Letters that look like ASCII ones but do not fold to them by compatibility (fixed values).
LOOKALIKES = dict(zip("аесорхуіјѕԁһԛԝкмтвнАВЕКМНОРСТХУІЈЅοανιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aecopxyijsdhqwkmtbhABEKMHOPCTXYIJSoaviptukABEZHIKMNOPTYX"))
#: Characters that show nothing or only a break chance.
INVISIBLE = "­​‌‍⁠﻿"
_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "﹫": "@", "。": ".", "․": ".", "∙": ".", "·": "."}

#: Spelled digits (fixed values).
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_NUMBER = rf"(?:{_WORD}|[0-9]+)"
_SPELLED = re.compile(
    rf"(?:\bplus[ \t]+|\+[ \t]?)?(?<!\w)(?:{_WORD})(?!\w)(?:[ \t,().-]++(?:(?:dot|point|punto|punkt)[ \t]+)?{_NUMBER}(?!\w)){{2,}}", re.I)
_PART = re.compile(rf"(?<!\w)({_WORD})(?!\w)|([0-9]+)|(\bplus\b|\+)|(dot|point|punto|punkt)", re.I)

_AT = r"(?:[ \t]*[\[({<][ \t]*(?:at|arroba|@)[ \t]*[\])}>][ \t]*|[ \t]+(?:at|arroba)[ \t]+|[ \t]*@[ \t]*)"
_DOT = r"(?:[ \t]*[\[({<][ \t]*(?:dot|punto|punkt|point|\.)[ \t]*[\])}>][ \t]*|[ \t]+(?:dot|punto|punkt|point|\.)[ \t]+|\.)"
#: Parts of addresses and the signs between them, as long as they go on; each chain is read once.
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:{_AT}|{_DOT})[A-Za-z0-9_%+-]++)+", re.I)
_SIGN = re.compile(rf"({_AT})|({_DOT})", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
#: A word before the name that says that mail is meant: a plain " at " before plain dots counts after it.
_MAIL_TO = re.compile(
    r"(?<![\w-])(?:(?:e-?)?mail|write|contact|reach)(?:[ \t]+to)?:?[ \t]+(?!(?:me|us|him|her|it|them|you)[ \t])"
    r"[A-Za-z0-9._%+-]+([ \t]+at[ \t]+)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.([A-Za-z0-9-]+)", re.I)
_NUMBERS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: What any address or number with a sign to rewrite holds.
_CLEAR_AT_HINT = re.compile(r"[\[({<][ \t]*(?:at|@)")
_CLEAR_DOT_HINT = re.compile(r"[\[({<][ \t]*\.")
_DOT_WORDS, _MAIL_WORDS = ("dot", "punto", "punkt", "point"), ("mail", "write", "contact", "reach")
_SPACED_DOT_HINT = re.compile(r"[ \t]\.[ \t]")
_NUMBER_HINT = re.compile(r"[0-9][ \t]+\.[ \t]+[0-9]")

#: Top-level labels that end an address without brackets; country codes that are common words are left out (fixed values).
TOP_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro museum coop aero jobs mobi travel tel io co ai app dev tech online site shop blog cloud web xyz club live news email "
    "ac ae al ar au ba bd bg bh bo br bw by ca ch ci cl cn cr cu cy cz de dk dz ec ee eg es et eu fi fj fr ge gh gl gr gt hk hn hr ht hu id ie il iq ir jm jo jp ke kr kw kz "
    "lb li lk lt lu lv ly ma mc md mk mm mt mu mx mz na ng ni nl np nz om pa pe pg ph pk pl pr ps pt py qa ro rs ru rw sa sd se sg si sk sn sv sy th tn tr tt tw tz ua ug uk uy uz ve vn "
    "ye za zm zw".split())
#: Words before " at " or after it that belong to a sentence, not to an address (fixed values).
SENTENCE_WORDS = frozenset(
    "a an the this that these those every each some any no one what which my your his her our their its same last first next point "
    "i you he she it we they me us him them is was are were be been being am do does did has have had and or but not only just even "
    "look looks looked looking stop stops stopped stay stayed stand stood start started end ended arrive arrived aim aimed point pointed stare stared laugh laughed "
    "work works worked working meet met live lives lived good here there up down back out off one two both all".split())


class Mapped:
    """A rewritten text; character ``i`` stands for source characters ``start[i]:stop[i]``."""

    def __init__(self, text: str, start: list[int] | range, stop: list[int] | range):
        self.text, self.start, self.stop = text, start, stop

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace each ``[a, b)``, in order, by its string; every new character stands for the whole of it."""
        text, start, stop, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *([self.start[a]] * len(new))]
            stop += [*self.stop[at:a], *([self.stop[b - 1]] * len(new))]
            at = b
        return Mapped("".join([*text, self.text[at:]]), [*start, *self.start[at:]], [*stop, *self.stop[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.stop[b - 1]


@functools.cache
def _folds() -> dict[str, str]:
    folds = {c: "" for c in INVISIBLE} | LOOKALIKES | _SIGNS
    for n in range(0x80, 0x20000):
        c = chr(n)
        if c not in folds and not 0xD800 <= n < 0xE000:
            digit = unicodedata.decimal(c, None)
            plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and " " <= plain < "\x7f" and c not in "ªº´`¨¸":
                folds[c] = plain
    return folds


def fold_characters(m: Mapped) -> Mapped:
    if m.text.isascii() or _folds().keys().isdisjoint(set(m.text)):
        return m
    folds = _folds()
    return m.rewrite([(i, i + 1, folds[c]) for i, c in enumerate(m.text) if c in folds])


_TOKEN = re.compile(r"\w+")
#: Letters that patterns without case take for i and s.
_CASELESS = str.maketrans("\u0130\u0131\u017f", "iis")


def spelled_digits(m: Mapped) -> Mapped:
    """Runs of three or more digits, of which one at least is spelled, become digits without gaps."""
    plain = m.text if m.text.isascii() else m.text.translate(_CASELESS)
    if DIGITS.keys().isdisjoint(_TOKEN.findall(plain.lower())):
        return m
    edits = []
    for run in _SPELLED.finditer(m.text):
        parts = list(_PART.finditer(m.text, *run.span()))
        for k, p in enumerate(parts):
            end = parts[k + 1].start() if k + 1 < len(parts) else run.end()
            edits.append((p.start(), end, DIGITS[p[1].translate(_CASELESS).lower()] if p[1] else p[2] or ("+" if p[3] else ".")))
    return m.rewrite(edits) if edits else m


def _bracketed(sign: str) -> bool:
    return sign.strip()[:1] in ("[", "(", "{", "<")


def _address_edits(text: str, chain: re.Match) -> list[tuple[int, int, str]]:
    """Signs to rewrite in one chain of parts and signs, from the left.

    An address is parts, a sign for "at", and labels. With a bracketed sign any
    labels count. Without, signs are words or spaced: the last label has to be a
    known top-level one, and neither side of "at" a word that sentences have
    there. A plain " at " before plain dots alone is no address.
    """
    signs = list(_SIGN.finditer(text, *chain.span()))
    edges = [chain.start(), *(x for s in signs for x in s.span()), chain.end()]
    parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
    ats = [i for i, s in enumerate(signs) if s[1]]
    edits: list[tuple[int, int, str]] = []
    begin = 0
    for n, at in enumerate(ats):
        stop = ats[n + 1] if n + 1 < len(ats) else len(signs)
        dots = signs[at + 1:stop]
        labels = parts[at + 1:stop + 1]
        good = 0
        while good < len(labels) and _LABEL.fullmatch(labels[good]):
            good += 1
        if any(_bracketed(s[0]) for s in (signs[at], *dots[:max(good - 1, 0)])):
            last = good - 1
        else:
            last = max((k for k in range(1, good) if labels[k].lower() in TOP_LABELS), default=0)
            words = signs[at][0].strip().lower() == "at"
            if words and (parts[at].lower() in SENTENCE_WORDS or labels[0].lower() in SENTENCE_WORDS or all(s[0] == "." for s in dots[:last])):
                last = 0
        if last > 0:
            found = [*signs[begin:at], signs[at], *dots[:last]]
            edits += [(s.start(), s.end(), "@" if s[1] else ".") for s in found if s[0] not in ("@", ".")]
            begin = at + 1 + last
        else:
            begin = at + 1
    return edits


def _number_edits(text: str, run: re.Match) -> list[tuple[int, int, str]]:
    """Signs of four numbers; without brackets numbers like those of chapters and versions stay as they are."""
    signs = [s for s in _SIGN.finditer(text, *run.span()) if s[0] != "."]
    if not any(_bracketed(s[0]) for s in signs):
        longest = max(map(len, re.findall("[0-9]+", run[0])))
        dots = all(s[0].strip().lower() in ("dot", "punto", "punkt") for s in signs)
        if longest < (2 if dots else 3):
            return []
    return [(s.start(), s.end(), ".") for s in signs]


def address_signs(m: Mapped) -> Mapped:
    """In "name at host dot end" and its bracketed forms, and in "1 dot 2 dot 3 dot 40", the words become signs."""
    low = m.text.lower()
    dots = any(x in low for x in _DOT_WORDS) or bool(_CLEAR_DOT_HINT.search(low))
    if dots or "arroba" in low or _CLEAR_AT_HINT.search(low) or ("@" in low and (
            any(x in low for x in (" @", "@ ", "\t@", "@\t")) or _SPACED_DOT_HINT.search(low))):
        edits = [e for chain in _CHAIN.finditer(m.text) for e in _address_edits(m.text, chain)]
        m = m.rewrite(edits) if edits else m
    if any(x in low for x in _MAIL_WORDS):
        edits = [(*a.span(1), "@") for a in _MAIL_TO.finditer(m.text) if a[2].lower() in TOP_LABELS]
        m = m.rewrite(edits) if edits else m
    if dots or _NUMBER_HINT.search(m.text):
        edits = [e for run in _NUMBERS.finditer(m.text) for e in _number_edits(m.text, run)]
        m = m.rewrite(edits) if edits else m
    return m


#: Letters that stand in for digits among digits (fixed values).
STAND_INS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "Z": "2", "S": "5", "B": "8"}
_MIXED = re.compile(r"(?<![^\W\d_])[0-9OolIZSB|](?:[ ().-]*+[0-9OolIZSB|]){6,}(?![^\W\d_])")


def stand_ins(m: Mapped) -> Mapped:
    """In runs that are mostly digits, letters that look like digits become digits."""
    if not _DIGIT.search(m.text):
        return m
    edits = []
    for run in _MIXED.finditer(m.text):
        odd = [i for i in range(*run.span()) if m.text[i] in STAND_INS]
        if odd and 2 * len(odd) < sum(map(run[0].count, "0123456789")):
            edits += [(i, i + 1, STAND_INS[m.text[i]]) for i in odd]
    return m.rewrite(edits) if edits else m


TRANSDUCERS: tuple[Callable[[Mapped], Mapped], ...] = (fold_characters, spelled_digits, stand_ins, address_signs)


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and the added ones."""
    if not text:
        return [], []
    base, mapped = detect(text), Mapped.of(text)
    for step in TRANSDUCERS:
        mapped = step(mapped)
    if isinstance(mapped.start, range):
        return base, []
    # Base spans of a kind do not overlap: the last one that starts at or before a span is the only one that can hold it.
    own = {kind: [(x, y) for x, y, k in base if k == kind] for kind in KINDS}
    added = []
    for a, b, kind in detect(mapped.text):
        a, b = mapped.source(a, b)
        at = bisect.bisect_right(own[kind], a, key=lambda s: s[0])
        if not at or own[kind][at - 1][1] < b:
            added.append((a, b, kind))
    return base, added


def _line(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def masked(text: str, found: list[Span]) -> str:
    """Each span, joined with those it overlaps, becomes [KIND] of the first one."""
    out, done = [], 0
    for a, b, kind in sorted(found):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) and n_added."""
    common.ready(docs.sparkSession)
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]

    def make():
        def work(texts):
            rows = []
            for text in texts:
                base, added = spans(text)
                kinds = [k for _, _, k in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + added), len(added)))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in fields]
        return work

    return common.add_columns(docs, [text_column], fields, make, keep)


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows with every span of the text replaced by its kind, and ``masked``, whether there was one; nulls stay null."""
    common.ready(docs.sparkSession)

    def make():
        def work(texts):
            found = [spans(t) for t in texts]
            return [[masked(t, b + a) if b or a else t for t, (b, a) in zip(texts, found)], [bool(b or a) for b, a in found]]
        return work

    fields = [T.StructField("masked_text", T.StringType()), T.StructField("masked", T.BooleanType())]
    out = common.add_columns(docs, [text_column], fields, make, [c for c in docs.columns if c != text_column])
    return out.select(*[F.col("masked_text" if c == text_column else f"`{c}`").alias(c) for c in docs.columns if c.lower() != "masked"], "masked")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
