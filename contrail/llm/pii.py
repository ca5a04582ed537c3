"""Personal data in whole texts: plain identifiers, and disguised ones by offset-preserving rewriting.

The base kinds are found in the text as it stands. For the disguised ones a chain of
transducers rewrites the text: look-alike characters become ASCII and invisible ones
go, runs of spelled digits become digits, and "(at)", "[dot]" and the like become the
signs they stand for. Every transducer keeps, for each character it writes, where in
its input that character came from; the origins compose, so what is detected in the
rewritten text maps back to code points of the source.

Null texts count as empty and hold nothing. Spans are code points, end exclusive. A
rewritten find is added unless a base span of its kind covers it. Spans of different
kinds may overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does; possessive runs keep long digit strings linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> list[Span]:
    """Each @ with the local characters before it and a dotted name after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        name = _DOMAIN.match(text, at + 1) if start < at else None
        if name:
            found.append(("email", start, name.end()))
            free = name.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def detect(text: str) -> list[Span]:
    """The base spans of a text, by start and then kind."""
    found = _emails(text) if "@" in text else []
    for match in _IP.finditer(text):
        if all(map(_small, match.group().split("."))):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and _luhn(digits):
            found.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in match.group()) <= 15:
                found.append(("phone", *match.span()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# Characters that pass for ASCII ones.
LOOKALIKES = {
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H", "\u041e": "O",
    "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0423": "Y", "\u0425": "X", "\u0430": "a", "\u0435": "e",
    "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0405": "S", "\u0406": "I",
    "\u0408": "J", "\u0455": "s", "\u0456": "i", "\u0458": "j", "\u0475": "v", "\u04bb": "h", "\u04cf": "l",
    "\u0501": "d", "\u051b": "q", "\u051d": "w", "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z",
    "\u0397": "H", "\u0399": "I", "\u039a": "K", "\u039c": "M", "\u039d": "N", "\u039f": "O", "\u03a1": "P",
    "\u03a4": "T", "\u03a5": "Y", "\u03a7": "X", "\u03b1": "a", "\u03b9": "i", "\u03ba": "k", "\u03bd": "v",
    "\u03bf": "o", "\u03c1": "p", "\u03c4": "t", "\u03c5": "u", "\u03c7": "x",
}
SIGNS = {
    "\ufe6b": "@", "\u2024": ".", "\u3002": ".", "\uff61": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-",
    "\u2013": "-", "\u2212": "-", "\ufe63": "-",
}
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7,
    "acht": 8, "neun": 9, "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8,
    "neuf": 9, "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8,
    "nueve": 9,
}
AT_WORDS, DOT_WORDS = "at|arroba|ät|chez|@", "dot|punkt|point|punto|\\."

KEEP, DROP = -1, -2


@cache
def _letters() -> np.ndarray:
    """What each code point is rewritten to: KEEP, DROP or an ASCII code."""
    table = np.full(0x110000, KEEP, np.int32)
    for code in range(0x80, 0x110000):
        digit = unicodedata.decimal(chr(code), None)
        if digit is not None:
            table[code] = 48 + digit
    for letter, plain in LOOKALIKES.items():
        table[ord(letter)] = ord(plain)
    for sign, plain in SIGNS.items():
        table[ord(sign)] = ord(plain)
    for code in range(0x21, 0x7F):
        table[0xFF00 + code - 0x20] = code  # full-width forms
    for space in SPACES:
        table[ord(space)] = 0x20
    for mark in INVISIBLE:
        table[ord(mark)] = DROP
    return table


class Tape:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = np.arange(1, len(text) + 1) if ends is None else ends

    def rewritten(self, sites: list[tuple[int, int, str]]) -> Tape:
        """Replace disjoint stretches; every character written stands for its whole stretch."""
        if not sites:
            return self
        texts, starts, ends, done = [], [], [], 0
        for start, end, plain in sites:
            texts += [self.text[done:start], plain]
            starts += [self.starts[done:start], np.full(len(plain), self.starts[start])]
            ends += [self.ends[done:start], np.full(len(plain), self.ends[end - 1])]
            done = end
        texts.append(self.text[done:])
        return Tape(
            "".join(texts), np.concatenate([*starts, self.starts[done:]]), np.concatenate([*ends, self.ends[done:]])
        )


def fold_letters(tape: Tape) -> Tape:
    """Look-alikes to ASCII, other scripts' digits to digits, invisible characters away."""
    if tape.text.isascii():
        return tape
    codes = np.frombuffer(tape.text.encode("utf-32-le"), "<u4").astype(np.int64)
    plain = _letters()[codes]
    if (plain == KEEP).all():
        return tape
    kept = plain != DROP
    codes = np.where(plain >= 0, plain, codes)[kept]
    return Tape(codes.astype("<u4").tobytes().decode("utf-32-le"), tape.starts[kept], tape.ends[kept])


_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]+)?(?:(?:{_DIGIT}|[0-9])[\s,.-]{{1,3}}){{4,}}(?:{_DIGIT}|[0-9])(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"(?<!\w)(plus|{_DIGIT}|[0-9])(?!\w)", re.I)
_HAS_DIGIT_WORD = re.compile(rf"(?<!\w)(?:{_DIGIT})[\s,.-]{{1,3}}(?:{_DIGIT}|[0-9])(?!\w)", re.I)


def fold_digits(tape: Tape) -> Tape:
    """Runs of five or more spelled or single digits, one of them spelled at least, to a digit string."""
    if not _HAS_DIGIT_WORD.search(tape.text):
        return tape
    sites = []
    for match in _SPELLED.finditer(tape.text):
        parts = [m for m in _SPELLED_PART.finditer(tape.text, match.start(), match.end())]
        if all(p.group(1).isdigit() for p in parts):
            continue
        # each part is a site that takes the separator behind it along, so origins stay exact
        for part, after in zip(parts, [*parts[1:], None]):
            word = part.group(1).lower()
            plain = "+" if word == "plus" else word if word.isdigit() else str(DIGIT_WORDS[word])
            sites.append((part.start(), part.end(), plain))
            if after is not None and after.start() > part.end():
                sites.append((part.end(), after.start(), ""))
    return tape.rewritten(sites)


_BRACKETED = re.compile(rf"[\[({{<]\s*(?:(?P<at>{AT_WORDS})|(?P<dot>{DOT_WORDS}))\s*[\])}}>]\s*", re.I)
# without brackets and without a spelled dot the name must end in a common top-level domain; fixed values
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|eu|de|fr|es|uk|us|ch|it|nl|be|ca|au|jp|ru|br|mx|in"
_DOT = r"\s+(?:dot|punkt|point|punto)\s+"
_NAME = "[A-Za-z0-9-]+"
_HEAD = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?P<at>\s+(?:at|arroba)\s+|@)"
# with a spelled dot any letters end the name, unless they are the local part of a further address
_SPOKEN = re.compile(
    rf"{_HEAD}{_NAME}(?:\.{_NAME})*{_DOT}(?:{_NAME}(?:{_DOT}|\.))*(?P<last>[A-Za-z]{{2,}})(?![A-Za-z0-9-])"
    rf"(?!(?:\s+(?:at|arroba)\s+|@){_NAME}(?:{_DOT}|\.)[A-Za-z])",
    re.I,
)
_BARE = re.compile(rf"{_HEAD}{_NAME}(?:(?:{_DOT}|\.){_NAME})*(?:{_DOT}|\.)(?:{TOP_LEVEL})(?![A-Za-z0-9-])", re.I)
_BARE_SIGN = re.compile(r"\s+(?:(?P<at>at|arroba)|(?P<dot>dot|punkt|point|punto))\s+", re.I)
_AT_SIGN = re.compile(r"\s(?:at|arroba)\s|@", re.I)
_STARTS = re.compile(_HEAD, re.I)
_WEB = re.compile(r"\s+(?:at|arroba)\s+www\.", re.I)
# "the dot on", "at this point we": such words stand before a dot word or behind it only in prose; none is a
# top-level domain. Fixed values
_PROSE_BEFORE = re.compile(rf"\b(?:the|an?|this|that|these|those|some|any|one|which|what|every|each|no|another){_DOT}", re.I)
_PROSE_LAST = frozenset(
    "the an and or but if of on for from with by than then that this these those there their they we he she you "
    "was were are has had have will would can could should when where which who while because into onto over "
    "under after before not".split()
)


def _bare(text: str) -> Iterator[re.Match]:
    """Addresses without brackets; each is decided by its own characters alone."""
    at = 0
    while head := _STARTS.search(text, at):
        match = _SPOKEN.match(text, head.start())
        if match and (match.group("last").lower() in _PROSE_LAST or _PROSE_BEFORE.search(match.group())):
            match = None
        match = match or _BARE.match(text, head.start())
        if match and _WEB.match(text, match.start("at")):
            match = None  # "us at www.example.com" names a site
        if match:
            yield match
        at = match.end() if match else head.start("at")


def fold_signs(tape: Tape) -> Tape:
    """Disguised @ and dots to the signs."""
    sites = []
    for match in _BRACKETED.finditer(tape.text):
        start, free = match.start(), sites[-1][1] if sites else 0
        while start > free and tape.text[start - 1].isspace():
            start -= 1
        sites.append((start, match.end(), "@" if match.group("at") else "."))
    tape = tape.rewritten(sites)
    if not _AT_SIGN.search(tape.text):
        return tape
    sites = []
    for match in _bare(tape.text):
        seen_at = "@" in match.group()
        for sign in _BARE_SIGN.finditer(tape.text, *match.span()):
            if sign.group("at"):
                if not seen_at:
                    sites.append((*sign.span(), "@"))
                seen_at = True
            elif seen_at:
                sites.append((*sign.span(), "."))
    return tape.rewritten(sites)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in code points of the source."""
    source = Tape(text)
    tape = fold_signs(fold_digits(fold_letters(source)))
    if tape is source:
        return []
    added = []
    for kind, start, end in detect(tape.text):
        span = kind, int(tape.starts[start]), int(tape.ends[end - 1])
        if not any(k == kind and a <= span[1] and span[2] <= b for k, a, b in base) and span not in added:
            added.append(span)
    return added


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the disguised ones."""
    base = detect(text)
    added = disguised(text, base)
    return base, sorted(base + added, key=_order) if added else base


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def redact(text: str, found: list[Span]) -> str:
    """The text with a mark of its kind in place of each span; overlapping spans give one mark."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in found:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"<{kind}>"]
        done = end
    return "".join([*out, text[done:]])


FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base: string, spans: string>"


def find(text: str | Column) -> Column:
    """Counts and spans of a text column."""

    @F.arrow_udf(FOUND)
    def run(column: pa.Array) -> pa.Array:
        counts: list[list[int]] = [[] for _ in KINDS]
        bases, every = [], []
        for body in column.to_pylist():
            base, found = spans(body or "")
            for kind, out in zip(KINDS, counts):
                out.append(sum(k == kind for k, _, _ in base))
            bases.append(joined(base))
            every.append(joined(found))
        arrays = [pa.array(out, pa.int64()) for out in counts] + [pa.array(bases), pa.array(every)]
        return pa.StructArray.from_arrays(
            [a.cast(pa.string()) if pa.types.is_null(a.type) else a for a in arrays],
            ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
        )

    return run.asNondeterministic()(text)


def redacted(text: str | Column) -> Column:
    """A text column with all spans marked over; texts without any stay as they are, nulls null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for body in column.to_pylist():
            found = spans(body)[1] if body else []
            out.append(redact(body, found) if found else body)
        return pa.array(out, pa.string())

    return run.asNondeterministic()(text)


def find_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its id, base counts, base spans and all spans."""
    return docs.select(F.col(doc_id).alias("doc_id"), find(F.col(text)).alias("f")).select("doc_id", "f.*")
