"""Personal data with offset-preserving deobfuscation.

Plain identifiers (e-mail, IP address, card, phone) are found on the text as it is. Then transducers rewrite
disguises - homoglyphs, spelled digits, "at"/"dot" - into plain characters while keeping, for every character
they emit, the source span it came from. Identifiers found in the rewritten text are mapped back through those
spans; one that overlaps a plain one of its kind is left out. Plain spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import small_batches, text_blocks

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can begin inside a run of digits only where the run's start can't, and then it can't either
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    # a part is compared without its leading zeros, which may be many
    return [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind, the leftmost non-overlapping spans (code points, end exclusive)."""
    some = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if some else [],
        "card": cards(text) if some else [],
        "phone": phones(text) if some and "+" in text else [],
    }


# Look-alikes of ASCII characters in Cyrillic and Greek, and other signs for @ . + -
_LOOK = dict(
    zip(
        "асеорхуіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαοριυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aceopxyijsdhqwABEKMHOPCTXYIJSaopiuvABEZHIKMNOPTYX",
        strict=True,
    )
)
_LOOK |= dict(zip("․。｡·‐‑‒–—−⁺", "....------+", strict=True))
# Full-width forms by their rule: U+FF01-U+FF5E stand for U+0021-U+007E; other digits by their block's zero.
_LOOK |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"﹫": "@"}
_LOOK |= {chr(zero + d): chr(48 + d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_LOOK |= {chr(0x2460 + d - 1): chr(48 + d) for d in range(1, 10)} | {chr(0x2080 + d): chr(48 + d) for d in range(10)}
_GONE = frozenset("​‌‍⁠﻿­")
_LOOKS = re.compile("[" + "".join(map(re.escape, [*_LOOK, *_GONE])) + "]")

# Spelled digits of the four languages of the corpora.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "una": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
_PLUS = {"plus", "dot", "point", "punkt", "punto"}
#: A run of spelled or written digits with anything spelled in it is a disguise; whether it is an identifier, the kinds decide.
_DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]+|\+\s?)?(?:{_NUMBER}|[0-9]++)(?:[\s,.-]{{1,3}}(?:{_NUMBER}|dot|point|punkt|punto|[0-9]++))+(?!\w)")
_TOKEN = re.compile(r"\w+|[^\w]+")
# Fixed values: "at" and "dot" in the four languages.
_AT_WORD, _DOT_WORD = "at|ät|arroba|arobase|arrobase", "dot|punkt|point|punto"
# a run of white space is tried from its start only, so long runs stay linear
_BRACKETED_AT = re.compile(rf"(?i)(?<!\s)\s*+[\[({{<]\s*+(?:{_AT_WORD}|@)\s*+[\])}}>]\s*+")
_BRACKETED_DOT = re.compile(rf"(?i)(?<!\s)\s*+[\[({{<]\s*+(?:{_DOT_WORD}|\.)\s*+[\])}}>]\s*+")
#: local AT domain DOT suffix, all spelled with spaces; and a plain @ whose domain has spelled dots.
_SPOKEN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)(\s++(?:{_AT_WORD})\s++)([A-Za-z0-9-]++)((?:(?:\s++(?:{_DOT_WORD})\s++|\.)[A-Za-z0-9-]++)+)(?![A-Za-z0-9-])")
_HALF_SPOKEN = re.compile(rf"(?i)(?<=[A-Za-z0-9])@[A-Za-z0-9-]++((?:(?:\s++(?:{_DOT_WORD})\s++|\.)[A-Za-z0-9-]++)+)(?![A-Za-z0-9-])")
_SPOKEN_DOT = re.compile(rf"(?i)\s+(?:{_DOT_WORD})\s+")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:(?<!\s)\s++@\s*+|\s*+@\s++)(?=[A-Za-z0-9-]++\s*+\.)")
_SPOKEN_AT = re.compile(rf"(?i)\s(?:{_AT_WORD})\s")


class Tape:
    """Text with the source span of each character; rewriting keeps the spans."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        # until something is rewritten, ranges stand for the places
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """`edits`: (start, end, replacement), in order, apart; each new character owns the whole replaced span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])


def _homoglyphs(tape: Tape) -> Tape:
    return tape if tape.text.isascii() else tape.rewrite([(m.start(), m.end(), _LOOK.get(m.group(), "")) for m in _LOOKS.finditer(tape.text)])


def _at_and_dot(tape: Tape) -> Tape:
    if any(x in tape.text for x in "[({<"):
        tape = tape.rewrite([(*m.span(), "@") for m in _BRACKETED_AT.finditer(tape.text)])
        # a bracketed dot is one where an @ shows that an address is meant
        if "@" in tape.text or _SPOKEN_AT.search(tape.text):
            tape = tape.rewrite([(*m.span(), ".") for m in _BRACKETED_DOT.finditer(tape.text)])
    if _SPOKEN_AT.search(tape.text):
        edits = []
        for m in _SPOKEN.finditer(tape.text):
            spoken = [(m.start(4) + d.start(), m.start(4) + d.end(), ".") for d in _SPOKEN_DOT.finditer(m.group(4))]
            if spoken:  # "at" before a written domain is a plain word
                edits += [(m.start(2), m.end(2), "@"), *spoken]
        tape = tape.rewrite(edits)
    if "@" in tape.text:
        edits = []
        for m in _HALF_SPOKEN.finditer(tape.text):
            edits += [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for d in _SPOKEN_DOT.finditer(m.group(1))]
        tape = tape.rewrite(edits)
        tape = tape.rewrite([(*m.span(), "@") for m in _SPACED_AT.finditer(tape.text)])
    return tape


def _spelled_digits(tape: Tape) -> Tape:
    edits = []
    for run in _DIGIT_RUN.finditer(tape.text):
        tokens = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(run.group())]
        if not any(t in _SPELLED or t in _PLUS for _, _, t in tokens):
            continue
        for k, (a, b, t) in enumerate(tokens):
            if t.isspace() and 0 < k < len(tokens) - 1 and tokens[k - 1][2] in _SPELLED and tokens[k + 1][2] in _SPELLED:
                edits.append((run.start() + a, run.start() + b, ""))  # digits spelled one by one are one number
                continue
            new = _SPELLED.get(t, "+" if t == "plus" else "." if t in _PLUS else t if t.isdigit() or t in ("+", ".") else "-" if "-" in t else "+" if "+" in t else " ")
            edits.append((run.start() + a, run.start() + b, new))
    tape = tape.rewrite(edits)
    if edits:  # single spaces between digits and dots go: the digits are one number
        tape = tape.rewrite([(m.start(), m.end(), m.group().strip()) for m in re.finditer(r"(?<=[0-9+])\s*\.\s*(?=[0-9])|(?<=[+])\s+(?=[0-9])", tape.text)])
    return tape


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Source spans of identifiers that only the rewritten text shows."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    tape = _spelled_digits(_at_and_dot(_homoglyphs(Tape(text))))
    if tape.text == text:
        return out
    for kind, spans in plain_spans(tape.text).items():
        known, found = base[kind], out[kind]
        ends = [y for _, y in known]
        for a, b in spans:
            start, end = tape.starts[a], tape.ends[b - 1]
            k = bisect.bisect_right(ends, start)  # both sides are in order and apart
            if k < len(known) and known[k][0] < end or found and found[-1][1] > start:
                continue
            if kind == "email" and not tape.text[a:b].rpartition(".")[2].isalpha():
                continue
            found.append((start, end))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted((a, k, kind, b) for k, kind in enumerate(KINDS) for a, b in spans[kind]))


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain and added spans per kind; a null text has none."""
    text = text or ""
    base = plain_spans(text)
    return base, added_spans(text, base)


def mask(text: str | None, fill: str = "[{}]") -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the first, longest one counts."""
    if text is None:
        return None
    base, added = find(text)
    spans = sorted((a, -b, kind) for kind in KINDS for a, b in base[kind] + added[kind])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], fill.format(kind)]
            at = -b
    return "".join([*out, text[at:]])


def personal_data(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans, n_added.

    A null text counts as empty: no spans, the hash of the empty string. Very long texts are searched whole, in time
    that grows with their length. Of spans of one kind that overlap the plain one stays, else the first. Rows are
    independent of each other, so repeated rows repeat their result; further columns are ignored, whatever their
    names; an empty table gives an empty result.
    """

    def run(batches):
        for batch in text_blocks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = find(text)
                every = {k: base[k] + added[k] for k in KINDS}
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, added.values()))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.string() if k in (4, 5) else pa.int64()) for k, c in enumerate(columns))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
