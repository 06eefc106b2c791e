"""Operator 8: personal data, also where it is disguised, with spans in the source text.

The base kinds are found in the text as it is. Then transducers rewrite a text that holds a disguise: look-alike
letters and digits become ASCII and invisible characters vanish; digits spelled as words become digits; "at" and
"dot" in brackets, or as words in the shape of an address, become "@" and ".". Each rewriting keeps, for every
character it puts out, the stretch of the source that it stands for. The base kinds are found again in the
rewritten text; findings that hold a rewritten character are mapped back and added. Base findings always stay.

The work on one text is linear in its length; texts without a disguise are only searched.

Defined cases: a null text is empty; repeated rows are treated alike; a null doc_id is kept; extra columns are
ignored by ``detect``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm._io import map_rows

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits matches from its start or not at all, so the look-behind changes nothing but the work.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each "@" outwards: the longest local part before it that no finding holds, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.group().split(".")):
            yield found.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _NOT_DIGITS.sub("", found.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGITS.sub("", found.group())) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base findings of one text, in order."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, b, 1) for a, b in _ips(text)]
        out += [(a, b, 2) for a, b in _cards(text)]
        if "+" in text:
            out += [(a, b, 3) for a, b in _phones(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


# Characters of other scripts that look like each ASCII character.
LOOKS = {
    ",": "‚", "-": "‐‑−", ".": "․", "6": "б", "@": "﹫", "A": "АΑ",
    "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј",
    "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ",
    "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", "a": "аα",
    "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іιı",
    "j": "ј", "k": "к", "l": "ӏⅼ", "m": "м", "o": "оο", "p": "ρр",
    "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "ц", "v": "ν",
    "w": "ԝ", "x": "х", "y": "у",
}
LOOK_ALIKES = {other: plain for plain, others in LOOKS.items() for other in others}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Blocks whose compatibility forms are single ASCII characters: full width, mathematical, enclosed, super- and subscripts.
_FORMS = ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2460, 0x2468), (0x24B6, 0x24E9), (0x2070, 0x2079), (0x2080, 0x2089), (0xFE52, 0xFE6B))


def _substitutes() -> dict[str, str]:
    table = dict(LOOK_ALIKES) | dict.fromkeys(INVISIBLE, "")
    for first, last in _FORMS:
        for code in range(first, last + 1):
            form = unicodedata.normalize("NFKC", chr(code))
            if len(form) == 1 and form.isascii():
                table[chr(code)] = form
    for decimal in range(0x660, 0xFF1A):
        if chr(decimal).isdecimal():
            table[chr(decimal)] = str(unicodedata.decimal(chr(decimal)))
    return table


SUBSTITUTES = _substitutes()

SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SIGNS = {"dot": ".", "point": ".", "plus": "+", "dash": "-", "hyphen": "-"}
_NUMBER = "|".join(SPELLED)
_TOKEN = rf"(?:{_NUMBER}|{'|'.join(SIGNS)}|\+?[0-9]+)"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9]){_TOKEN}(?:[\s,.()-]{{1,3}}{_TOKEN})+(?![A-Za-z0-9])", re.I)
_RUN_TOKEN = re.compile(_TOKEN, re.I)
_SPELLED_PAIR = re.compile(rf"(?:{_NUMBER})[\s,.()-]{{1,3}}(?:{_NUMBER}|dot|point|[0-9])", re.I)

_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_AT = rf"(?:\s{{0,2}}{_OPEN}(?:at|@){_CLOSE}\s{{0,2}}|_at_)"
_DOT = rf"(?:\s{{0,2}}{_OPEN}(?:dot|\.){_CLOSE}\s{{0,2}}|_dot_)"
_WORD_AT, _WORD_DOT = r"\s{1,2}at\s{1,2}", r"\s{1,2}dot\s{1,2}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_ADDRESS = re.compile(
    rf"(?<=[A-Za-z0-9%+-])(?P<at>{_AT}|{_WORD_AT}|\s{{0,2}}@\s{{0,2}})(?P<rest>{_LABEL}(?:(?:{_DOT}|{_WORD_DOT}|\.){_LABEL})+)", re.I
)
_ANY_DOT = re.compile(rf"{_DOT}|{_WORD_DOT}", re.I)
_BARE_AT = re.compile(r"\s+at\s+", re.I)
_LOCAL_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_DOT}|{_WORD_DOT})(?=[A-Za-z0-9._%+-]{{1,64}}(?:{_AT}|{_WORD_AT}|@))", re.I)
_ADDRESS_HINT = re.compile(r"[\[({<_]\s{0,2}(?:at|@|dot|\.)\s{0,2}[\])}>_]|\sdot\s", re.I)


@dataclass
class Mapped:
    """A rewritten text; character i stands for source[starts[i]:ends[i]]."""

    text: str
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: str) -> Mapped:
        places = np.arange(len(text) + 1)
        return cls(text, places[:-1], places[1:])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace disjoint stretches, in order; what replaces one stands for all of its source."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for begin, end, new in edits:
            text += [self.text[at:begin], new]
            starts += [self.starts[at:begin], np.full(len(new), self.starts[begin])]
            ends += [self.ends[at:begin], np.full(len(new), self.ends[end - 1])]
            at = end
        return Mapped(
            "".join([*text, self.text[at:]]),
            np.concatenate([*starts, self.starts[at:]]),
            np.concatenate([*ends, self.ends[at:]]),
        )


def fold_look_alikes(mapped: Mapped) -> Mapped:
    return mapped.rewrite([(i, i + 1, SUBSTITUTES[c]) for i, c in enumerate(mapped.text) if c in SUBSTITUTES])


def fold_spelled_digits(mapped: Mapped) -> Mapped:
    """In runs with at least two spelled digits: words become digits and signs, blanks next to them vanish."""
    edits = []
    for run in _SPELLED_RUN.finditer(mapped.text):
        tokens = list(_RUN_TOKEN.finditer(mapped.text, run.start(), run.end()))
        spelled = [t.group().lower() in SPELLED for t in tokens]
        if sum(spelled) < 2:
            continue
        for i, token in enumerate(tokens):
            word = token.group().lower()
            if i:
                gap = (tokens[i - 1].end(), token.start())
                by_word = not (tokens[i - 1].group()[-1].isdigit() and word[-1].isdigit())
                if by_word and mapped.text[gap[0] : gap[1]].strip(" \t\n-,") == "":
                    edits.append((*gap, ""))
            if word in SPELLED or word in SIGNS:
                edits.append((*token.span(), SPELLED.get(word) or SIGNS[word]))
    return mapped.rewrite(edits)


def fold_addresses(mapped: Mapped) -> Mapped:
    """"at" and "dot" of addresses; a bare word "at" counts only with a disguised dot after it."""
    edits = []
    for found in _ADDRESS.finditer(mapped.text):
        dots = list(_ANY_DOT.finditer(mapped.text, *found.span("rest")))
        if not dots and (_BARE_AT.fullmatch(found["at"]) or found["at"] == "@"):
            continue
        if found["at"].strip() == "@" and not dots:
            continue
        if found["at"] != "@":
            edits.append((*found.span("at"), "@"))
        edits += [(*d.span(), ".") for d in dots]
    mapped = mapped.rewrite(edits)
    local = [(*m.span(), ".") for m in _LOCAL_DOT.finditer(mapped.text)]
    return mapped.rewrite(local)


#: Lower case for ASCII letters, blanks for all other ASCII; bytes of other characters stay.
_TO_WORDS = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))
_DIGIT_WORDS = frozenset(w.encode() for w in SPELLED)
_SIGN_MARKS = ("(.)", "[.]", "{.}", "<.>", "(@)", "[@]", "{@}", "<@>")


def is_disguised(text: str) -> bool:
    """Whether a transducer could change the text; the costly patterns are tried where their words occur."""
    if not text.isascii() and not SUBSTITUTES.keys().isdisjoint(set(text)):
        return True
    words = set(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())
    if not words.isdisjoint(_DIGIT_WORDS) and _SPELLED_PAIR.search(text):
        return True
    if b"dot" in words or (b"at" in words and any(c in text for c in "[({<_")) or any(m in text for m in _SIGN_MARKS):
        return bool(_ADDRESS_HINT.search(text))
    return False


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base findings, and all findings: those plus the disguised ones, in order."""
    base = base_spans(text)
    if not is_disguised(text):
        return base, base
    mapped = fold_addresses(fold_spelled_digits(fold_look_alikes(Mapped.of(text))))
    more = set(base)
    for start, end, kind in base_spans(mapped.text):
        begin, stop = int(mapped.starts[start]), int(mapped.ends[end - 1])
        if text[begin:stop] != mapped.text[start:end]:
            more.add((begin, stop, kind))
    return base, sorted(more, key=lambda x: (x[0], x[2], x[1]))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base findings by kind, base_sha256 of their list, and the list of all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            base, found = find_spans(text or "")
            for kind, column in enumerate(counts):
                column.append(sum(s[2] == kind for s in base))
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            spans.append(_listed(found))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, with every finding in ``text`` replaced by its kind in angle brackets."""
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text in batch.column(at).to_pylist():
            parts, done = [], 0
            for start, end, kind in find_spans(text)[1] if text else []:
                if end > done:
                    parts += [text[done : max(start, done)], f"<{KINDS[kind]}>" if start >= done else ""]
                    done = end
            texts.append(None if text is None else "".join([*parts, text[done:]]))
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs, run, schema)
