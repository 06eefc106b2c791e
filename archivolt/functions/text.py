"""Text functions: stems, labels, HTML, links, and repair of wrongly decoded text."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes that copies and edits leave on a file stem; any run of them goes.
STEM_SUFFIXES = (r"\s+copy", r"\s+duplicate", r"\s+dup", r"\s+alternate", r"\s+edited", r"\s+trimmed", r"\s*\(\d+\)", r"\s+-\s*\d+")
STEM_SUFFIX = rf"(\s*({'|'.join(STEM_SUFFIXES)}))+\s*$"


@F.pandas_udf(StringType())
def ascii_fold(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))


def normalized_stem(filename: Column) -> Column:
    """Lower-case letters and digits of the folded stem without extension, copy and edit suffixes."""
    stem = F.trim(F.lower(ascii_fold(F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", ""))))
    return F.regexp_replace(F.regexp_replace(stem, STEM_SUFFIX, ""), "[^a-z0-9]+", "")


def clean_text(text: Column, links: Column) -> Column:
    """Short links expanded, runs of blanks in a line one, at most one blank line, ends trimmed."""
    return collapse_blank(expand_links(text, links))


def collapse_blank(text: Column) -> Column:
    """Runs of blanks become one, more than one blank line becomes one, ends are trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def expand_links(text: Column, links: Column) -> Column:
    """Replace short links by their targets; ``links`` is an array of (short, target)."""
    return F.aggregate(links, text, lambda t, link: F.replace(t, link["short"], link["target"]))


def markdown_links(text: Column, token: str = r"\[\[([^|\]]+)\|([^\]]+)\]\]") -> Column:
    """Tokens [[label|target]] as Markdown links."""
    return F.regexp_replace(text, token, r"[$1]($2)")


def namespaced_tag(kind: Column, name: Column) -> Column:
    """kind:name in lower case, one hyphen for each run of other characters."""
    return F.concat(F.lower(kind), F.lit(":"), F.regexp_replace(F.trim(F.lower(name)), "[^a-z0-9]+", "-"))


def strip_label(value: Column) -> Column:
    """A value without a leading "Label:" part."""
    return F.trim(F.regexp_replace(value, r"^\s*[A-Za-z ]{1,20}:\s*", ""))


def text_change(before: Column, after: Column) -> Column:
    """unchanged, normalized_unchanged (equal but for case and blanks) or changed."""

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))

    return F.when(before.eqNullSafe(after), "unchanged").when(plain(before).eqNullSafe(plain(after)), "normalized_unchanged").otherwise("changed")


class _Text(HTMLParser):
    BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
    HIDDEN = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(value: str | None) -> str | None:
    """Visible text, one line per block."""
    if value is None:
        return None
    parser = _Text()
    parser.feed(value)
    parser.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(StringType())
def visible_text(values: pd.Series) -> pd.Series:
    return values.map(html_text)


#: Characters whose Windows-1252 byte differs from their code.
_WINDOWS = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Runs of characters with the shape of one UTF-8 sequence.
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def repaired(value: str | None) -> str | None:
    """Undo up to two rounds of UTF-8 read as Latin-1 or Windows-1252, each damaged character by itself; the rest stays.

    What was damaged twice is made of characters that the first round restores, so the second round takes no others: a
    restored letter and a mark that stood beside it are no sequence.
    """
    if value is None:
        return None
    once = _restored(value)
    out: list[str] = []
    for restored, run in groupby(once, key=lambda piece: piece[1]):
        pieces = [piece for piece, _ in run]
        if restored:
            pieces = [piece for piece, _ in _restored("".join(pieces))]
        out += pieces
    return "".join(out)


def _restored(value: str) -> list[tuple[str, bool]]:
    """The pieces of a text after one round, each with whether it was restored."""
    # One code for each character, so places in both texts agree.
    codes = "".join(_WINDOWS.get(c, c) for c in value)
    out, at = [], 0
    for found in _SEQUENCE.finditer(codes):
        try:
            better = bytes(map(ord, found[0])).decode("utf-8")
        except UnicodeDecodeError:
            better = ""
        if better and better.isprintable():
            if at < found.start():
                out.append((value[at : found.start()], False))
            out.append((better, True))
            at = found.end()
    return [*out, (value[at:], False)] if at < len(value) else out


@F.pandas_udf(StringType())
def repair_mojibake(values: pd.Series) -> pd.Series:
    return values.map(repaired)


def unescape_entities(value: str | None) -> str | None:
    return None if value is None else html.unescape(value)
