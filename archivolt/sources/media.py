"""Image headers, pixels and embedded dates from file contents, in Arrow batches."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Tags of the three dates in a TIFF directory: changed, taken, digitised.
DATE_TAGS = {0x0132: "modify", 0x9003: "original", 0x9004: "digitized"}
_DIRECTORY = 0x8769


def tiff_dates(data: bytes) -> dict[str, str]:
    """Date texts of a TIFF block; damaged directories give what was readable."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return {}
    found: dict[str, str] = {}
    queue, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while queue:
        at = queue.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            place = at + 2 + 12 * i
            if place + 12 > len(data):
                break
            tag, kind, count, value = struct.unpack_from(order + "HHII", data, place)
            if tag == _DIRECTORY:
                queue.append(value)
            elif tag in DATE_TAGS and kind == 2:
                start = place + 8 if count <= 4 else value
                text = data[start : start + count].split(b"\0")[0].decode("ascii", "ignore").strip()
                if text:
                    found.setdefault(DATE_TAGS[tag], text)
    return found


def jpeg_dates(data: bytes | None) -> dict[str, str]:
    """Date texts of the first EXIF segment of a JPEG."""
    if not data or data[:2] != b"\xff\xd8":
        return {}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        if data[at + 1] == 0xFF or data[at + 1] == 0x01 or 0xD0 <= data[at + 1] <= 0xD8:
            at += 1 if data[at + 1] == 0xFF else 2  # a fill byte, or a marker without a length
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return tiff_dates(body[6:])
        at += 2 + size
    return {}


_DATES = StructType().add("original", "string").add("digitized", "string").add("modify", "string")


@F.pandas_udf(_DATES)
def exif_dates(contents: pd.Series) -> pd.DataFrame:
    found = [jpeg_dates(c) for c in contents]
    return pd.DataFrame({name: [f.get(name) for f in found] for name in ("original", "digitized", "modify")})


#: The header of a binary PPM: three numbers after white space and comments of any length, then one white-space byte.
_GAP = rb"(?:\s|#[^\n\r]*[\n\r])+"
_PPM = re.compile(rb"P6" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,5})\s")


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP, PPM or JPEG."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", data, 16)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"BM":
            width, height = struct.unpack_from("<ii", data, 18)
            return width, abs(height)
        if data[:2] == b"P6":
            found = _PPM.match(data)
            return (int(found[1]), int(found[2])) if found else None
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data) and data[at] == 0xFF:
                kind = data[at + 1]
                if kind == 0xFF:  # fill bytes before a marker
                    at += 1
                elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a length
                    at += 2
                elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", data, at + 5)
                    return width, height
                else:
                    at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    except (struct.error, ValueError):
        return None
    return None


@F.pandas_udf(StructType().add("width", "integer").add("height", "integer"))
def dimensions(contents: pd.Series) -> pd.DataFrame:
    sizes = [image_size(c) or (None, None) for c in contents]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


def pixels(data: bytes | None) -> np.ndarray | None:
    """RGB pixels (height, width, 3) of an uncompressed 24- or 32-bit BMP or a binary PPM; null for other or damaged files.

    Samples of a PPM with another maximum than 255 are brought to it; those above 255 have two bytes.
    """
    if not data:
        return None
    try:
        if data[:2] == b"BM":
            start = struct.unpack_from("<I", data, 10)[0]
            width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
            if bits not in (24, 32) or packed not in (0, 3) or width <= 0 or height == 0:
                return None
            row = (width * bits // 8 + 3) // 4 * 4
            rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
            rgb = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
            return rgb if height < 0 else rgb[::-1]
        found = _PPM.match(data)
        if found:
            width, height, most = map(int, found.groups())
            if not (width and height and 0 < most < 65536):
                return None
            kind = np.dtype(np.uint8 if most < 256 else ">u2")
            samples = np.frombuffer(data, kind, width * height * 3, found.end()).reshape(height, width, 3)
            return samples if most == 255 else np.rint(np.minimum(samples, most) * (255 / most)).astype(np.uint8)
    except (struct.error, ValueError):
        pass
    return None


def sampled(rgb: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """n x n gray samples at the centres of a grid, and the mean colour."""
    height, width = rgb.shape[:2]
    ys = ((np.arange(n) + 0.5) * height / n).astype(int)
    xs = ((np.arange(n) + 0.5) * width / n).astype(int)
    cells = rgb[np.ix_(ys, xs)].astype(np.float64)
    gray = np.rint(cells @ np.array([0.299, 0.587, 0.114])).astype(int)
    return gray.ravel().tolist(), rgb.reshape(-1, 3).mean(axis=0).tolist()


def square_views(width: int, height: int, density: int) -> list[tuple[str, int, int, int, int]]:
    """(name, x, y, width, height): the full view and up to ``density`` squares along the longer side."""
    side, room = min(width, height), max(width, height) - min(width, height)
    views = [("full", 0, 0, width, height)]
    if room:
        steps = sorted({round(i * room / max(density - 1, 1)) for i in range(density)})
        views += [(f"square_{i}", s if width > height else 0, 0 if width > height else s, side, side) for i, s in enumerate(steps)]
    return views


_VIEW = "array<struct<name:string,gray:array<int>,mean_rgb:array<double>>>"


def descriptors(content: Column, density: int = 9, grid: int = 8) -> Column:
    """Views of an image, each with gray samples and mean colour; null where the pixels cannot be read."""

    def view_rows(data: bytes | None):
        rgb = pixels(data)
        if rgb is None:
            return None
        out = []
        for name, x, y, w, h in square_views(rgb.shape[1], rgb.shape[0], density):
            gray, mean = sampled(rgb[y : y + h, x : x + w], grid)
            out.append({"name": name, "gray": gray, "mean_rgb": mean})
        return out

    @F.pandas_udf(_VIEW)
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(view_rows)

    return run(content)


#: Shares of full intensity above which a source is visible, and up to which a conversion is black.
VISIBLE, BLACK = 0.02, 0.001


def intensity(rgb: np.ndarray) -> tuple[float, float]:
    """Mean and maximum of the channels, as shares of full intensity."""
    return float(rgb.mean() / 255), float(rgb.max() / 255)


def black_conversion(source: Column, output: Column) -> Column:
    """Whether an image came out black of a source that is not; false where either cannot be read."""

    def lost(before: bytes | None, after: bytes | None) -> bool:
        first, second = pixels(before), pixels(after)
        if first is None or second is None:
            return False
        return max(intensity(first)) > VISIBLE and max(intensity(second)) <= BLACK

    @F.pandas_udf("boolean")
    def run(sources: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([lost(a, b) for a, b in zip(sources, outputs, strict=True)])

    return run(source, output)


def sidecar_values(data: str | None, names: tuple[str, ...]) -> list[str]:
    """Texts of list items and attributes with the given local names in an XMP sidecar, in order, once each."""
    if not data:
        return []
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    found: dict[str, None] = {}
    for node in root.iter():
        if node.tag.rpartition("}")[2] in names:
            texts = [x.text for x in node.iter() if x is not node and x.text and x.text.strip()] or [node.text or ""]
            found.update((t.strip(), None) for t in texts if t.strip())
        for key, value in node.attrib.items():
            if key.rpartition("}")[2] in names and value.strip():
                found[value.strip()] = None
    return list(found)


def sidecar_column(content: Column, *names: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sidecar_values(v, names))

    return run(content)



def html_cards(content: Column, card: str, fields: dict[str, str]) -> Column:
    """Cards of a page as an array of maps: the text below nodes with a class set, by field."""
    from html.parser import HTMLParser

    class Cards(HTMLParser):
        VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack: list[tuple[str, list[str]]] = []  # open nodes: tag, and the fields that they are
            self.cards: list[dict[str, list[str]]] = []
            self.depth: list[int] = []
            # Places in the stack by tag and by field: a page may leave any number of nodes open.
            self.tags: dict[str, list[int]] = {}
            self.fields: dict[str, list[int]] = {name: [] for name in fields}

        def handle_starttag(self, tag, attrs):
            classes = set((dict(attrs).get("class") or "").split())
            if tag in self.VOID:
                return
            own = [name for name, wanted in fields.items() if set(wanted.split()) <= classes]
            for places in (self.tags.setdefault(tag, []), *(self.fields[name] for name in own)):
                places.append(len(self.stack))
            self.stack.append((tag, own))
            if set(card.split()) <= classes:
                self.cards.append({})
                self.depth.append(len(self.stack))

        def handle_endtag(self, tag):
            """Close the nearest open node of that tag and all inside it; an end without a start closes nothing."""
            if self.tags.get(tag):
                for _ in range(len(self.stack) - self.tags[tag][-1]):
                    name, own = self.stack.pop()
                    for places in (self.tags[name], *(self.fields[n] for n in own)):
                        places.pop()
                while self.depth and self.depth[-1] > len(self.stack):
                    self.depth.pop()

        def handle_data(self, data):
            if self.depth and data.strip():
                for name, places in self.fields.items():
                    if places and places[-1] >= self.depth[-1] - 1:
                        self.cards[-1].setdefault(name, []).append(data.strip())

    @F.pandas_udf("array<map<string,string>>")
    def run(values: pd.Series) -> pd.Series:
        def cards(value):
            parser = Cards()
            parser.feed(value or "")
            return [{name: " ".join(texts) for name, texts in c.items()} for c in parser.cards]

        return values.map(cards)

    return run(content)


@F.pandas_udf(StructType().add("width", "integer").add("height", "integer").add("gray", ArrayType(IntegerType())))
def gray_pictures(contents: pd.Series) -> pd.DataFrame:
    """Width, height and gray values, row by row; nulls where the pixels cannot be read."""

    def one(data: bytes | None) -> tuple:
        rgb = pixels(data)
        if rgb is None:
            return None, None, None
        return rgb.shape[1], rgb.shape[0], np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.int32).ravel()

    table = pd.DataFrame([one(c) for c in contents], columns=["width", "height", "gray"], dtype=object)
    return table.astype({"width": "Int32", "height": "Int32"})


def crop_candidates(subject_x: Column, subject_y: Column, width: Column, height: Column, steps: int = 3) -> Column:
    """Square crops (x, y, size) of several sizes around a subject and the middle, moved inside the image."""
    short = F.least(width, height)

    def square(centre_x: Column, centre_y: Column, k: Column) -> Column:
        size = F.floor(short * (1 - (k - 1) * 0.25)).cast("int")
        inside = lambda centre, room: F.greatest(F.lit(0), F.least(F.floor(centre - size / 2).cast("int"), (room - size).cast("int")))
        return F.struct(inside(centre_x, width).alias("x"), inside(centre_y, height).alias("y"), size.alias("size"))

    sizes = F.sequence(F.lit(1), F.lit(steps))
    around = F.transform(sizes, lambda k: square(subject_x, subject_y, k))
    middle = F.transform(sizes, lambda k: square(width / 2, height / 2, k))
    return F.array_distinct(F.concat(around, middle))


def crop_penalty(crop: Column, subject_x: Column, subject_y: Column, width: Column, height: Column) -> Column:
    """What speaks against a crop: area given up, and distance of the subject from its middle, as shares."""
    lost = 1 - crop["size"] * crop["size"] / (F.least(width, height) * F.least(width, height))
    away = (F.abs(crop["x"] + crop["size"] / 2 - subject_x) + F.abs(crop["y"] + crop["size"] / 2 - subject_y)) / crop["size"]
    return lost * 0.5 + away
