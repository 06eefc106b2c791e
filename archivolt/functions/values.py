"""Dates, places, identities and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed forms of dates and times in file names: with separators, which may differ, and without any.
DATES_IN_NAME = (
    r"(?<!\d)(?:20\d{2}|19\d{2})[-_](?:0[1-9]|1[0-2])[-_](?:0[1-9]|[12]\d|3[01])(?!\d)",
    r"(?<!\d)(?:20\d{2}|19\d{2})(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)",
)
TIMES_IN_NAME = (
    r"(?<!\d)(?:20\d{2}|19\d{2})[-_](?:0[1-9]|1[0-2])[-_](?:[0-2]\d|3[01])[ T_-]+(?:[01]\d|2[0-3])[:._-]?[0-5]\d[:._-]?[0-5]\d(?!\d)",
    r"(?<!\d)(?:20\d{2}|19\d{2})(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])[ T_-]*(?:[01]\d|2[0-3])[0-5]\d[0-5]\d(?!\d)",
)


def _in_name(name: Column, forms: tuple[str, ...], parse) -> Column:
    found = F.concat(*[F.regexp_extract_all(name, F.lit(form), F.lit(0)) for form in forms])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda t: parse(F.regexp_replace(t, r"\D", ""))))))


def filename_dates(name: Column) -> Column:
    """All valid dates in a file name, distinct and in order: 2024-01-31, 2024_01-31, 20240131."""
    return _in_name(name, DATES_IN_NAME, lambda t: F.try_to_date(t, "yyyyMMdd"))


def filename_timestamps(name: Column) -> Column:
    """All valid local times in a file name, distinct and in order: 2024-01-31 12.30.05, 20240131_123005, 20240131123005."""
    return _in_name(name, TIMES_IN_NAME, lambda t: F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def strict_date(text: Column) -> Column:
    """The date of a text that is exactly yyyy-MM-dd, else null."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def scope_bounds(text: Column) -> tuple[Column, Column]:
    """First and last day of a scope written as a day or a month."""
    day, month = strict_date(text), strict_date(F.concat(text, F.lit("-01")))
    return F.coalesce(day, month), F.coalesce(day, F.last_day(month))


def exif_timestamp(text: Column) -> Column:
    """yyyy:MM:dd HH:mm:ss with optional fraction as a local timestamp, else null; the offset is left to its own column."""
    head = F.regexp_extract(text, r"^\s*(\d{4}):(\d{2}):(\d{2})[ T](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 0)
    iso = F.regexp_replace(F.trim(head), r"^(\d{4}):(\d{2}):(\d{2})[ T]", r"$1-$2-$3 ")
    return F.nullif(iso, F.lit("")).try_cast("timestamp_ntz")


def exif_offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of a trailing +hh:mm, -hh:mm or Z; null without one."""
    sign = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})\s*$", 1)
    minutes = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})\s*$", 2).try_cast("int") * 60 + F.regexp_extract(
        text, r"([+-])(\d{2}):?(\d{2})\s*$", 3
    ).try_cast("int")
    return F.when(sign == "+", minutes).when(sign == "-", -minutes).when(text.rlike(r"Z\s*$"), 0)


def signed_degrees(value: Column, reference: Column) -> Column:
    """Degrees of decimal text or degrees, minutes and seconds, negative for S and W, to eight places."""
    part = [F.regexp_extract(value, r"^\s*(-?\d+(?:\.\d+)?)(?:[^\d.-]+(\d+(?:\.\d+)?))?(?:[^\d.]+(\d+(?:\.\d+)?))?", i).try_cast("double") for i in (1, 2, 3)]
    size = F.abs(part[0]) + F.coalesce(part[1], F.lit(0.0)) / 60 + F.coalesce(part[2], F.lit(0.0)) / 3600
    south = F.upper(F.coalesce(reference, F.lit(""))).startswith("S") | F.upper(F.coalesce(reference, F.lit(""))).startswith("W")
    inline = value.rlike(r"[SWsw]\s*$")
    return F.bround(F.when(south | inline | (part[0] < 0), -size).otherwise(size), 8)


def first_positive(*values: Column) -> Column:
    """The first number above zero."""
    return F.coalesce(*[F.when(v.try_cast("double") > 0, v.try_cast("double")) for v in values])


def same_dimensions(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Equal width and height in either orientation."""
    return F.array_sort(F.array(w1, h1)) == F.array_sort(F.array(w2, h2))


def least_day_distance(dates: Column, target: Column, unknown: Column | None = None) -> Column:
    """Days from a date to the nearest of an array; ``unknown`` (null by default) where there is none."""
    nearest = F.array_min(F.transform(dates, lambda d: F.abs(F.datediff(d, target))))
    return nearest if unknown is None else F.coalesce(nearest, unknown)


def post_timestamp(text: Column) -> Column:
    """Timestamp of "Mon Jan 01 10:00:00 +0000 2024"; the weekday is skipped, which Spark's parser refuses."""
    return F.try_to_timestamp(F.substring(text, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))


def local_date(instant: Column, offset_minutes: Column) -> Column:
    """The date on a clock that is so many minutes ahead of UTC."""
    return F.to_date(F.timestamp_add("MINUTE", offset_minutes.cast("int"), instant))


def fixed_zone(offset_minutes: Column) -> Column:
    """The Etc zone of whole hours, whose sign is reversed, and the one zone of half an hour that is known; else null."""
    hours = (offset_minutes / 60).cast("int")
    sign = F.when(offset_minutes > 0, "-").otherwise("+")
    whole = F.concat(F.lit("Etc/GMT"), sign, F.abs(hours).cast("string"))
    return F.when(offset_minutes == 0, "Etc/UTC").when(offset_minutes % 60 == 0, whole).when(offset_minutes == 330, "Asia/Kolkata")


def ticks_date(ticks: Column) -> Column:
    """The date of ticks of 100 ns since 0001-01-01."""
    return F.date_add(F.lit("0001-01-01").cast("date"), F.floor(ticks / F.lit(864_000_000_000)).cast("int"))


def corrected_clock(camera: Column, baseline_camera: Column, baseline_actual: Column) -> Column:
    """A camera time moved by the offset of a baseline pair."""
    seconds = F.unix_micros(baseline_actual.cast("timestamp")) - F.unix_micros(baseline_camera.cast("timestamp"))
    return F.timestamp_add("MICROSECOND", seconds.cast("long"), camera)


def name_uuid(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


# Media types by extension.
MEDIA_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "heic": "image/heic",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "m4v": "video/x-m4v",
    "avi": "video/x-msvideo",
}


def media_type(filename: Column) -> Column:
    """Media type by extension; application/octet-stream for others."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    extension = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(table, extension), F.lit("application/octet-stream"))


def sample_times(duration: Column, n: int) -> Column:
    """n times at even steps inside a duration, to milliseconds, half to even."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.bround(duration * i / (n + 1), 3))


def selected(document: Column, selector: str) -> Column:
    """A selector $, $.a.b, $.a[0], $[*].x of a JSON text; [*] gives a JSON array."""
    return F.get_json_object(document, selector)


def crop_square(box: Column) -> Column:
    """A crop (x, y, size, rotation) of a JSON text, if size is positive and rotation in (-180, 180]; else null."""
    crop = F.from_json(box, "x double, y double, size double, rotation double")
    rotation = F.coalesce(crop["rotation"], F.lit(0.0))
    fine = (crop["size"] > 0) & (crop["x"] >= 0) & (crop["y"] >= 0) & (rotation > -180) & (rotation <= 180)
    return F.when(fine, crop)
