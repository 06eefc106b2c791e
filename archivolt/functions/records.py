"""Scores, deltas, keys and shapes of records, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of the words in a file name that speak for or against its quality.
QUALITY_POINTS = {
    "improved": 50,
    "enhanced": 45,
    "edited": 40,
    "edit": 30,
    "retouched": 35,
    "corrected": 30,
    "final": 25,
    "best": 25,
    "master": 25,
    "highres": 20,
    "hires": 20,
    "fullres": 20,
    "full": 10,
    "web": -45,
    "small": -35,
    "thumb": -40,
    "thumbnail": -40,
    "preview": -30,
    "lowres": -35,
    "low": -15,
    "resized": -30,
    "compressed": -25,
    "reduced": -25,
    "email": -20,
    "facebook": -20,
    "instagram": -20,
    "screen": -15,
}

# Tags that hold a capture time, in the order in which they are believed, and the name of each group.
CAPTURE_TAGS = (
    (("EXIF:DateTimeOriginal", "ExifIFD:DateTimeOriginal", "IFD0:DateTimeOriginal"), "exif_datetime_original"),
    (("XMP-exif:DateTimeOriginal",), "xmp_datetime_original"),
    (("EXIF:DateTimeDigitized", "ExifIFD:CreateDate", "EXIF:CreateDate"), "exif_datetime_digitized"),
    (("XMP-exif:DateTimeDigitized",), "xmp_datetime_digitized"),
    (("XMP-xmp:CreateDate",), "xmp_create_date"),
    (("Composite:GPSDateTime",), "gps_datetime_utc"),
    (("QuickTime:ContentCreateDate",), "quicktime_content_create_date"),
    (("QuickTime:CreationDate",), "quicktime_creation_date"),
    (("QuickTime:MediaCreateDate",), "quicktime_media_create_date"),
    (("QuickTime:CreateDate",), "quicktime_create_date"),
    (("QuickTime:TrackCreateDate",), "quicktime_track_create_date"),
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names many times: the variable of a lambda is computed once, not at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def name_tokens(filename: Column) -> Column:
    """Distinct words of a stem in lower case, and the stem without anything else as one word."""

    def words(stem: Column) -> Column:
        return F.array_distinct(F.array_append(F.filter(F.split(stem, "[^a-z0-9]+"), lambda w: w != ""), F.regexp_replace(stem, "[^a-z0-9]+", "")))

    return _once(F.lower(F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")), words)


def quality_score(filename: Column) -> Column:
    """Struct of score and evidence: the points of the quality words of a file name, good ones first."""
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("points"), F.lit(f"quality_{'positive' if n > 0 else 'negative'}_{w}").alias("name")) for w, n in QUALITY_POINTS.items()])

    def scored(held: Column) -> Column:
        score = F.aggregate(held, F.lit(0), lambda s, w: s + w["points"])
        return F.struct(score.alias("score"), F.transform(held, lambda w: w["name"]).alias("evidence"))

    found = _once(name_tokens(filename), lambda tokens: F.filter(words, lambda w: F.array_contains(tokens, w["word"])))
    return _once(F.coalesce(found, F.slice(words, 1, 0)), scored)


def capture_text(value: Column) -> Column:
    """ISO form of a written capture time, with its fraction and offset if it has them; null if it is none."""
    pattern = r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}:\d{2}:\d{2})(\.\d+)?(?:\s*(Z|[+-]\d{2}:?\d{2}))?"

    def written(text: Column) -> Column:
        iso = F.when(text.rlike(pattern + "$"), F.regexp_replace(text, pattern + "(?s:.*)$", "$1-$2-$3T$4$5$6"))
        return _once(iso, lambda t: F.when(F.substring(t, 1, 19).try_cast("timestamp_ntz").isNotNull(), F.regexp_replace(F.regexp_replace(t, "Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")))

    return _once(F.trim(value), written)


def best_capture(tags: Column) -> Column:
    """Struct of timestamp and source: the first usable tag of a map by the order of belief; nulls without any."""
    names = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(source).alias("source")) for group, source in CAPTURE_TAGS for tag in group])

    def usable(held: Column) -> Column:
        given = F.filter(names, lambda n: F.try_element_at(held, n["tag"]).isNotNull())
        read = F.transform(given, lambda n: F.struct(capture_text(F.try_element_at(held, n["tag"])).alias("timestamp"), n["source"].alias("source")))
        return F.try_element_at(F.filter(read, lambda r: r["timestamp"].isNotNull()), F.lit(1))

    return _once(tags, usable)


def clock_and_offset(text: Column) -> Column:
    """Struct of a written ISO time: clock (without zone) and minutes (its offset, null without one)."""
    offset = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    signed = F.regexp_replace(F.regexp_replace(offset, "^Z$", "+0000"), ":", "")
    minutes = F.substring(signed, 2, 2).try_cast("int") * 60 + F.substring(signed, 4, 2).try_cast("int")
    clock = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    return F.struct(clock.alias("clock"), F.when(offset != "", F.when(signed.startswith("-"), -minutes).otherwise(minutes)).alias("minutes"))


def time_delta_seconds(first: Column, second: Column) -> Column:
    """Seconds between two written times: instants if both have an offset, else what their clocks show."""
    a, b = clock_and_offset(first), clock_and_offset(second)
    gap = F.unix_micros(a["clock"].cast("timestamp")) - F.unix_micros(b["clock"].cast("timestamp"))
    shift = F.when(a["minutes"].isNotNull() & b["minutes"].isNotNull(), (a["minutes"] - b["minutes"]).cast("long") * 60_000_000).otherwise(F.lit(0).cast("long"))
    return F.abs(gap - shift) / 1_000_000


def pair_key(kind: Column, left: Column, right: Column) -> Column:
    """SHA-256 of a kind and two paths with zero bytes between them."""
    zero = F.lit("\0")
    return F.sha2(F.concat(kind, zero, left, zero, right).cast("binary"), 256)


def local_clock(instant: Column, zone: Column) -> Column:
    """The clock of a zone at an instant (a timestamp), to seconds."""
    return F.date_trunc("second", F.convert_timezone(F.lit("UTC"), zone, instant.cast("timestamp_ntz"))).cast("timestamp_ntz")


def noon_utc(day: Column, zone: Column) -> Column:
    """The instant of local noon of a day, as text."""
    noon = F.timestamp_add("HOUR", F.lit(12), day.cast("timestamp_ntz"))
    return F.date_format(F.convert_timezone(zone, F.lit("UTC"), noon), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def person_from_tag(path: Column) -> Column:
    """The last part of a tag path below People; null for other paths."""
    parts = F.filter(F.transform(F.split(path, r"[|/\\]"), lambda p: F.trim(p)), lambda p: p != "")
    people = F.lower(F.try_element_at(parts, F.lit(1))).isin("people", "person", "persons")
    return F.when((F.size(parts) >= 2) & people, F.element_at(parts, -1))


def people_name(value: Column) -> Column:
    """A name without a leading person: and without the path of its tag."""
    clean = F.trim(F.regexp_replace(value, r"\s+", " "))
    bare = F.when(F.lower(clean).startswith("person:"), F.trim(F.regexp_replace(clean, "^[^:]*:", ""))).otherwise(clean)
    return F.coalesce(person_from_tag(bare), bare)


#: An entity of a message: its kind, the id of who is meant, and the stretch of the message that names them.
ENTITY = "struct<type:string,id:string,first:int,last:int>"


def companions(message: Column, entities: Column) -> Column:
    """Distinct (identity, name) of the people that a message names after "with" or "and"."""

    def named(e: Column) -> Column:
        before = F.substring(message, F.lit(1), e["first"])
        name = F.trim(F.regexp_replace(F.substring(message, e["first"] + 1, e["last"] - e["first"]), r"\s+", " "))
        name = F.regexp_replace(name, r"^[ @]+|[ @]+$", "")
        inside = (e["first"] >= 0) & (e["first"] < e["last"]) & (e["last"] <= F.length(message))
        fine = e["type"].isin("user", "facebookUser") & inside & before.rlike(r"(?i)(^|\s)(with|and)\s*$") & (e["id"] != "") & (name != "")
        return F.when(fine, F.struct(F.concat(e["type"], F.lit(":"), e["id"]).alias("identity"), name.alias("name")))

    return F.array_distinct(F.array_compact(F.transform(entities, named)))


def memory_datetime(capture: Column, day: Column) -> Column:
    """A day with the clock of the capture time, or midnight where that is none, as yyyy-MM-dd HHmmss; null for no day."""
    clock = F.regexp_extract(F.trim(capture), r"^\d{4}-\d{2}-\d{2}[ T](\d{2}):?(\d{2}):?(\d{2})", 0)
    digits = F.substring(F.regexp_replace(clock, "[^0-9]", ""), 9, 6)
    written = lambda time: F.concat(F.trim(day), F.lit(" "), time)
    valid = lambda text: F.when(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmmss")) >= F.lit("1900-01-01").cast("timestamp"), text)
    return F.coalesce(F.when(digits != "", valid(written(digits))), valid(written(F.lit("000000"))))


def inferred_title(filename: Column) -> Column:
    """What follows the date in the stem of a video's name; empty if there is nothing or only a time."""
    stem = F.trim(F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", ""))
    rest = F.regexp_extract(stem, r"^\d{4}-\d{2}-\d{2}(?:[ _-]+\d{6})?[ _-]+(.+)$", 1)
    bare = F.regexp_replace(rest, r"[ .\t_\-\\]+$", "")
    return F.when(bare.rlike(r"^(\d{6}|\d{1,2}([:._-])\d{2}\2\d{2})$"), "").otherwise(bare)


def flat_address(payload: Column) -> Column:
    """Struct of address, city, state, country and display of a geocoder's JSON: the first given of each, once each."""
    names = ("address", "city", "state", "country")

    def parts(held: Column) -> Column:
        def first(*keys: str) -> Column:
            given = F.transform(F.array(*map(F.lit, keys)), lambda k: F.trim(F.try_element_at(held, k)))
            return F.coalesce(F.try_element_at(F.filter(given, lambda v: v != ""), F.lit(1)), F.lit(""))

        street = F.trim(F.concat_ws(" ", first("house_number"), first("road", "pedestrian", "residential", "street", "footway", "path")))
        city = first("city", "town", "village", "municipality", "borough")
        return F.array(street, city, first("state", "region", "state_district"), first("country"))

    def shown(listed: Column) -> Column:
        lowered = F.transform(listed, F.lower)
        new = _once(lowered, lambda low: F.filter(listed, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1)))
        return F.struct(*[F.element_at(listed, i + 1).alias(n) for i, n in enumerate(names)], F.array_join(new, ", ").alias("display"))

    held = F.from_json(F.get_json_object(payload, "$.address"), "map<string,string>")
    return _once(_once(held, parts), shown)


def same_picture(first: Column, second: Column, size: Column, other_size: Column) -> Column:
    """Whether two gray samples of 32 x 32 are of one picture: equal sizes, small differences, few large ones."""
    gaps = F.zip_with(first, second, lambda a, b: F.abs(a - b))
    total = F.aggregate(gaps, F.lit(0), lambda s, x: s + x.cast("int"))
    large = F.size(F.filter(gaps, lambda x: x > 32))
    return F.coalesce((size == other_size) & (F.size(first) == F.size(second)) & (total <= 4 * F.size(first)) & (large <= 10), F.lit(False))


def original_score(same_content: Column, same_date: Column, crop: Column, fallback: Column) -> Column:
    """Struct of score, confidence and evidence that a candidate is an export's original."""
    same = F.coalesce(same_content, F.lit(False))
    dated = F.coalesce(same_date, F.lit(False))
    high, medium = ~same & (crop == "high"), ~same & (crop == "medium")
    score = F.when(same, 100).otherwise(0) + F.when(dated, 20).otherwise(0) + F.when(high, 40).when(medium, 15).otherwise(0)
    names = F.array(
        F.when(same, "same_sha256"), F.when(dated, "date_hint"), F.when(high, "crop_high"), F.when(medium, "crop_medium"),
        F.when(fallback, "fallback_source"),
    )
    confidence = F.when((score >= 100) & ~fallback, "high").when(score >= 40, "medium").otherwise("low")
    return F.struct(score.alias("score"), confidence.alias("confidence"), F.array_join(F.array_compact(names), ";").alias("evidence"))


def policy_name(kind: Column, long_edge: Column, quality: Column) -> Column:
    """The name of a policy of derivatives."""
    return F.concat(kind, F.lit("_"), long_edge.cast("string"), F.lit("_q"), quality.cast("string"))


def in_range(value: Column, least: float, most: float) -> Column:
    """A number of a written value if it is one and lies in the range, ends included; null for others, such as true."""
    number = value.try_cast("double")
    return F.when(number.between(least, most) & ~F.lower(F.trim(value.cast("string"))).isin("true", "false"), number)


def offset_minutes(value: Column) -> Column:
    """Whole minutes of an offset from UTC of at most 14 hours; null for others."""
    number = in_range(value, -14 * 60, 14 * 60)
    return F.when(number == F.floor(number), number.cast("int"))


def action_of(record_action: Column, import_decision: Column) -> Column:
    """What is to be done with a staged record: its action, else its decision, else it is kept without export."""
    return F.coalesce(F.nullif(record_action, F.lit("")), F.nullif(import_decision, F.lit("")), F.lit("canonical_only"))


def is_selected(action: Column) -> Column:
    return action.isin("import", "selected", "reviewed_import")


def has_nothing(text: Column, media: Column, urls: Column, place: Column) -> Column:
    """Whether a record has neither text nor media, links or a place."""
    given = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return ~(given(text) | some(media) | some(urls) | given(place))


def media_class(extension: Column, head: Column) -> Column:
    """photos or videos by extension, and without one by the first bytes of the file; null for other files."""
    kind = F.lower(extension)
    photo = kind.isin("jpg", "jpeg", "png", "gif", "heic", "webp")
    video = kind.isin("mp4", "mov", "m4v", "avi", "webm")
    ftyp = (F.octet_length(head) >= 8) & (F.substring(head, 5, 4) == F.lit("ftyp").cast("binary"))
    return F.when(photo, "photos").when(video, "videos").when((kind == "") & ftyp, "videos")


def stays_inside(path: Column) -> Column:
    """Whether a relative path with its parent steps resolved stays below the folder it is relative to."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda d, p: F.struct(
            (d["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"),
            F.least(d["least"], d["now"] + F.when(p == "..", -1).otherwise(1)).alias("least"),
        ),
    )
    return ~path.startswith("/") & (depth["least"] >= 0)
