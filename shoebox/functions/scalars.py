"""Scalar functions of the catalog as Columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by media type, edges of the thumbnail tiers, distance presets for duplicates.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif", "heic", "heif", "avif", "raw", "cr2", "nef", "arw", "dng")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv", "flv")
TIER_EDGES = (("js", 128), ("j", 512), ("jm", 1280), ("jh", 2560))
DISTANCE_PRESETS = (0, 3, 8, 12)
EARTH_KM = 6371.0
MIB = 1 << 20


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def media_type(path: Column) -> Column:
    """image, gif or video by extension, in any case; null for other files."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext == "gif", "gif").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def set_position(entry: Column) -> Column:
    """The position of a set entry name::N: digits behind the last '::' that fit 32 bits, with a name before them."""
    digits = F.regexp_extract(entry, r"(?s)^.+::([0-9]+)$", 1)
    value = digits.try_cast("decimal(38,0)")
    return F.when((digits != "") & (value <= 4294967295), value.cast("bigint"))


def set_name(entry: Column) -> Column:
    return F.when(set_position(entry).isNotNull(), F.regexp_extract(entry, r"(?s)^(.+)::[0-9]+$", 1)).otherwise(entry)


def set_entry(name: Column, position: Column) -> Column:
    return F.when(position.isNull(), name).otherwise(F.concat(name, F.lit("::"), position.cast("string")))


def valid_set_name(name: Column) -> Column:
    return set_position(name).isNull()


def fuzzy_score(haystack: Column, needle: str) -> Column:
    """How well a lower-cased tag matches lower-cased text: exact, prefix, substring, subsequence; null for no match.

    Lengths and places count bytes, as in the suggestions' original ranking.
    """
    needle = needle.lower()
    if not needle:
        return F.lit(0).cast("bigint")
    place = F.octet_length(F.substring(haystack, F.lit(1), F.locate(needle, haystack) - 1))
    parts = ".*".join("\\Q" + c + "\\E" for c in needle)
    return (
        F.when(haystack == needle, 1000)
        .when(haystack.startswith(needle), 600 - F.least(F.octet_length(haystack), F.lit(100)))
        .when(haystack.contains(needle), 200 - F.least(place, F.lit(200)))
        .when(haystack.rlike(f"(?s){parts}"), 50)
        .cast("bigint")
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(rgba: Column, width: Column, height: Column) -> Column:
    """64 bits: in a 9 x 8 grid of nearest samples, whether the luma grows to the right; null for a buffer that is too short.

    rgba is an array of the pixels' bytes, row by row; what follows them is ignored.
    """
    cell = lambda r, c: ((F.floor(r * height / 8) * width + F.floor(c * width / 9)) * 4).cast("int")
    luma = lambda at: F.shiftright(F.get(rgba, at) * 77 + F.get(rgba, at + 1) * 150 + F.get(rgba, at + 2) * 29, 8)
    at = F.sequence(F.lit(0), F.lit(63))
    bit = lambda k: F.when(luma(cell(F.floor(k / 8), k % 8)) < luma(cell(F.floor(k / 8), k % 8 + 1)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    # most significant bit first
    found = F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, k: F.shiftleft(acc, 1).bitwiseOR(bit(k)))
    return F.when((width > 0) & (height > 0) & (F.size(rgba) >= width * height * 4), found)


def exif_seconds(text: Column) -> Column:
    """'2024:03:05 10:20:30', with blanks and NULs around it, as seconds of that wall clock; null if invalid."""
    clean = F.trim(F.translate(text, "\x00", ""))
    parts = [F.regexp_extract(clean, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})$", k).try_cast("int") for k in range(1, 7)]
    day = F.try_to_date(F.regexp_replace(F.substring(clean, 1, 10), ":", "-"), "yyyy-MM-dd")
    ok = day.isNotNull() & (parts[3] < 24) & (parts[4] < 60) & (parts[5] < 60)
    return F.when(ok, F.unix_date(day).cast("bigint") * 86400 + parts[3] * 3600 + parts[4] * 60 + parts[5])


def dms(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Degrees, minutes, seconds to decimal degrees, negative for S and W."""
    size = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(F.trim(reference)).isin("S", "W"), -size).otherwise(size)


def plausible(lat: Column, lon: Column) -> Column:
    """Finite, in range and not the zero point, which stands for no fix."""
    finite = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.coalesce(finite & ~((F.abs(lat) < 1e-9) & (F.abs(lon) < 1e-9)), F.lit(False))


def iso6709(text: Column) -> Column:
    """struct(lat, lon) of '+48.8577+002.295+035/'; null if it isn't a place. What follows the solidus names a reference system."""
    number = r"[+-](?:[0-9]+\.?[0-9]*|\.[0-9]+)"
    pattern = rf"^[^+-]*({number})({number})(?:[+-].*)?$"
    body = F.trim(F.substring_index(text, "/", 1))
    lat, lon = (F.regexp_extract(body, pattern, k).try_cast("double") for k in (1, 2))
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def rotation(degrees: Column) -> Column:
    return F.pmod(F.round(degrees), F.lit(360)).cast("int")


def shown_size(width: Column, height: Column, degrees: Column) -> Column:
    """struct(width, height) as shown: a quarter turn swaps them."""
    turned = rotation(degrees).isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def positive_number(text: Column) -> Column:
    """A number, or text that is one, if it is finite and above zero."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when((value > 0) & (value < float("inf")), value)


def capture_clock(with_offset: Column, utc: Column, zone: str) -> Column:
    """Seconds of the wall clock of a capture: the local half of a time with offset, else a UTC time after 1970 began, moved to the zone."""
    local = F.regexp_extract(with_offset, r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)$", 0)
    day = F.try_to_date(F.substring(local, 1, 10), "yyyy-MM-dd")
    first = F.unix_date(day).cast("bigint") * 86400 + F.substring(local, 12, 2).try_cast("int") * 3600 + F.substring(local, 15, 2).try_cast("int") * 60 + F.substring(local, 18, 2).try_cast("int")
    moved = F.from_utc_timestamp(F.to_timestamp_ntz(F.regexp_replace(F.substring(utc, 1, 19), "T", " ")).cast("timestamp"), zone)
    second = F.when(utc.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.unix_date(moved.cast("date")).cast("bigint") * 86400 + F.hour(moved) * 3600 + F.minute(moved) * 60 + F.second(moved))
    return F.coalesce(first, F.when(F.unix_seconds(F.to_timestamp_ntz(F.regexp_replace(F.substring(utc, 1, 19), "T", " ")).cast("timestamp")) > 0, second))


def sender_seconds(text: Column, now_ms: Column) -> Column:
    """A sender's milliseconds as seconds; null when not positive or in the future. Text that is no integer fails valid_sender."""
    value = F.trim(text).try_cast("bigint")
    return F.when((value > 0) & (value <= now_ms), F.floor(value / 1000).cast("bigint"))


def valid_sender(text: Column) -> Column:
    return F.trim(text).try_cast("bigint").isNotNull()


def safe_name(raw: Column) -> Column:
    """The last segment by either separator without blanks, then dots, around it, control characters as '_'; null without a known extension."""
    name = F.regexp_extract(raw, r"(?s)([^/\\]*)$", 1)
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"^\.+|\.+$", "")
    name = F.regexp_replace(name, r"[\x00-\x1f\x7f-\x9f]", "_")
    return F.when((name != "") & media_type(name).isNotNull(), name)


def valid_path(path: Column) -> Column:
    """Relative, with no empty, '.', '..' or NUL-bearing segment."""
    return (path != "") & ~path.contains("\x00") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder of a path; null at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", ""))


def chord_km(squared: Column) -> Column:
    """Kilometres of a squared chord on the unit sphere."""
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), squared)) / 2)) * EARTH_KM


def squared_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    x, y, z = F.cos(a) * F.cos(b) - F.cos(c) * F.cos(d), F.cos(a) * F.sin(b) - F.cos(c) * F.sin(d), F.sin(a) - F.sin(c)
    return x * x + y * y + z * z


def place_tags(country: Column, region: Column, city: Column, km: Column) -> Column:
    """Country, region and, within 25 km, city as tags without blanks or repeats; none beyond 100 km."""
    named = F.array(country, region, F.when(km <= 25, city))
    tags = F.transform(F.filter(named, lambda t: t.isNotNull() & (F.trim(t) != "")), lambda t: F.regexp_replace(F.trim(t), r"\s+", "_"))
    return F.when(km <= 100, F.array_distinct(tags)).otherwise(F.array().cast("array<string>"))


def version_at_least(have: Column, want: Column) -> Column:
    """Dotted numbers compared part by part, missing ones as 0; versions that aren't numbers must be equal."""
    numeric = have.rlike(r"^[0-9]+(\.[0-9]+)*$") & want.rlike(r"^[0-9]+(\.[0-9]+)*$")
    parts = F.arrays_zip(F.split(have, r"\.").alias("a"), F.split(want, r"\.").alias("b"))
    number = lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0))
    sign = F.aggregate(parts, F.lit(0), lambda acc, p: F.when(acc != 0, acc).when(number(p["a"]) > number(p["b"]), 1).when(number(p["a"]) < number(p["b"]), -1).otherwise(0))
    return F.when(numeric, sign >= 0).otherwise(have == want)


def sample_times(duration: Column, count: Column) -> Column:
    """count even steps through the middle nine tenths; the midpoint for one or for under a second; none for a bad duration."""
    span = duration * 0.9
    steps = F.transform(F.sequence(F.lit(0), count - 1), lambda k: duration * 0.05 + span * k / (count - 1))
    bad = duration.isNull() | F.isnan(duration) | (duration <= 0) | (duration == float("inf")) | (count < 1)
    return F.when(bad, F.array().cast("array<double>")).when((count == 1) | (duration < 1), F.array(duration / 2)).otherwise(steps)


def fitted(width: Column, height: Column, edge) -> Column:
    """struct(width, height) with the longer edge at most edge, never enlarged."""
    scale = F.least(F.lit(1.0), _lit(edge) / F.greatest(width, height))
    return F.struct(*[F.greatest(F.lit(1), F.round(x * scale)).cast("int").alias(n) for n, x in (("width", width), ("height", height))])


def covering(width: Column, height: Column, edge) -> Column:
    """struct(width, height) with the shorter edge at edge, never enlarged."""
    scale = F.least(F.lit(1.0), _lit(edge) / F.least(width, height))
    return F.struct(*[F.greatest(F.lit(1), F.round(x * scale)).cast("int").alias(n) for n, x in (("width", width), ("height", height))])


def tier_for(edge: Column) -> Column:
    """The smallest tier whose edge is at least as long; null beyond the largest."""
    found = F.lit(None).cast("string")
    for name, size in reversed(TIER_EDGES):
        found = F.when(edge <= size, name).otherwise(found)
    return found


def tier_budget(free: Column) -> Column:
    """A tenth of the free bytes, at least the smaller of 512 MiB and a quarter of them, at most 8 GiB."""
    least = F.least(F.lit(512 * MIB), F.floor(free / 4))
    return F.least(F.greatest(F.floor(free / 10), least), F.lit(8192 * MIB)).cast("bigint")


def rfc3339_seconds(text: Column) -> Column:
    """Seconds since 1970 of a time with its offset, which makes the session's time zone irrelevant; null if invalid."""
    pattern = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(pattern), F.unix_seconds(F.upper(text).try_cast("timestamp")))


def seconds_rfc3339(seconds: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("+00:00"))


def trash_ms(entry: Column) -> Column:
    """The deletion's milliseconds of a trash entry '<ms>_<seq>'; null for other names."""
    return F.when(entry.rlike(r"^[0-9_]+$"), F.regexp_extract(entry, r"^([0-9]+)(?:_|$)", 1).try_cast("bigint"))


def row_boost(aspect: Column, boost: float = 1.6, reference: float = 1.5) -> Column:
    """How much taller a row of upright pictures may be."""
    return F.greatest(F.lit(1.0), F.least(F.lit(boost), F.sqrt(F.lit(reference) / aspect)))
