"""Text helpers: slugs, sensor names, file names and lenient number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripweave import fixed_values as fv
from tripweave.functions.numbers import col

_BLANKS = " \t\r\n\f\x0b"
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def stripped(c) -> Column:
    return F.btrim(col(c), F.lit(_BLANKS))


def slugify(name) -> Column:
    s = F.lower(stripped(name))
    for a, b in (("°", "deg"), ("²", "2"), ("µ", "u")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.btrim(F.regexp_replace(s, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.lit("pid")).otherwise(s)


def short_name(name) -> Column:
    """Sensor name without the control-unit prefix, at most 32 characters."""
    s = col(name)
    for prefix in fv.SHORT_NAME_PREFIXES:
        s = F.replace(s, F.lit(prefix), F.lit(""))
    return F.substring(stripped(s), 1, 32)


def sensor_group(name) -> Column:
    """First group (in fixed order) one of whose words occurs in the name."""
    n = F.lower(col(name))
    out = None
    for group, words in fv.SENSOR_GROUPS:
        hit = n.rlike("|".join(words))
        out = F.when(hit, F.lit(group)) if out is None else out.when(hit, F.lit(group))
    return out.otherwise(F.lit(fv.OTHER_GROUP))


def noise(name) -> Column:
    return col(name).rlike(fv.NOISE_PATTERN)


def number_text(s) -> Column:
    """A double from text, null when it is not one."""
    s = stripped(s)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def parse_seconds(s) -> Column:
    """Seconds from ``12.5``, ``H:M:S[.f]`` or ``M:S``; a comma is a decimal mark
    only in the colon forms."""
    plain = number_text(s)
    parts = F.split(F.replace(stripped(s), F.lit(","), F.lit(".")), ":")

    def whole(i):
        p = F.get(parts, F.lit(i))
        return F.when(p.rlike(_INTEGER), stripped(p).try_cast("double"))

    hms = whole(0) * 3600 + whole(1) * 60 + number_text(F.get(parts, F.lit(2)))
    ms = whole(0) * 60 + number_text(F.get(parts, F.lit(1)))
    return F.coalesce(plain, F.when(F.size(parts) == 3, hms).when(F.size(parts) == 2, ms))


def stem(file_name) -> Column:
    """File name without directory and extension."""
    base = F.element_at(F.split(col(file_name), "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def trip_id_of_file(file_name) -> Column:
    return F.concat(F.lit(fv.SENSOR_ID_PREFIX), F.replace(stem(file_name), F.lit(" "), F.lit("_")))


def local_start_of_file(file_name) -> Column:
    """Local start (zone-free timestamp) from ``YYYY-MM-DD[_ ]HH-MM-SS``, else null."""
    m = r"^(\d{4}-\d{2}-\d{2})[_ ](\d{2})-(\d{2})-(\d{2})$"
    s = stem(file_name)
    iso = F.regexp_replace(s, m, "$1 $2:$3:$4")
    return F.when(s.rlike(m), iso.try_cast("timestamp_ntz"))


def start_of_trip_id(trip_id) -> Column:
    """Start encoded in a sensor trip id, else null."""
    m = r"^(?:.*/)?obd-(\d{4}-\d{2}-\d{2})[_ ](\d{2})-(\d{2})-(\d{2})$"
    c = col(trip_id)
    return F.when(c.rlike(m), F.regexp_replace(c, m, "$1 $2:$3:$4").try_cast("timestamp_ntz"))


def strip_zone(date_text) -> Column:
    """Drop the false zone mark of the cloud export."""
    return F.rtrim(col(date_text), F.lit("Z"))


def vin_suffix(vin) -> Column:
    return F.right(col(vin), F.lit(6))
