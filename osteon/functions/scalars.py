"""Small scalar expressions that several operators and callers share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_stem(path: Column) -> Column:
    """File name without folders and extensions, lower-cased, with runs of other signs as one underscore."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(\.[A-Za-z0-9]+)+$", "")
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def natural_key(text: Column) -> Column:
    """A sort key in which numbers of any length order by size: each has its count of digits, without leading zeros, before it."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: F.ltrim(p, F.lit("0"))
    sized = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), sized(p)).otherwise(F.lower(p))), "")


def clean_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, r"\s+", " "))


def rotation_angle(r11: Column, r22: Column, r33: Column) -> Column:
    """Angle of a rotation in degrees, from its trace."""
    return F.degrees(F.acos(F.least(F.greatest((r11 + r22 + r33 - 1) / 2, F.lit(-1.0)), F.lit(1.0))))


def entropy(p: Column, eps: float = 1e-10) -> Column:
    return -p * F.log(p + eps)


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def merged(base: Column, changes: Column) -> Column:
    """A map with another's entries over its own."""
    return F.map_zip_with(base, changes, lambda k, a, b: F.coalesce(b, a))
