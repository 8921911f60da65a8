"""Dates and instants out of text. What cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynxmark.functions.text import java_trim

JP_DATE = r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日"
ENGLISH = ("MMMM d, y", "d MMMM y", "MMM d, y", "d MMM y")


def jp_timestamp(c: Column) -> Column:
    """Midnight of the first Japanese date in the text, without a zone."""
    y, m, d = (F.nullif(F.regexp_extract(c, JP_DATE, i), F.lit("")).try_cast("int") for i in (1, 2, 3))
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero, zero, zero)


def normalize_date(c: Column) -> Column:
    """A Japanese date; else what follows the last " on ", in English or ISO form."""
    text = java_trim(c)
    tail = F.when(F.lower(text).contains(" on "), F.regexp_extract(text, r"(?is)^.* on (.*)$", 1)).otherwise(text)
    tail = java_trim(tail)
    # A pattern is tried only on text of its shape: parsers differ in how lenient they are.
    shapes = (r"^[A-Za-z]+ \d{1,2}, \d{4}$", r"^\d{1,2} [A-Za-z]+ \d{4}$")
    tried = [F.when(tail.rlike(shapes[i % 2]), F.try_to_timestamp(tail, F.lit(p))).cast("date") for i, p in enumerate(ENGLISH)]
    iso = F.when(tail.rlike(r"^\d{4}-\d{2}-\d{2}$"), tail.try_cast("date"))
    return F.coalesce(jp_timestamp(text).cast("date"), *tried, iso)


def parse_posted_at(c: Column, zone: str = "Asia/Tokyo") -> Column:
    """Midnight in ``zone`` of the Japanese date, as UTC wall time."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), jp_timestamp(c))


def parse_collected_at(c: Column) -> Column:
    """ISO date, time and offset, as UTC wall time; microseconds, further digits cut."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"
    cut = F.regexp_replace(c, r"(\.\d{6})\d+", "$1")
    wall = F.regexp_replace(cut, r"(Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")
    zone = F.replace(F.regexp_extract(c, r"(Z|[+-]\d{2}:\d{2})$", 1), F.lit("Z"), F.lit("+00:00"))
    minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    shifted = wall - F.make_dt_interval(mins=minutes)
    return F.when(c.rlike(shape), shifted)
