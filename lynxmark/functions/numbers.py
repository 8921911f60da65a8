"""Numbers read out of text, and the arithmetic of scores. Rounding is half up everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynxmark.functions.text import ascii_digits, java_trim


def half_up(c: Column, places: int = 0) -> Column:
    """floor(x * 10**places + 0.5) / 10**places, as a double."""
    if not places:
        return F.floor(c + 0.5).cast("double")
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null: greatest and least would leave it out."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100; 0 where there is no whole."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def digits(c: Column) -> Column:
    """All digits of the text read as one number; null without digits or beyond a bigint. Prices and counts are read so."""
    only = F.regexp_replace(ascii_digits(c), "[^0-9]", "")
    return F.nullif(only, F.lit("")).try_cast("bigint")


parse_yen = parse_count = digits


def parse_rating(c: Column) -> Column:
    """The number around the first decimal point; without one, all digits and points read as a number."""
    text = F.replace(ascii_digits(c), F.lit(","), F.lit("."))
    first = F.regexp_extract(text, r"^[^.]*?([0-9]*\.[0-9]+)", 1)
    usable = text.rlike(r"^[^.]+\.[^.]") | text.rlike(r"^[^.]+\.\.")
    rest = F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit("")).try_cast("double")
    return F.coalesce(F.when(usable, F.nullif(first, F.lit("")).try_cast("double")), rest)


def parse_percent(c: Column) -> Column:
    text = F.replace(ascii_digits(c), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_replace(text, r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def normalize_stars(c: Column) -> Column:
    """The first number, rounded, 1 to 5; 0 without one."""
    first = F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9])?)", 1), F.lit("")).try_cast("double")
    return F.coalesce(clamp(F.floor(first + 0.5), 1, 5).cast("int"), F.lit(0))


def parse_star_rating(c: Column) -> Column:
    """The last number; 0 without one."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit(".")), F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("double"), F.lit(0.0))


def normalize_helpful(c: Column) -> Column:
    """Votes: "one person ..." is 1, else the first run of up to seven digits, commas apart; else 0."""
    text = java_trim(c)
    first = F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d{1,7})", 1), F.lit("")).try_cast("int")
    return F.when(F.lower(text).startswith("one person"), 1).otherwise(F.coalesce(first, F.lit(0)))


def rating_to_int(c: Column) -> Column:
    """NaN is 0, all else rounds into 1 to 5."""
    return F.when(F.isnan(c), 0).otherwise(clamp(F.floor(c + 0.5), 1, 5).cast("int"))


def to_score(average: Column) -> Column:
    """A 0 to 5 average as 0 to 100, one decimal; null and NaN give null."""
    return F.when(~F.isnan(average), half_up(clamp(average, 0.0, 5.0) / 5.0 * 100.0, 1))


def pack(numbers: Column) -> Column:
    """A text of digits and minus signs alone, two signs a byte: equal where the texts are, and half as long to shuffle."""
    signs = F.translate(numbers, "-", "A")
    return F.unhex(F.concat(signs, F.when(F.length(signs) % 2 == 1, "F").otherwise("")))


def unpack(packed: Column) -> Column:
    """The text of which ``pack`` has made this."""
    return F.translate(F.hex(packed), "AF", "-")
