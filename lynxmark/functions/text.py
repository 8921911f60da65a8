"""Text normalization and the text predicates that reviews are judged by."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that decide results.
URL_PATTERN = r"(?i)https?://|www\.|\.co(m|\.jp)|\.jp"
SYMBOL_RUN = r"([!！?？.,。、〜～ー\-])\1{2,}"
EMOJI_SITE = r"[\p{So}\x{1F000}-\x{10FFFF}]"
EMOJI_EVAL = r"[\x{2600}-\x{27BF}\x{1F000}-\x{10FFFF}]"
NEGATIVE_WORDS = ("ダメ", "良くない", "bad", "not", "嫌")
BLOCKED_MARKS = ("captcha", "robot check", "enter the characters", "signin")
LOGIN_MARKS = ("ap_login_form", "ap_email_login", "validatecaptcha", "robot check")


def java_trim(c: Column) -> Column:
    """Strips every character up to U+0020 at both ends; the built-in trim strips spaces alone."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def unicode_strip(c: Column) -> Column:
    """Strips Unicode white space at both ends."""
    space = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(F.regexp_replace(c, f"^{space}", ""), f"{space}$", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(java_trim(c), F.lit(""))


def has_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def first_non_blank(*candidates: Column) -> Column:
    """The first candidate with text, trimmed."""
    return F.coalesce(*map(blank_to_null, candidates))


def safe_truncate(c: Column, most: int) -> Column:
    """Trimmed and cut to ``most`` characters, the last three of them dots where there is room."""
    t = java_trim(c)
    cut = F.left(t, F.lit(most)) if most <= 3 else F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))
    return F.when(F.length(t) > most, cut).otherwise(t)


def normalize_body(c: Column) -> Column:
    """White space removed, lower case; null becomes empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def normalize_author(c: Column) -> Column:
    return F.lower(java_trim(F.coalesce(c, F.lit(""))))


def has_url(c: Column) -> Column:
    return c.rlike(URL_PATTERN)


def has_symbol_run(c: Column) -> Column:
    """One of the marks three times running."""
    return c.rlike(SYMBOL_RUN)


def has_emoji(c: Column, variant: str = "site") -> Column:
    return c.rlike({"site": EMOJI_SITE, "eval": EMOJI_EVAL}[variant])


def has_negative_word(c: Column) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for word in NEGATIVE_WORDS:
        found = found | low.contains(word)
    return found


def is_captcha(html: Column) -> Column:
    """A missing page counts as blocked."""
    return F.coalesce(html.rlike("(?i)captcha"), F.lit(True))


def is_blocked_page(html: Column) -> Column:
    low = F.lower(html)
    found = low.isNull()
    for mark in BLOCKED_MARKS:
        found = found | low.contains(mark)
    return F.coalesce(found, F.lit(True))


def needs_login(html: Column) -> Column:
    """The page asks to sign in or to prove oneself human; a missing page does too."""
    low = F.lower(html)
    found = low.contains("signin") & low.contains("ap_password")
    for mark in LOGIN_MARKS:
        found = found | low.contains(mark)
    return F.coalesce(found, F.lit(True))


def _normalize(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return _squeeze(bare.lower())


_CONTROLS = "".join(map(chr, range(0x21)))
_ASCII_SPACE = {ord(c): " " for c in "\t\n\v\f\r"}


def _squeeze(text: str) -> str:
    out = text.translate(_ASCII_SPACE)
    while "  " in out:
        out = out.replace("  ", " ")
    return out.strip(_CONTROLS)


#: No built-in function decomposes or composes. Texts go to Python a hundred at a time, as Arrow batches count rows and not bytes.
_by_row = F.udf(returnType=StringType(), useArrow=False)


@_by_row
def normalize(text: str | None) -> str | None:
    """Compatibility decomposition, marks dropped (which also takes the voicing marks off kana), lower case, ASCII white
    space squeezed."""
    return None if text is None else _normalize(text)


def _normalize_scraped(text: str) -> str | None:
    out = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    out = re.sub("[​-‏﻿]", "", out)
    out = re.sub("[ \t\x0b\f]+", " ", out)
    out = re.sub(r"[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", "\n", out).strip(_CONTROLS)
    return out if out.strip() else None


@_by_row
def normalize_scraped(text: str | None) -> str | None:
    """Compatibility composition, line ends and runs of blanks made one, zero-width characters removed; blank becomes null."""
    return None if text is None else _normalize_scraped(text)


def validate(c: Column, most: int, required: bool = False) -> Column:
    """normalize_scraped(), cut to ``most`` characters (0: no limit); a missing required text is an error."""
    text = normalize_scraped(c)
    if most > 0:
        text = F.when(F.length(text) > most, java_trim(F.left(text, F.lit(most)))).otherwise(text)
    return F.when(text.isNull(), F.raise_error(F.lit("required text missing")).cast("string")).otherwise(text) if required else text


@_by_row
def compose(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def normalize_digits(c: Column) -> Column:
    """Full-width forms as ASCII, trimmed."""
    return java_trim(compose(c))


def ascii_digits(c: Column) -> Column:
    """The built-in subset of normalize_digits() that numbers need: full-width digits and marks."""
    return java_trim(F.translate(c, "０１２３４５６７８９％，．", "0123456789%,."))
