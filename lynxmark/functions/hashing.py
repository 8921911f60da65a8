"""Digests, keys and identifiers."""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lynxmark.functions.text import blank_to_null, has_text, java_trim

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def sha256_hex(c: Column, null_as: str = "empty") -> Column:
    """Lower-case hex. A null is '' (``null_as="empty"``) or the digest of '' (``"digest"``)."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.sha2(c, 256)) if null_as == "empty" else F.sha2(F.coalesce(c, F.lit("")), 256)


@F.pandas_udf(LongType())
def fnv64(texts: pd.Series) -> pd.Series:
    """FNV-1a over UTF-8, as a signed bigint; null is 0. xxhash64 gives other values."""

    def one(text: str | None) -> int:
        if text is None:
            return 0
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([one(t) for t in texts], dtype="int64")


def reviewer_ref(reviewer: Column, url: Column) -> Column:
    """The trimmed address, else the trimmed name in lower case, else null."""
    return F.coalesce(blank_to_null(url), F.lower(blank_to_null(reviewer)))


def fingerprint(title: Column, body: Column, ref: Column, day: Column) -> Column:
    """SHA-256 of the title and, each behind a bar, of body, reviewer and epoch day; blanks are left out, none left is an error."""
    keep = lambda c: F.when(has_text(c), c)
    bar = lambda c: F.coalesce(F.concat(F.lit("|"), c), F.lit(""))
    key = F.concat(F.coalesce(keep(title), F.lit("")), bar(keep(body)), bar(keep(ref)), bar(F.unix_date(day).cast("string")))
    return F.when(key == "", F.raise_error(F.lit("fingerprint requires text or reviewer information")).cast("string")).otherwise(F.sha2(key, 256))


def name_uuid(c: Column) -> Column:
    """Version 3 UUID of the name's bytes: MD5 with version and variant set."""
    h = F.md5(c)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# The first bytes of the formats that are taken, in hex, and the least length of a file.
IMAGE_HEADS = {"png": "89504E47", "jpeg": "FFD8", "gif": "474946", "bmp": "424D"}
LEAST_IMAGE = 8


def image_kind(data: Column) -> Column:
    """The format that a file's first bytes tell; null for others, for files of under eight bytes and for none."""
    head = F.hex(F.substring(data, 1, 4))
    kind = F.coalesce(*[F.when(head.startswith(h), k) for k, h in IMAGE_HEADS.items()])
    return F.when(F.octet_length(data) >= LEAST_IMAGE, kind)


def valid_image(data: Column, most_bytes: int = 0) -> Column:
    """Whether a file may be taken: of a known format and, if ``most_bytes`` is above 0, no longer than that. Pictures are not decoded."""
    fits = F.octet_length(data) <= most_bytes if most_bytes > 0 else F.lit(True)
    return F.coalesce(fits & image_kind(data).isNotNull(), F.lit(False))


def _base32(n: int, length: int) -> str:
    return "".join(CROCKFORD[(n >> (5 * i)) & 31] for i in reversed(range(length)))


@F.pandas_udf(StringType())
def _ulids(ids: pd.Series) -> pd.Series:
    return pd.Series([_base32(time.time_ns() // 1_000_000, 10) + _base32(int.from_bytes(os.urandom(10), "big"), 16) for _ in ids])


def new_ulid() -> Column:
    """A new 26-character identifier for each row: 48 bits of time, 80 of chance."""
    return _ulids.asNondeterministic()(F.monotonically_increasing_id())


def ulid_millis(c: Column) -> Column:
    """The time in an identifier, in milliseconds; null unless it is 26 characters of its alphabet."""
    value = F.aggregate(F.split(F.left(F.upper(c), F.lit(10)), ""), F.lit(0).cast("bigint"), lambda a, x: a * 32 + F.instr(F.lit(CROCKFORD), x) - 1)
    return F.when(F.upper(c).rlike(f"^[0-7][{CROCKFORD}]{{25}}$"), value)


def strip_or_empty(c: Column) -> Column:
    return java_trim(F.coalesce(c, F.lit("")))
