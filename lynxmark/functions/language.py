"""A rough language guess: Japanese, English or unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
SEEN = r"[^\s\x00-\x1f\x7f-\x9f\p{Zs}\p{Zl}\p{Zp}]|[\x{A0}\x{2007}\x{202F}]"


def is_japanese(c: Column) -> Column:
    """Kana and ideographs are 30 % or more of what is neither space nor control."""
    seen = F.regexp_count(c, F.lit(SEEN))
    return F.coalesce((seen > 0) & (F.regexp_count(c, F.lit(JAPANESE)) / F.greatest(seen, F.lit(1)) >= 0.3), F.lit(False))


def detect(c: Column) -> Column:
    """"ja"; "en" if over 70 % of the letters are ASCII; else "unknown"."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    english = (letters > 0) & (F.regexp_count(c, F.lit("[A-Za-z]")) / F.greatest(letters, F.lit(1)) > 0.7)
    return F.when(is_japanese(c), "ja").when(english, "en").otherwise("unknown")
