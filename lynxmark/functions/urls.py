"""Product and review addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynxmark.functions.text import java_trim

SITE = "https://www.amazon.co.jp"
# Where each variant finds a product number, first match first.
ASIN_PATTERNS = {
    "reviews": (r"/dp/([A-Z0-9]{10})(?:/|\?|$)", r"/product-reviews/([A-Z0-9]{10})(?:/|\?|$)", r"[?&]asin=([A-Z0-9]{10})(?:&|$)"),
    "writer": (r"/(?:dp|gp/product)/([A-Z0-9]{10})(?:/|\?|$)",),
    "browser": (r"(?i)/dp/(B0[0-9A-Z]{8})",),
    "loose": (r"/(?:dp|gp/product|product-reviews)/([A-Z0-9]{8,14})",),
    "client": (r"/dp/([A-Z0-9]{10})", r"/product-reviews/([A-Z0-9]{10})", r"\b([A-Z0-9]{10})\b"),
}
INPUT_PATH = r"/(?:dp|gp/product|o/ASIN|product-reviews)/([A-Za-z0-9]{10})(?:[/?#]|$)"
ADMIN_URL = r"^https://www\.amazon\.co\.jp/(?:dp|gp/product)/[A-Z0-9]{10}(?:/)?(?:\?.*)?$"
ADMIN_ASIN = r"^[A-Z0-9]{10}$"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def extract_asin(c: Column, mode: str = "reviews") -> Column:
    """The product number by one of six readings; "input" takes a bare number, then a product path, then any ten letters or digits, in capitals."""
    if mode == "input":
        s = java_trim(c)
        path = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
        raw = F.when(s.rlike(r"^[A-Za-z0-9]{10}$"), s)
        return F.upper(F.coalesce(raw, F.when(~s.contains(" "), _first(path, INPUT_PATH)), _first(s, "([A-Za-z0-9]{10})")))
    return F.coalesce(*[_first(c, p) for p in ASIN_PATTERNS[mode]])


def absolutize(href: Column) -> Column:
    """Site-relative addresses made absolute; blank is null."""
    joined = F.when(href.startswith("/"), F.concat(F.lit(SITE), href)).otherwise(F.concat(F.lit(f"{SITE}/"), href))
    return F.when(href.rlike(r"\S"), F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).otherwise(joined))


def canonical_url(url: Column, asin: Column) -> Column:
    """https://<host>/dp/<asin>, the host kept if it names the shop, else the default one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)
    return F.concat(F.lit("https://"), F.when(host.contains("amazon"), host).otherwise("www.amazon.co.jp"), F.lit("/dp/"), asin)


def reviews_url(asin: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/product-reviews/"), asin, F.lit("/?reviewerType=all_reviews&sortBy=recent"))


def paged_reviews_url(asin: Column, domain: str = "www.amazon.co.jp", language: str = "ja_JP") -> Column:
    return F.concat(F.lit(f"https://{domain}/product-reviews/"), asin, F.lit(f"/?sortBy=recent&reviewerType=all_reviews&language={language}&pageNumber=1"))


def to_reviews_url(c: Column) -> Column:
    """A review address as it stands, else one made from the product number."""
    return F.when(c.startswith("http") & c.contains("/product-reviews/"), c).otherwise(reviews_url(extract_asin(c, "reviews")))


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def slug(c: Column, fallback: str = "adhoc") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(java_trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", F.lit(fallback)).otherwise(made)
