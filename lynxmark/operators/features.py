"""Per-product features of reviews, in four variants, all products in one pass.

Reviews are rows with product_id, stars, body, created_at (or review_date) and, where known,
fingerprint and reviewer_ref. Duplicate clusters and days are counted by (product, key) and
then by product: a popular product's rows are summed where they are read, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.functions import text as T
from lynxmark.functions.numbers import clamp01, percent

SHORT_SITE, SHORT_AMAZON, NOISY_AMAZON, FEW_CHARS, WINDOW_DAYS = 60, 120, 40, 10, 7


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _filled(c: Column) -> Column:
    return F.when(T.has_text(c), c)


def largest_group(reviews: DataFrame, key: Column, product: str = "product_id") -> DataFrame:
    """(product, max_cluster): rows of the product's most frequent key; null keys are left out. Keys travel as digests."""
    keyed = reviews.select(F.col(product), F.sha2(key, 256).alias("k")).where("k IS NOT NULL")
    return keyed.groupBy(product, "k").agg(F.count("*").alias("n")).groupBy(product).agg(F.max("n").alias("max_cluster"))


def _grouped(reviews: DataFrame, product: str, counts: dict[str, Column], key: Column, day: Column) -> DataFrame:
    """Per product: total_reviews, the ``counts`` (conditions), max_cluster, max_day and days, in one reading of the reviews.

    Each review's conditions, key digest and day are computed once; three groupings of these
    (by product, by product and key, by product and day) share the scan and the shuffle, with
    partial sums where the reviews are read. Null keys and days make no cluster and no day.
    """
    slim = reviews.select(F.col(product), *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in counts.items()], F.sha2(key, 256).alias("k"), day.alias("day"))
    at = [F.col(product), F.col("k"), F.col("day")]
    sets = slim.groupingSets([at[:1], at[:2], [at[0], at[2]]], *at).agg(F.grouping_id().alias("left_out"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counts])
    whole, by_key, by_day = F.col("left_out") == 3, (F.col("left_out") == 1) & F.col("k").isNotNull(), (F.col("left_out") == 2) & F.col("day").isNotNull()
    of = lambda which, c: F.max(F.when(which, F.col(c)))
    return sets.groupBy(product).agg(of(whole, "n").alias("total_reviews"), *[of(whole, c).alias(c) for c in counts], of(by_key, "n").alias("max_cluster"), of(by_day, "n").alias("max_day"), F.count_if(by_day).alias("days"))


def noise_parts(body: Column, variant: str) -> dict[str, Column]:
    """What makes a review noisy; an empty body is short alone."""
    full = body != ""
    return {
        "url_hits": full & T.has_url(body), "emoji_hits": full & T.has_emoji(body, variant),
        "symbol_runs": full & T.has_symbol_run(body), "short_reviews": F.length(body) < SHORT_SITE,
    }


def _noise(total: Column) -> Column:
    share = lambda c: F.col(c) / total
    return F.least(F.lit(100.0), (share("url_hits") * 0.4 + share("emoji_hits") * 0.2 + share("symbol_runs") * 0.2 + share("short_reviews") * 0.2) * 100.0)


def _surge(total: Column) -> Column:
    """The busiest day against the mean day. It is never below that mean, so any dated reviews give 100: so the formula is."""
    mean = total / F.col("days")
    return F.when(F.coalesce("days", F.lit(0)) > 0, F.least(F.lit(100.0), F.col("max_day") / mean * 100.0)).otherwise(0.0)


def site_key(df: DataFrame, normalize: Callable[[Column], Column] = T.normalize, strict_reviewer_meta: bool = False) -> Column:
    """Fingerprint, else reviewer in lower case, else normalized body. An empty JSON object is no reviewer unless ``strict_reviewer_meta``."""
    ref = _filled(_or_null(df, "reviewer_ref"))
    if not strict_reviewer_meta:
        ref = F.nullif(ref, F.lit("{}"))
    return F.coalesce(_filled(_or_null(df, "fingerprint")), F.lower(ref), _filled(normalize(T.java_trim(F.col("body")))))


def site_features(reviews: DataFrame, product: str = "product_id", normalize: Callable[[Column], Column] = T.normalize, strict_reviewer_meta: bool = False, day: Column | None = None) -> DataFrame:
    """dist_bias, duplicates, surge and noise in percent, with the counts behind them."""
    rows = reviews.withColumn("body", T.java_trim(F.coalesce("body", F.lit(""))))
    counts = {"five_star": F.col("stars") >= 5} | noise_parts(F.col("body"), "site")
    grouped = _grouped(rows, product, counts, site_key(rows, normalize, strict_reviewer_meta), F.to_date("created_at") if day is None else day)
    return _percentages(grouped, product)


def _percentages(df: DataFrame, product: str) -> DataFrame:
    total = F.col("total_reviews")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(a) for c, a in (("max_cluster", "max_duplicate_cluster"), ("max_day", "max_day_reviews"), ("days", "day_buckets"))]
    mean = F.when(F.col("days") > 0, total / F.col("days")).otherwise(0.0).alias("avg_per_day")
    return df.select(
        product, "total_reviews", "five_star", percent(F.col("five_star"), total).alias("dist_bias"), percent(F.coalesce("max_cluster", F.lit(0)), total).alias("duplicates"),
        _surge(total).alias("surge"), _noise(total).alias("noise"), *counts, mean, "url_hits", "emoji_hits", "symbol_runs", "short_reviews",
    )


def eval_features(reviews: DataFrame, product: str = "product_id", day: Column | None = None) -> DataFrame:
    """The offline evaluator's: exact stripped bodies as clusters, its own emoji set, undated rows in the mean day."""
    rows = reviews.withColumn("body", T.unicode_strip(F.coalesce("body", F.lit(""))))
    counts = {"five_star": F.col("stars") >= 5} | noise_parts(F.col("body"), "eval")
    return _percentages(_grouped(rows, product, counts, F.nullif("body", F.lit("")), F.to_date("created_at") if day is None else day), product)


def amazon_features(reviews: DataFrame, as_of: str, product: str = "product_id", normalize: Callable[[Column], Column] = T.normalize) -> DataFrame:
    """Ratios 0 to 1; ``as_of`` is the day that recency counts back from."""
    rows = reviews.withColumn("norm", normalize(F.coalesce("body", F.lit(""))))
    few = F.size(F.array_distinct(F.split("norm", ""))) < FEW_CHARS
    noisy = ~T.has_text(F.col("norm")) | (F.length("norm") < NOISY_AMAZON) | few
    recent = F.col("review_date") >= F.date_sub(F.to_date(F.lit(as_of)), WINDOW_DAYS)
    counts = {"five_star": F.col("stars") >= 5, "short": F.length("norm") < SHORT_AMAZON, "noisy": noisy, "recent_reviews": recent}
    key = F.coalesce(_filled(_or_null(rows, "fingerprint")), _filled(F.col("norm")), _filled(_or_null(rows, "reviewer")))
    total = F.col("total_reviews")
    return _grouped(rows, product, counts, key, F.lit(None).cast("date")).select(
        product, "total_reviews", clamp01(F.col("five_star") / total * (F.col("short") / total)).alias("dist_bias"), clamp01(F.coalesce("max_cluster", F.lit(1)) / total).alias("duplicate_rate"),
        clamp01(F.col("recent_reviews") * 1.0 / F.greatest(F.lit(1.0), total / 5.0)).alias("surge_ratio"), clamp01(F.col("noisy") / total).alias("noise_ratio"), "recent_reviews", F.lit(WINDOW_DAYS).alias("window_days"),
    )


def exported_features(reviews: DataFrame, product: str = "product_id") -> DataFrame:
    """The exported features: five-star share with a short-median term, and the largest cluster as a count. Rounding is to even."""
    rows = reviews.withColumn("body", F.coalesce("body", F.lit("")))
    base = rows.groupBy(product).agg(F.count("*").alias("cnt"), F.count_if(F.bround("stars") >= 5).alias("five"), F.expr("percentile(length(body), 0.5)").alias("median"))
    clusters = largest_group(rows, T.normalize_body(F.col("body")), product)
    median = F.greatest(F.lit(1.0), F.bround("median"))
    bias = 100.0 * (0.7 * (F.col("five") / F.col("cnt")) + 0.3 * F.least(F.lit(1.0), 40.0 / median))
    return base.join(clusters, product, "left").select(product, F.bround(bias, 2).alias("dist_bias"), F.coalesce("max_cluster", F.lit(0)).cast("long").alias("duplicates"), "cnt")
