"""Rating histograms, averages and snapshot summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.functions.dates import parse_collected_at
from lynxmark.functions.numbers import to_score
from lynxmark.functions.text import blank_to_null, first_non_blank, has_text


def rating_histogram(reviews: DataFrame, product: str = "product_id") -> DataFrame:
    """(product, rating, n), null ratings left out."""
    return reviews.where("rating IS NOT NULL").groupBy(product, "rating").agg(F.count("*").alias("n"))


def histogram_map(reviews: DataFrame, product: str = "product_id") -> DataFrame:
    """(product, ratings_histogram map<string,long>); a product without ratings has an empty map."""
    counts = rating_histogram(reviews, product).groupBy(product).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("rating").cast("string").alias("key"), F.col("n").alias("value"))))).alias("m"))
    return reviews.select(product).distinct().join(counts, product, "left").select(product, F.coalesce("m", F.create_map().cast("map<string,bigint>")).alias("ratings_histogram"))


def share_to_counts(shares: Column, total: Column) -> Column:
    """Percentages of the stars 5 to 1 as counts of ``total`` (without a total, the rounded percentages); missing, NaN and negative are 0."""
    n = F.greatest(F.coalesce(total, F.lit(0)), F.lit(0))

    def one(star: Column) -> Column:
        pct = F.coalesce(F.try_element_at(shares, star), F.lit(0.0))
        pct = F.when(F.isnan(pct) | (pct < 0), 0.0).otherwise(pct)
        return F.struct(star.alias("key"), F.floor(F.when(n > 0, pct / 100.0 * n).otherwise(pct) + 0.5).cast("long").alias("value"))

    return F.when(F.size(shares) > 0, F.map_from_entries(F.transform(F.sequence(F.lit(5), F.lit(1), F.lit(-1)), one))).otherwise(F.create_map().cast("map<int,bigint>"))


def balance_shares(five_to_one: Column) -> Column:
    """An array of five percentages, stars 5 to 1: missing is 0, each 0 to 100; where their sum is neither 0 nor 100, the
    difference goes to the largest, of equals the higher star, which is then kept within 0 to 100."""
    bars = F.transform(five_to_one, lambda x: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(x, F.lit(0)))))
    total = F.aggregate(bars, F.lit(0), lambda a, x: a + x)
    pivot = F.array_position(bars, F.array_max(bars)) - 1
    moved = F.transform(bars, lambda x, i: F.when(i == pivot, F.greatest(F.lit(0), F.least(F.lit(100), x + 100 - total))).otherwise(x))
    return F.when((total > 0) & (total != 100), moved).otherwise(bars)


def is_meaningful(histogram: Column) -> Column:
    """Some star has been given."""
    return F.coalesce(F.aggregate(F.map_values(histogram), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))) > 0, F.lit(False))


def sentiment(reviews: DataFrame, product: str = "product_id") -> DataFrame:
    """(product, positive, negative): ratings from 4 and up to 2; null and NaN are neither."""
    r = F.nanvl(F.col("rating").cast("double"), F.lit(None).cast("double"))
    return reviews.groupBy(product).agg(F.count_if(r >= 4).alias("positive"), F.count_if(r <= 2).alias("negative"))


def average_rating(rating: Column) -> Column:
    """An aggregate: mean without nulls and NaN, null if none is left."""
    return F.avg(F.nanvl(rating.cast("double"), F.lit(None).cast("double")))


def latest_instant(collected: Column) -> Column:
    """An aggregate: the text of the latest instant; text that is none comes before all instants, in text order."""
    return F.max_by(collected, F.when(has_text(collected), F.struct(parse_collected_at(collected).alias("t"), collected.alias("s"))))


def snapshot_summary(reviews: DataFrame, histograms: DataFrame) -> DataFrame:
    """Per asin in ascending order: average, count (the page's, else of its reviews), reviews, captured_at, sources, name, 0-100 score.

    ``reviews``: asin, rating, collectedAt, source_path. ``histograms``: asin, rating_average, rating_count, captured_at,
    productName, path, line_no; the last line of an asin counts.
    """
    asin = F.upper(blank_to_null(F.col("asin"))).alias("asin")
    r = reviews.select(asin, "rating", "collectedAt", "source_path").groupBy("asin").agg(average_rating(F.col("rating")).alias("mean"), F.count("*").alias("n"), latest_instant(F.col("collectedAt")).alias("latest"), F.sort_array(F.collect_set("source_path")).alias("sources"))
    h = histograms.select(asin, F.struct("path", "line_no").alias("at"), F.struct("rating_average", "rating_count", "captured_at", "productName").alias("h")).groupBy("asin").agg(F.max_by("h", "at").alias("h"))
    both = r.join(h, "asin", "full_outer").where("asin IS NOT NULL")
    mean = F.coalesce("h.rating_average", "mean")
    return both.select("asin", mean.alias("rating_average"), F.coalesce("h.rating_count", F.col("n"), F.lit(0)).cast("long").alias("rating_count"), F.coalesce("n", F.lit(0)).alias("n_reviews"), first_non_blank(F.col("h.captured_at"), F.col("latest")).alias("captured_at"), "sources", F.col("h.productName").alias("product_name"), to_score(mean).alias("score")).orderBy("asin")
