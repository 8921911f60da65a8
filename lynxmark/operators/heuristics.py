"""A suspicion score for each review, from its product's counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.functions import text as T
from lynxmark.functions.numbers import clamp01, rating_to_int

PARTS = ("dup", "author", "bias", "short", "mismatch")
FLAG_FROM, FIVE_STAR_SHARE, NAMED_FROM = 0.60, 0.40, 0.05


def with_body_signs(reviews: DataFrame) -> DataFrame:
    """Adds what is asked of bodies: body_key, body_length and body_negative. With these the others need no ``body``: add them where
    the texts lie, before anything is joined, and no text is shuffled."""
    body = F.nullif(T.normalize_body(F.col("body")), F.lit(""))
    negative = T.has_text(F.col("body")) & T.has_negative_word(F.col("body"))
    return reviews.withColumns({"body_key": F.coalesce(F.sha2(body, 256), F.lit("")), "body_length": F.length("body"), "body_negative": negative})


def with_product_stats(reviews: DataFrame, product: str = "product_id") -> DataFrame:
    """Adds total, five_star, dup_count and author_count: of the product, its rows with the same normalized body and author.

    The reviews are read twice: for the counts of all cells (product, body, author, five stars),
    summed where rows are read, from whose one shuffle the three counts are added up; and to be
    joined with these. No product's reviews meet in one task. A null or empty body or author is an empty key
    and has no count.
    """
    some = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  keys without nulls: no filter on them keeps the cells from being shared
    told = reviews if "body_key" in reviews.columns else with_body_signs(reviews)
    rows = told.withColumns({"author_key": some(T.normalize_author(F.col("author"))), "star": rating_to_int(F.col("rating").cast("double"))})
    cells = rows.groupBy(product, "body_key", "author_key", F.coalesce(F.col("star") == 5, F.lit(False)).alias("five")).agg(F.count("*").alias("n"))
    of_product = cells.groupBy(product).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("five"), F.col("n")).otherwise(0)).alias("five_star"))
    of_body = cells.groupBy(product, "body_key").agg(F.sum("n").alias("dup_count"))
    of_author = cells.groupBy(product, "author_key").agg(F.sum("n").alias("author_count"))
    both = rows.join(of_product, product).join(of_body, [product, "body_key"], "left").join(of_author, [product, "author_key"], "left")
    return both.withColumns({f"{k}_count": F.when(F.col(key) != "", F.col(f"{k}_count")) for k, key in (("dup", "body_key"), ("author", "author_key"))})


def _components() -> dict[str, Column]:
    n, length = F.col("total"), F.col("body_length")
    more = lambda c: F.coalesce(c, F.lit(0)) - 1
    five = F.col("five_star") / F.greatest(F.lit(1.0), n.cast("double"))
    return {
        "dup": F.when(more("dup_count") > 0, clamp01(more("dup_count") / F.greatest(F.lit(1.0), n / 10.0))).otherwise(0.0),
        "author": F.when(more("author_count") > 0, F.least(F.lit(1.0), more("author_count") / 5.0)).otherwise(0.0),
        "bias": F.when(five > FIVE_STAR_SHARE, clamp01((five - FIVE_STAR_SHARE) / (1.0 - FIVE_STAR_SHARE))).otherwise(0.0),
        "short": F.when((length > 0) & (length <= 20), 1.0).when((length > 20) & (length <= 60), 0.4).otherwise(0.0),
        "mismatch": F.when(F.col("body_negative") & (F.col("star") >= 4), 1.0).otherwise(0.0),
    }


def score_reviews(reviews: DataFrame, product: str = "product_id") -> DataFrame:
    """Adds each part's score, heuristic_score, heuristic_reasons (parts above 0.05, like "dup0.50,bias0.33") and sakura_flag.

    Reviews need body (or its signs), author and rating. Null and empty bodies and authors form no groups; a body of no length is not short.
    """
    df = with_product_stats(reviews, product).withColumns({f"s_{k}": c for k, c in _components().items()})
    s = {k: F.col(f"s_{k}") for k in PARTS}
    score = clamp01(0.35 * s["dup"] + 0.25 * s["bias"] + 0.15 * s["author"] + 0.15 * s["short"] + 0.10 * s["mismatch"])
    named = [F.when(s[k] > NAMED_FROM, F.concat(F.lit(k), F.format_string("%.2f", s[k]))) for k in PARTS]
    return df.withColumns({"heuristic_score": score, "heuristic_reasons": F.concat_ws(",", *named)}).withColumn("sakura_flag", F.col("heuristic_score") >= FLAG_FROM)
