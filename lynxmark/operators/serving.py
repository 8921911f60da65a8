"""Filters, lookups, lists and pages over products, reviews, snapshots, jobs and logs.

Every sorted list ends its sort key with the row's own key, so that pages do not overlap.
Limits are taken as top-N over the sort, which keeps N rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxmark.functions.text import has_text, java_trim
from lynxmark.functions.urls import ADMIN_ASIN, ADMIN_URL

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
QUEUE_STATUSES = ("PENDING", "DRAFT")


def clamp_limit(n: int | None, most: int, default: int | None = None) -> int:
    """A limit of 0 or less, or none, is the default (else 1)."""
    if n is None or n <= 0:
        return default if default is not None else 1
    return min(n, most)


def parse_bool(text: str | None) -> bool | None:
    word = (text or "").strip().lower()
    if not word:
        return None
    if word in TRUE_WORDS or word in FALSE_WORDS:
        return word in TRUE_WORDS
    raise ValueError(f"not a boolean: {text!r}")


def public_reviews(reviews: DataFrame, product_id: object = None) -> DataFrame:
    """From the shop, or approved; of one product or of all."""
    kept = reviews.where((F.col("source") == "AMAZON") | (F.col("status") == "APPROVED"))
    return kept if product_id is None else kept.where(F.col("product_id") == product_id)


def newest_first(reviews: DataFrame, key: str = "review_id") -> list[Column]:
    when = F.coalesce("posted_at", "created_at") if "created_at" in reviews.columns else F.col("posted_at")
    return [when.desc_nulls_last(), F.col(key).asc()]


def amazon_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where("source = 'AMAZON'")


def approved_user_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where("source = 'USER' AND status = 'APPROVED'")


def find_reviews(reviews: DataFrame, **equal: object) -> DataFrame:
    """Equality on each given column; a list or tuple means any of its values."""
    for column, value in equal.items():
        reviews = reviews.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return reviews


def with_tag(products: DataFrame, product_tags: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Products that have the tag, each once: a left semi join."""
    chosen = product_tags.join(tags.where(F.col("name") == tag).select("tag_id"), "tag_id", "left_semi")
    return products.join(chosen.select("product_id"), "product_id", "left_semi")


def search_products(products: DataFrame, q: str | None = None, brand: str | None = None, visible: bool | None = None, status: str | None = None) -> DataFrame:
    """A parameter that is None asks nothing. ``q`` is sought in title, name and asin; its % and _ are wild, as they come."""
    if q is not None:
        low = f"%{q.lower()}%"
        products = products.where(F.lower("title").like(low) | F.lower("name").like(low) | F.upper("asin").like(f"%{q.upper()}%"))
    for column, value in (("brand", brand), ("visible", visible), ("publish_status", status)):
        if value is not None:
            products = products.where(F.col(column) == value)
    return products


def simple_search(products: DataFrame, q: str, limit: int) -> DataFrame:
    low = f"%{q.lower()}%"
    found = products.where(F.lower("title").like(low) | F.lower("asin").like(low))
    return found.orderBy(F.col("updated_at").desc_nulls_last(), "product_id").limit(clamp_limit(limit, 100))


def page(df: DataFrame, order: list[Column], page_no: int, size: int, most: int = 200) -> DataFrame:
    """The page, counted from 0."""
    size = clamp_limit(size, most)
    return df.orderBy(*order).offset(max(0, page_no) * size).limit(size)


def with_ordinal(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """For deep pages: each row's place within its partition."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def visible_products(products: DataFrame) -> DataFrame:
    return products.where("visible AND publish_status = 'PUBLISHED'")


def pending_uploads(snapshots: DataFrame, include_uploaded: bool = False) -> DataFrame:
    return snapshots if include_uploaded else snapshots.where("uploaded_at IS NULL")


def equal_ignoring_case(column: str, value: str) -> Column:
    return F.upper(column) == value.upper()


def among(df: DataFrame, column: str, ids: DataFrame | list) -> DataFrame:
    """A short list becomes a predicate, a table a semi join."""
    return df.where(F.col(column).isin(ids)) if isinstance(ids, list) else df.join(ids.select(column), column, "left_semi")


def moderation_queue(reviews: DataFrame, kind: str | None = None) -> DataFrame:
    """Pending and draft reviews; ``kind`` USER, SITE or AMAZON, any other word or none for all."""
    queue = reviews.where(F.col("status").isin(*QUEUE_STATUSES))
    word = (kind or "").strip().upper()
    return queue.where(F.col("source") == word) if word in ("USER", "SITE", "AMAZON") else queue


def privacy_view(reviews: DataFrame) -> DataFrame:
    """The reviewer's name only where it is public; body, else text; stars, else 0."""
    return reviews.select("review_id", F.when(F.col("reviewer_public"), F.col("reviewer")).alias("reviewer"), F.coalesce("body", "text").alias("body"), F.coalesce("stars", F.lit(0)).alias("stars"))


def valid_target(url: Column, asin: Column) -> Column:
    return F.coalesce(url.rlike(ADMIN_URL), F.lit(False)) | F.coalesce(asin.rlike(ADMIN_ASIN), F.lit(False))


def checked_user_reviews(reviews: DataFrame) -> DataFrame:
    """Adds ``problem`` (null: acceptable): stars that round into 1 to 5, a body of at most 1000 characters; titles are cut at 200."""
    stars = F.floor(F.col("stars") + 0.5)
    problem = F.when(F.col("stars").isNull() | F.isnan(F.col("stars").cast("double")) | (stars < 1) | (stars > 5), "stars").when(~has_text(F.col("body")), "body missing").when(F.length("body") > 1000, "body too long")
    return reviews.withColumns({"title": F.left("title", F.lit(200)), "problem": problem})


def find_snapshot(snapshots: DataFrame, asin: str, dataset: str | None) -> DataFrame:
    """By asin; the dataset is compared, ignoring case, only where both sides name one."""
    found = snapshots.where(F.upper(java_trim(F.col("asin"))) == asin.strip().upper())
    if dataset and dataset.strip():
        found = found.where(~has_text(F.col("dataset")) | (F.lower(java_trim(F.col("dataset"))) == dataset.strip().lower()))
    return found


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Over decoded snapshots (column ``snapshot``)."""
    s = lambda c: F.col(f"snapshot.{c}")
    return snapshots.select("snapshot_id", "product_id", s("asin").alias("asin"), s("title").alias("title"), s("ratingAverage").alias("rating_average"), s("ratingCount").alias("rating_count"), F.coalesce(F.size(s("inlineReviews")), F.lit(0)).alias("n_inline"), s("partial").alias("partial"))


def log_view(logs: DataFrame, include_stack: bool = False) -> DataFrame:
    return logs if include_stack else logs.withColumn("stack", F.lit(None).cast("string"))


def find_by_url_or_asin(products: DataFrame, url: str, asin: str | None) -> DataFrame:
    """One row at most, the smallest key of those that match."""
    hit = F.col("url") == url
    if asin is not None:
        hit = hit | (F.col("asin") == asin)
    return products.where(hit).orderBy("product_id").limit(1)


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row, one boolean; reading stops at the first match."""
    return df.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def latest(df: DataFrame, key: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key, of equally new ones that with the largest ``tie``. Ranks are cut before the shuffle."""
    order = Window.partitionBy(*key).orderBy(F.col(when).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def joined_snapshots(snapshots: DataFrame, products: DataFrame) -> DataFrame:
    return snapshots.join(products, "product_id")


def scores_with_products(scores: DataFrame, products: DataFrame, source: str = "AMAZON") -> DataFrame:
    return scores.where(F.col("source") == source).join(products, "product_id")


def scores_with_reviews(legacy: DataFrame, reviews: DataFrame) -> DataFrame:
    """Legacy scores keep their row without a review; the product is the score's own, else the review's."""
    found = reviews.select("review_id", F.col("product_id").alias("_product"))
    return legacy.join(found, "review_id", "left").withColumn("product_id", F.coalesce("product_id", "_product")).drop("_product")


def fill_from(target: DataFrame, source: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """An update from another table: ``column`` becomes ``value`` of the row with the same key where it is null; ``source`` has one row a key."""
    found = source.select(key, value.alias("_value"))
    return target.join(found, key, "left").withColumn(column, F.coalesce(column, "_value")).drop("_value")


def in_requested_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``ids`` (key, ordinal) with what is found for each; ``found`` is false for what is missing."""
    return ids.join(rows.withColumn("_found", F.lit(True)), key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found").orderBy("ordinal")


def products_with_scores(products: DataFrame, scores: DataFrame) -> DataFrame:
    """Each product with its score and rank; 0 and A without one."""
    return products.join(scores.select("product_id", "score", "rank"), "product_id", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "rank": F.coalesce("rank", F.lit("A"))})


def scores_by_source(scores: DataFrame) -> DataFrame:
    """(product_id, amazon, site)"""
    pivot = scores.groupBy("product_id").pivot("source", ["AMAZON", "SITE"]).agg(F.first("score"))
    return pivot.select("product_id", F.col("AMAZON").alias("amazon"), F.col("SITE").alias("site"))


def grouped_reviews(reviews: DataFrame, limit: int) -> DataFrame:
    """Per product the newest shop reviews and the newest approved user reviews, ``limit`` of each, as one table with a bucket."""
    both = amazon_reviews(reviews).withColumn("bucket", F.lit("amazon")).unionByName(approved_user_reviews(reviews).withColumn("bucket", F.lit("user")))
    order = Window.partitionBy("product_id", "bucket").orderBy(*newest_first(reviews))
    return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= clamp_limit(limit, 100))


def newest_logs(logs: DataFrame, key: str, limit: int | None = None, **equal: object) -> DataFrame:
    return find_reviews(logs, **equal).orderBy(F.col("created_at").desc_nulls_last(), key).limit(clamp_limit(limit, 100, 100))
