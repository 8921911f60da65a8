"""Queries that make the rules' contexts from reviews: likeness of texts and recent activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark.operators import activity, likeness, rules
from lynxmark.plans.adapters import REVIEWS_TEXT, reviews_text, sql_java_trim, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _alike(group: str) -> str:
    """CTEs: each review's highest likeness to another of its group, by all pairs with a word in common."""
    return rf"""bags AS (SELECT review_id, {group} AS grp, list_distinct(list_filter(regexp_split_to_array({sql_java_trim("body")}, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS bag FROM reviews WHERE body IS NOT NULL),
    words AS (SELECT review_id, grp, len(bag) AS size, unnest(bag) AS word FROM bags),
    met AS (SELECT a.review_id, b.review_id AS other, a.size + b.size AS sizes, count(*) AS common FROM words a JOIN words b ON a.grp = b.grp AND a.word = b.word AND a.review_id <> b.review_id GROUP BY ALL),
    alike AS (SELECT review_id, max(CAST(common AS DOUBLE) / (sizes - common)) AS text_similarity FROM met WHERE 100 * common >= 80 * (sizes - common) GROUP BY review_id)"""


def _with_likeness(spark: SparkSession, d: str) -> DataFrame:
    """The reviews without their texts, which are compared as they lie in their table; most are like none."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("product_id"), F.col("text").alias("body"))
    alike = likeness.with_text_similarity(texts).where("text_similarity > 0").groupBy("review_id").agg(F.max("text_similarity").alias("text_similarity"))
    told = reviews_text(spark, d).drop("body").join(alike, "review_id", "left")
    return told.withColumn("text_similarity", F.coalesce("text_similarity", F.lit(0.0)))


@query(f"WITH {REVIEWS_TEXT}, {_alike('product_id')} SELECT r.review_id, r.product_id, coalesce(text_similarity, 0.0) AS text_similarity FROM reviews r LEFT JOIN alike USING (review_id)")
def jn_text_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _with_likeness(spark, d).select("review_id", "product_id", "text_similarity")


@query("SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS INTEGER) AS reviews_last_24h FROM events")
def win_reviews_last_24h(spark: SparkSession, d: str) -> DataFrame:
    counted = activity.with_recent_count(table(spark, d, "events"), who="user_id", when="ts")
    return counted.select("event_id", "user_id", "reviews_last_24h")


_REVIEW_RULES = ("DUPLICATE_TEXT", "EXCESSIVE_FIVE_STAR", "SURGE_ACTIVITY", "NEW_ACCOUNT_BURST")
#: A busy day, in this table, is one of over two reviews by an author; a new account is younger than 7 days and has more than one.
_LIMITS = rules.Limits(reviews_per_day=2, burst_reviews=1)


def review_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of reviews, all from the reviews themselves; who wrote what is told by the author, copied texts by the product."""
    busy = activity.with_account_age(activity.with_recent_count(_with_likeness(spark, d)))
    return busy.select("review_id", "product_id", "author", F.col("stars").alias("star_rating"), "text_similarity", "reviews_last_24h", "account_age_days")


@query(f"""WITH {REVIEWS_TEXT}, {_alike('product_id')},
    timed AS (SELECT review_id, CASE WHEN author IS NULL OR created_at IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY author ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) END AS n,
        coalesce(date_diff('day', CAST(min(created_at) OVER (PARTITION BY author) AS DATE), CAST(created_at AS DATE)), 365) AS age FROM reviews),
    ctx AS (SELECT r.review_id, r.product_id, r.author, r.stars, coalesce(text_similarity, 0.0) AS likeness, n, age FROM reviews r JOIN timed USING (review_id) LEFT JOIN alike USING (review_id)),
    pen AS (SELECT *, CASE WHEN likeness > 0.8 THEN (likeness - 0.8) / (CAST(1.0 AS DOUBLE) - 0.8) * 15.0 END AS p1, CASE WHEN stars >= 5 AND n > 2 * 0.6 THEN CAST(n - 1 AS DOUBLE) / (2 * 0.4) * 5.0 END AS p2,
        CASE WHEN n > 2 THEN CAST(n - 2 AS DOUBLE) / 2.0 * 10.0 END AS p3, CASE WHEN age < 7 AND n > 1 THEN CAST(n - 1 AS DOUBLE) / 1.0 * 10.0 END AS p4 FROM ctx)
    SELECT review_id, product_id, author, likeness AS text_similarity, CAST(n AS INTEGER) AS reviews_last_24h, p1 AS penalty_DUPLICATE_TEXT, p2 AS penalty_EXCESSIVE_FIVE_STAR, p3 AS penalty_SURGE_ACTIVITY, p4 AS penalty_NEW_ACCOUNT_BURST,
        coalesce(p1, 0.0) + coalesce(p2, 0.0) + coalesce(p3, 0.0) + coalesce(p4, 0.0) AS total_penalty FROM pen""")
def rule_review_contexts(spark: SparkSession, d: str) -> DataFrame:
    scored = rules.score_rules(review_contexts(spark, d), rules.Profile(limits=_LIMITS), [r for r in rules.CATALOG if r.flag in _REVIEW_RULES])
    return scored.select("review_id", "product_id", "author", "text_similarity", "reviews_last_24h", *[f"penalty_{k}" for k in _REVIEW_RULES], "total_penalty")
