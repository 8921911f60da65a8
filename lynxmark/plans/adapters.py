"""The library's tables as views over the driver's: each as a DataFrame and as the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    asin = F.concat(F.lit("B"), F.lpad(key.cast("string"), 9, "0"))
    return p.select(
        key.cast("string").alias("product_id"), asin.alias("asin"), F.col("p_name").alias("title"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("tag"),
        F.concat(F.lit("https://www.amazon.co.jp/dp/"), asin).alias("url"), (F.col("p_size") % 5 != 0).alias("visible"),
        F.when(F.col("p_size") % 3 == 0, "DRAFT").when(F.col("p_size") % 7 == 0, "ARCHIVED").otherwise("PUBLISHED").alias("publish_status"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"), F.lit(None).cast("timestamp_ntz").alias("hidden_at"),
        F.timestamp_add("DAY", F.col("p_size"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("updated_at"),
    )


PRODUCTS = """products AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin, p_name AS title, p_name AS name, p_brand AS brand, p_type AS tag,
    'https://www.amazon.co.jp/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS url, p_size % 5 <> 0 AS visible,
    CASE WHEN p_size % 3 = 0 THEN 'DRAFT' WHEN p_size % 7 = 0 THEN 'ARCHIVED' ELSE 'PUBLISHED' END AS publish_status,
    TIMESTAMP '2024-01-01' + to_days(p_size) AS updated_at FROM part)"""


def reviews_num(spark: SparkSession, d: str) -> DataFrame:
    """Reviews without text, from line items."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")).alias("review_id"), F.col("l_partkey").cast("string").alias("product_id"),
        F.least(F.lit(5), 1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"), F.col("l_suppkey").cast("string").alias("reviewer"),
        F.when(F.col("l_returnflag") == "N", "AMAZON").when(F.col("l_returnflag") == "A", "SITE").otherwise("USER").alias("source"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") <= 2), "PENDING").when(F.col("l_linestatus") == "O", "PUBLISHED").otherwise("APPROVED").alias("status"),
        F.col("l_shipdate").alias("posted_at"), F.col("l_tax").alias("tax"),
    )


REVIEWS_NUM = """reviews_num AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS review_id, CAST(l_partkey AS VARCHAR) AS product_id,
    CAST(least(5, 1 + floor((l_quantity - 1) / 10)) AS INTEGER) AS rating, CAST(l_suppkey AS VARCHAR) AS reviewer,
    CASE l_returnflag WHEN 'N' THEN 'AMAZON' WHEN 'A' THEN 'SITE' ELSE 'USER' END AS source,
    CASE WHEN l_linestatus = 'O' AND l_linenumber <= 2 THEN 'PENDING' WHEN l_linestatus = 'O' THEN 'PUBLISHED' ELSE 'APPROVED' END AS status, l_shipdate AS posted_at, l_tax AS tax FROM lineitem)"""


def reviews_text(spark: SparkSession, d: str, signs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reviews with text: documents by source, stars from labels, dates and reviewers from events. With ``signs``, what it adds to
    the texts takes their place."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("product_id"), F.col("text").alias("body"), "lang")
    of_text = ["body"]
    if signs:
        before, docs = docs.columns, signs(docs)
        of_text = [c for c in docs.columns if c not in before]
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), "quality", "toxic")
    events = table(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("author"))
    stars = F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1).otherwise(3)
    both = docs.join(labels, "review_id", "left").join(events, "review_id", "left")
    return both.select("review_id", "product_id", *of_text, "lang", stars.alias("stars"), stars.alias("rating"), "quality", "toxic", "created_at", F.to_date("created_at").alias("review_date"), "author")


REVIEWS_TEXT = """reviews AS (SELECT d.doc_id AS review_id, d.source AS product_id, d.text AS body, d.lang, CASE l.quality WHEN 1 THEN 5 WHEN 0 THEN 1 ELSE 3 END AS stars,
    l.quality, l.toxic, e.ts AS created_at, CAST(e.ts AS DATE) AS review_date, CAST(e.user_id AS VARCHAR) AS author
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id)"""


def squeeze(c):
    """The built-in part of text normalization: lower case, ASCII white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\t\n\x0B\f\r ]+", " "))


def sql_squeeze(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[\t\n\x0B\f\r ]+', ' ', 'g'))"


def sql_java_trim(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"


SQL_URL = r"(?i)https?://|www\.|\.co(m|\.jp)|\.jp"
SQL_EMOJI_SITE = r"[\p{So}\x{1F000}-\x{10FFFF}]"
SQL_EMOJI_EVAL = r"[\x{2600}-\x{27BF}\x{1F000}-\x{10FFFF}]"
#: Without back-references: each mark three times.
SQL_RUN = "|".join(f"{m}{{3,}}" for m in ("!", "！", r"\?", "？", r"\.", ",", "。", "、", "〜", "～", "ー", "-"))
