"""Types of the tables and records that the library reads and writes."""

from __future__ import annotations

from pyspark.sql.types import StructType

HISTOGRAM_LINE = "type string, dataset string, asin string, captured_at string, productName string, rating_average double, rating_count int, ratings_histogram map<string,int>"
REVIEW_LINE = "dataset string, asin string, url string, reviewId string, rating double, dateText string, title string, author string, body string, bodyLength int, ratingText string, heuristic_sakura_score double, heuristic_reasons string, sakura_flag boolean, collectedAt string"
CSV_COLUMNS = ("dataset", "asin", "url", "reviewId", "rating", "dateText", "title", "author", "body", "bodyLength", "ratingText", "heuristic_sakura_score", "heuristic_reasons", "sakura_flag", "collectedAt")
INLINE_REVIEW = "struct<title:string,body:string,stars:int,verified:boolean,dateText:string>"
SNAPSHOT = f"asin string, title string, brand string, priceMinor long, ratingAverage double, ratingCount long, ratingSharePct map<int,double>, imageUrls array<string>, featureBullets array<string>, inlineReviews array<{INLINE_REVIEW}>, partial boolean, capturedAt string"
REVIEW_ITEM = "asin string, reviewId string, title string, body string, rating int, reviewDate date, reviewer string, url string, helpfulVotes int"
HISTOGRAM = "percentageByStar map<int,int>, averageRating double, reviewCount int"
REVIEWS = "review_id string, product_id string, source string, status string, rating int, stars int, title string, body string, text string, fingerprint string, external_review_id string, source_review_id string, reviewer string, reviewer_ref string, reviewer_public boolean, review_url string, helpful_votes int, review_date date, visible boolean, moderated_by string, moderated_reason string, moderated_at timestamp_ntz, posted_at timestamp_ntz, collected_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
PRODUCTS = "product_id string, asin string, title string, name string, brand string, url string, visible boolean, publish_status string, published_at timestamp_ntz, hidden_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
REVIEW_SCORES = "product_id string, source string, score double, rank string, sakura_judge string, flags array<string>, rules array<struct<id:string,value:double,warn:double,crit:double,weight:double,points:int>>, metrics map<string,double>, computed_at timestamp_ntz, updated_at timestamp_ntz"
PRODUCT_STATS = "product_id string, rating_average decimal(3,2), rating_count int, ratings_histogram map<string,long>, captured_at timestamp_ntz, updated_at timestamp_ntz"
PRODUCT_SNAPSHOTS = "snapshot_id string, product_id string, product_name string, source_url string, snapshot_json string, source_html string, upload_target string, uploaded_at timestamp_ntz, created_at timestamp_ntz"
SCRAPE_JOBS = "job_id string, product_id string, source string, requested_url string, status string, target_total int, collected int, upserted int, attempt_count int, last_error string, message string, requested_by string, started_at timestamp_ntz, finished_at timestamp_ntz, created_at timestamp_ntz"
AUDIT_LOGS = "audit_id string, actor string, action string, target_type string, target_id string, meta string, ip_address string, created_at timestamp_ntz"
EXCEPTION_LOGS = "exception_id string, scope string, error_code string, message string, stack string, job_id string, context string, created_at timestamp_ntz"

# The domains of text columns.
SOURCES = ("AMAZON", "SITE", "USER")
STATUSES = ("DRAFT", "PUBLISHED", "REJECTED", "PENDING", "APPROVED")
VERDICTS = ("SAKURA", "LIKELY", "UNLIKELY", "GENUINE")
RANKS = ("A", "B", "C")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
