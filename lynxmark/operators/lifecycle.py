"""State changes of jobs, reviews, products and snapshots, as folds and column updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.functions.text import blank_to_null, has_text

STACK_LIMIT = 20_000
TRANSITIONS = {
    "publish": ("PUBLISHED", True), "approve": ("PUBLISHED", True), "draft": ("DRAFT", None), "archive": ("ARCHIVED", False), "hide": (None, False), "show": (None, True),
}


def fold_jobs(events: DataFrame) -> DataFrame:
    """Each job's state from its events (job_id, seq, at, kind, collected, upserted, code, message).

    Kinds: QUEUED, RUNNING, PROGRESS, SUCCEEDED, FAILED. The last kind but PROGRESS is the status; a failure's error is
    "CODE: message"; the first finish stays; each RUNNING is an attempt.
    """
    at = F.struct("at", "seq")
    state = F.col("kind") != "PROGRESS"
    ended = F.col("kind").isin("SUCCEEDED", "FAILED")
    error = F.when(F.col("kind") == "FAILED", F.concat_ws(": ", "code", "message"))
    return events.groupBy("job_id").agg(
        F.max_by("kind", F.when(state, at)).alias("status"), F.count_if(F.col("kind") == "RUNNING").alias("attempt_count"), F.min(F.when(F.col("kind") == "RUNNING", F.col("at"))).alias("started_at"),
        F.min(F.when(ended, F.col("at"))).alias("finished_at"), F.max_by("collected", F.when(F.col("collected").isNotNull(), at)).alias("collected"),
        F.max_by("upserted", F.when(F.col("upserted").isNotNull(), at)).alias("upserted"), F.max_by(error, F.when(F.col("kind") == "FAILED", at)).alias("last_error"),
    )


def moderate(reviews: DataFrame, decisions: DataFrame, need_pending: bool = False) -> DataFrame:
    """Apply decisions (review_id, approve boolean, actor, reason, at), one a review: status, visibility and who, why, when.

    With ``need_pending`` only drafts and pending reviews change.
    """
    d = decisions.select("review_id", "approve", F.col("actor").alias("_by"), F.col("reason").alias("_why"), F.col("at").alias("_at"))
    both = reviews.join(d, "review_id", "left")
    takes = F.col("approve").isNotNull()
    if need_pending:
        takes = takes & F.col("status").isin("DRAFT", "PENDING")
    new = {"status": F.when(F.col("approve"), "APPROVED").otherwise("REJECTED"), "visible": F.col("approve"), "moderated_by": F.col("_by"), "moderated_reason": F.col("_why"), "moderated_at": F.col("_at")}
    return both.withColumns({k: F.when(takes, v).otherwise(F.col(k)) for k, v in new.items()}).drop("approve", "_by", "_why", "_at")


def moderation_audit(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """An audit row for each decision on a draft or pending review."""
    open_ = reviews.where(F.col("status").isin("DRAFT", "PENDING")).select("review_id")
    taken = decisions.join(open_, "review_id", "left_semi")
    return taken.select(F.col("actor"), F.when(F.col("approve"), "REVIEW_APPROVE").otherwise("REVIEW_REJECT").alias("action"), F.lit("review").alias("target_type"), F.col("review_id").cast("string").alias("target_id"), F.to_json(F.struct("reason")).alias("meta"), F.col("at").alias("created_at"))


def register_products(products: DataFrame, requests: DataFrame, stamp: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Get or create by asin: what is there stays, only blanks are filled. New rows start visible as drafts, named after their asin's row.

    Of several requests for an asin the first one that has a value fills it: the first by
    ``order``, columns of the requests, and then by product_id and by the value.
    """
    fill = ("title", "name", "brand", "url")

    def earliest(c: str) -> Column:
        value = blank_to_null(F.col(c))
        return F.min_by(value, F.when(value.isNotNull(), F.struct(*order, "product_id", value.alias("_value")))).alias(f"_n_{c}")

    one = requests.where(F.col("asin").isNotNull()).groupBy("asin").agg(*[earliest(c) if c in requests.columns else F.lit(None).cast("string").alias(f"_n_{c}") for c in fill], F.min("product_id").alias("_id"))
    both = products.join(one, "asin", "full_outer")
    values = {c: F.coalesce(blank_to_null(F.col(c)), f"_n_{c}") for c in fill if c in products.columns}
    values |= {"product_id": F.coalesce("product_id", "_id"), "visible": F.coalesce("visible", F.lit(True)), "publish_status": F.coalesce("publish_status", F.lit("DRAFT")), "updated_at": F.when(F.col("_id").isNotNull(), F.lit(stamp).cast("timestamp_ntz")).otherwise(F.col("updated_at"))}
    return both.withColumns(values).select(*products.columns)


def intake_pages(products: DataFrame, pages: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """Parsed product pages (a snapshot's fields, page_key, source_url) taken in: the products after registering those with a
    product number, and the snapshot rows to append, one a page."""
    known = pages.where(F.col("asin").isNotNull())
    requests = known.select("page_key", F.upper("asin").alias("asin"), "title", F.col("title").alias("name"), "brand", F.col("source_url").alias("url"), F.concat(F.lit("p-"), F.upper("asin")).alias("product_id"))
    after = register_products(products, requests, stamp, ("page_key",))
    fields = [F.col(c) for c in pages.columns if c not in ("page_key", "source_url")]
    rows = known.select("page_key", F.upper("asin").alias("asin"), "source_url", F.to_json(F.struct(*fields)).alias("snapshot_json"))
    ids = after.select("asin", "product_id", F.col("title").alias("product_name"))
    return after, rows.join(ids, "asin").withColumn("created_at", F.lit(stamp).cast("timestamp_ntz")).drop("asin")


def transition(products: DataFrame, ids: DataFrame, action: str, stamp: str) -> DataFrame:
    """publish, approve, draft, archive, hide or show the products of ``ids``."""
    status, visible = TRANSITIONS[action]
    hit = F.coalesce("_hit", F.lit(False))
    at = F.lit(stamp).cast("timestamp_ntz")
    both = products.join(ids.select("product_id").distinct().withColumn("_hit", F.lit(True)), "product_id", "left")
    new: dict[str, Column] = {"updated_at": at}
    if status:
        new["publish_status"] = F.lit(status)
    if visible is not None:
        new["visible"] = F.lit(visible)
        new["hidden_at"] = F.lit(None).cast("timestamp_ntz") if visible else at
    if status == "PUBLISHED":
        new["published_at"] = F.coalesce("published_at", at)
    return both.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).select(*products.columns)


def mark_uploaded(snapshots: DataFrame, ids: DataFrame, target: str, stamp: str) -> DataFrame:
    hit = F.coalesce("_hit", F.lit(False))
    both = snapshots.join(ids.select("snapshot_id").distinct().withColumn("_hit", F.lit(True)), "snapshot_id", "left")
    return both.withColumns({"uploaded_at": F.when(hit, F.lit(stamp).cast("timestamp_ntz")).otherwise(F.col("uploaded_at")), "upload_target": F.when(hit, F.lit(target)).otherwise(F.col("upload_target"))}).select(*snapshots.columns)


def normalized_status(status: Column) -> Column:
    """Capitals; blank is null."""
    return F.upper(F.nullif(status, F.lit("")))


def backfilled(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Nulls of each column take its value."""
    return df.withColumns({k: F.coalesce(k, v) for k, v in values.items()})


def exception_rows(errors: DataFrame, stamp: str) -> DataFrame:
    """What is appended to the exception log: stacks cut at 20,000 characters, the request's id before the message."""
    message = F.when(has_text(F.col("request_id")), F.concat(F.lit("[rid="), F.col("request_id"), F.lit("] "), F.coalesce("message", F.lit("")))).otherwise(F.col("message"))
    return errors.withColumns({"message": message, "stack": F.left("stack", F.lit(STACK_LIMIT)), "created_at": F.lit(stamp).cast("timestamp_ntz")})
