"""Keyed upserts of one table into another.

A merge is one shuffle of the batch (its rows of a key folded into one, with map-side
partial results) and one full outer join on the key. Nothing is read to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.functions import text as T
from lynxmark.functions.hashing import fingerprint, reviewer_ref

COALESCE, OVERWRITE, KEEP = "coalesce", "overwrite", "keep"


def fold(batch: DataFrame, keys: list[str], order: list[str], policy: dict[str, str], default: str = COALESCE) -> DataFrame:
    """One row a key: of coalescing columns the last value that is not null in ``order``, of kept ones the first, of others the last row's."""
    at = F.struct(*order)

    def pick(c: str) -> Column:
        known = F.when(F.col(c).isNotNull(), at)
        how = policy.get(c, default)
        return {COALESCE: F.max_by(c, known), KEEP: F.min_by(c, known), OVERWRITE: F.max_by(c, at)}[how].alias(c)

    return batch.groupBy(*keys).agg(*[pick(c) for c in batch.columns if c not in keys and c not in order])


def merge(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], policy: dict[str, str] | None = None, default: str = COALESCE, stamp: str | None = None, touched: str = "updated_at") -> DataFrame:
    """``target`` after the upsert, with its own columns; ``order`` are the batch's columns that say which row is later.

    Columns coalesce (a null does not erase), overwrite or keep what is there, by ``policy``.
    Rows with a null in the key match nothing: the batch's are added, each for itself.
    ``stamp`` is written to ``touched`` of every row that the batch inserts or updates.
    """
    policy = policy or {}
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # Rows without a whole key get one of their own, another on either side, so that both are read once and nulls are spread.
    alone = lambda sign: F.when(whole, F.lit(0).cast("long")).otherwise(sign * (F.monotonically_increasing_id() + 1))
    new = fold(batch.withColumn("_alone", alone(1)), [*keys, "_alone"], order, policy, default).withColumn("_new", F.lit(True))
    names = [c for c in target.columns if c not in keys]
    n = new.select(*keys, "_alone", "_new", *[F.col(c).alias(f"_n_{c}") for c in names if c in new.columns])
    both = target.withColumn("_alone", alone(-1)).join(n, [*keys, "_alone"], "full_outer")

    def value(c: str) -> Column:
        if stamp is not None and c == touched:
            return F.when(F.col("_new"), F.lit(stamp).cast(target.schema[c].dataType)).otherwise(F.col(c))
        if f"_n_{c}" not in both.columns:
            return F.col(c)
        how, fresh = policy.get(c, default), F.col(f"_n_{c}").cast(target.schema[c].dataType)
        return {COALESCE: F.coalesce(fresh, F.col(c)), KEEP: F.coalesce(F.col(c), fresh), OVERWRITE: F.when(F.col("_new"), fresh).otherwise(F.col(c))}[how]

    return both.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) if c in keys else value(c).alias(c) for c in target.columns])


def prepare_reviews(batch: DataFrame, default_source: str = "AMAZON") -> DataFrame:
    """Source in capitals with a default, rating 0 to 5, votes from 0, title and body normalized, reviewer_ref derived where it is missing."""
    ref = F.coalesce(T.blank_to_null(F.col("reviewer_ref")), reviewer_ref(F.col("reviewer"), F.col("review_url")))
    return batch.withColumns({
        "source": F.upper(F.coalesce(T.blank_to_null(F.col("source")), F.lit(default_source))), "rating": F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce("rating", F.lit(0)))),
        "helpful_votes": F.greatest(F.lit(0), F.coalesce("helpful_votes", F.lit(0))), "title": T.normalize(F.col("title")), "body": T.normalize(F.col("body")), "reviewer_ref": ref,
    })


def upsert_reviews(target: DataFrame, batch: DataFrame, order: list[str], stamp: str) -> DataFrame:
    """Rows with an external id go by (product, source, external id), the others by (product, source, fingerprint); nulls never erase."""
    named = T.has_text(F.col("external_review_id"))
    first = merge(target, batch.where(named), ["product_id", "source", "external_review_id"], order, stamp=stamp)
    print_ = F.coalesce("fingerprint", fingerprint(F.col("title"), F.col("body"), F.col("reviewer_ref"), F.col("review_date")))
    others = batch.where(~named).withColumn("fingerprint", print_)
    return merge(first, others, ["product_id", "source", "fingerprint"], order, stamp=stamp)


def upsert_dev_reviews(target: DataFrame, batch: DataFrame, order: list[str], stamp: str) -> DataFrame:
    """By (source, source_review_id): the last row's values whole, but posted_at and collected_at keep what a null would erase."""
    return merge(target, batch, ["source", "source_review_id"], order, {"posted_at": COALESCE, "collected_at": COALESCE}, OVERWRITE, stamp)


def upsert_stats(target: DataFrame, batch: DataFrame, order: list[str], stamp: str) -> DataFrame:
    return merge(target, batch, ["product_id"], order, default=OVERWRITE, stamp=stamp)


def upsert_scores(target: DataFrame, batch: DataFrame, order: list[str], stamp: str) -> DataFrame:
    return merge(target, batch, ["product_id", "source"], order, default=OVERWRITE, stamp=stamp)


def estimate_upsert(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row (inserted, updated): updated counts different known ids, inserted the batch's other rows, repeats included."""
    ids = batch.where(F.col(key).isNotNull()).select(key)
    known = ids.distinct().join(existing.select(key), key, "left_semi").agg(F.count("*").alias("updated"))
    return ids.agg(F.count("*").alias("n")).crossJoin(known).select(F.greatest(F.col("n") - F.col("updated"), F.lit(0)).alias("inserted"), "updated")
