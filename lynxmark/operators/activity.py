"""How many reviews an author has written lately, as of each review.

A count over a moving span is a running sum: a review adds one at its time and takes it away
a span later. The sums are made in two steps, of slots of some minutes and inside a slot, so
that no task gets all reviews of a busy author.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY, SLOT = 86_400, 600


def with_recent_count(reviews: DataFrame, who: str = "author", when: str = "created_at", span: int = DAY, slot: int = SLOT, name: str = "reviews_last_24h") -> DataFrame:
    """Adds the number of reviews by the same author in the ``span`` seconds up to each review, that and all of the same moment
    included; 0 where author or time are null. ``slot``: seconds whose reviews by one author meet in a task."""
    micros = F.unix_micros(F.col(when).cast("timestamp"))
    timed = reviews.withColumn("_at", micros)
    moments = timed.where(F.col(who).isNotNull() & F.col("_at").isNotNull()).groupBy(F.col(who).alias("_who"), F.col("_at")).agg(F.count("*").alias("n"))
    leaving = F.struct((F.col("_at") + span * 1_000_000 + 1).alias("at"), (-F.col("n")).alias("n"), F.lit(False).alias("own"))
    arriving = F.struct(F.col("_at").alias("at"), F.col("n").alias("n"), F.lit(True).alias("own"))
    steps = moments.select("_who", F.inline(F.array(arriving, leaving))).withColumn("slot", F.floor(F.col("at") / (slot * 1_000_000)))
    slots = steps.groupBy("_who", "slot").agg(F.sum("n").alias("n"))
    before = slots.select("_who", "slot", F.coalesce(F.sum("n").over(Window.partitionBy("_who").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = steps.withColumn("inside", F.sum("n").over(Window.partitionBy("_who", "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))).where("own")
    counts = inside.join(before, ["_who", "slot"]).select(F.col("_who").alias(who), F.col("at").alias("_at"), (F.col("before") + F.col("inside")).alias(name))
    return timed.join(counts, [who, "_at"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("int")).select(*reviews.columns, name)


def with_account_age(reviews: DataFrame, who: str = "author", when: str = "created_at", name: str = "account_age_days") -> DataFrame:
    """Adds whole days since the author's first review; null where author or time are."""
    first = reviews.where(F.col(who).isNotNull()).groupBy(who).agg(F.min(when).alias("_first"))
    return reviews.join(first, who, "left").withColumn(name, F.datediff(when, "_first")).select(*reviews.columns, name)
