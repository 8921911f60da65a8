"""Scores, ranks, flags and verdicts from features, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.config import Cutoffs, Thresholds
from lynxmark.functions.numbers import clamp, clamp01, half_up, to_score

FLAGS = {"dist_bias": "ATTN_DISTRIBUTION", "duplicates": "ATTN_DUPLICATE", "surge": "ATTN_SURGE", "noise": "ATTN_NOISE"}


def verdict(dist: Column, dup: Column, c: Cutoffs) -> Column:
    """The first that holds, in this order."""
    return (
        F.when((dist >= c.dist_sakura) & (dup >= c.dup_sakura), "SAKURA")
        .when((dist >= c.dist_likely) | (dup >= c.dup_likely), "LIKELY")
        .when(dist >= c.dist_unlikely, "UNLIKELY")
        .otherwise("GENUINE")
    )


def ratio_verdict(dist: Column, dup: Column, c: Cutoffs) -> Column:
    return verdict(clamp01(dist), clamp01(dup), c)


def rank_risk(score: Column) -> Column:
    """Of a risk with fractions: below 35 A, below 65 B."""
    return F.when(score < 35.0, "A").when(score < 65.0, "B").otherwise("C")


def rank_assign(score: Column, good_is_high: bool = False) -> Column:
    """Of a whole number, clamped to 0 to 100: up to 34 A, up to 64 B. A is the low end, whatever the score means, unless ``good_is_high``."""
    s = clamp(score, 0, 100)
    s = 100 - s if good_is_high else s
    return F.when(s <= 34, "A").when(s <= 64, "B").otherwise("C")


def _points(value: Column, weight: float) -> Column:
    return F.floor(clamp01(value / 100.0) * weight * 100.0 + 0.5).cast("int")


def score_site(features: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Risk 0 (good) to 100, its display complement, rank, flags, verdict, and each rule's points."""
    t = t or Thresholds()
    points = {k: _points(F.col(k), t.weights[k]) for k in FLAGS}
    risk = half_up(clamp(sum(points.values()).cast("double"), 0.0, 100.0), 1)
    flags = F.array_compact(F.array(*[F.when(F.col(k) >= t.feature_percent[k].warn, name) for k, name in FLAGS.items()]))
    out = features.withColumns({f"points_{k}": p for k, p in points.items()}).withColumn("risk", risk)
    return out.withColumns({"display": F.greatest(F.lit(0.0), 100.0 - F.col("risk")), "rank": rank_risk(F.col("risk")), "flags": flags, "verdict": verdict(F.col("dist_bias"), F.col("duplicates"), t.percent)})


def site_rules(scored: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Adds ``rules``: an array with each feature's value, band, weight, points and the counts behind it."""
    t = t or Thresholds()
    extra = {
        "dist_bias": ("five_star_count", "five_star", "total_reviews", "total_reviews"), "duplicates": ("max_cluster", "max_duplicate_cluster"),
        "surge": ("max_day_reviews", "max_day_reviews", "days_tracked", "day_buckets"), "noise": ("url_hits", "url_hits", "emoji_hits", "emoji_hits", "symbol_runs", "symbol_runs", "short_reviews", "short_reviews"),
    }

    def one(k: str) -> Column:
        names = extra[k]
        pairs = [x for i in range(0, len(names), 2) for x in (F.lit(names[i]), F.col(names[i + 1]).cast("double"))]
        if k == "duplicates":
            pairs += [F.lit("cluster_ratio"), half_up(F.col("duplicates"), 2)]
        if k == "surge":
            pairs += [F.lit("avg_reviews_per_day"), half_up(F.col("avg_per_day"), 2)]
        b = t.feature_percent[k]
        return F.struct(F.lit(k).alias("id"), F.col(k).alias("value"), F.lit(float(b.warn)).alias("warn"), F.lit(float(b.crit)).alias("crit"), F.lit(t.weights[k]).alias("weight"), F.col(f"points_{k}").alias("points"), F.create_map(*pairs).alias("extra"))

    return scored.withColumn("rules", F.array(*map(one, FLAGS)))


def site_metrics() -> Column:
    r = lambda c: half_up(F.col(c), 2)
    return F.struct(
        "total_reviews", r("dist_bias").alias("dist_bias"), r("duplicates").alias("duplicate_ratio"), r("surge").alias("surge_ratio"), r("noise").alias("noise_ratio"),
        "max_duplicate_cluster", "max_day_reviews", "day_buckets", r("avg_per_day").alias("avg_reviews_per_day"),
    )


def amazon_metrics() -> Column:
    r = lambda c: half_up(F.col(c), 2).alias(c)
    return F.struct("total_reviews", r("dist_bias"), r("duplicate_rate"), r("surge_ratio"), r("noise_ratio"), "recent_reviews", "window_days")


def score_amazon(features: DataFrame, t: Thresholds | None = None, good_is_high: bool = False) -> DataFrame:
    """100 minus the penalties. All penalties count, flags and details only from the warning value on. The surge ratio is
    held against bounds for a z-score, which it never reaches."""
    t = t or Thresholds()
    parts = (("dist_bias", "dist_bias", t.dist_bias, "dist_bias"), ("duplicate_rate", "duplicates", t.duplicates, "duplicates"), ("surge_ratio", "surge", t.surge_z, "surge_z"), ("noise_ratio", "noise", t.noise, "noise"))
    penalty, flags, rules = {}, [], []
    for column, weight, band, name in parts:
        v, w = F.col(column), t.weights[weight]
        part = v
        if name == "surge_z":
            part = (v - band.warn) / (band.crit - band.warn) if band.crit > band.warn else F.when(v >= band.crit, 1.0).otherwise(0.0)
        penalty[weight] = clamp01(part) * 100.0 * w
        over = v >= band.warn
        flags.append(F.when(over, FLAGS[weight]))
        rules.append(F.when(over, F.struct(F.lit(f"{name}>=warn").alias("rule"), v.alias("value"), F.lit(band.warn).alias("warn"), F.lit(w).alias("weight"), F.floor(penalty[weight] + 0.5).cast("int").alias("penalty"))))
    total = F.floor(F.least(F.lit(100.0), sum(penalty.values())) + 0.5).cast("int")
    out = features.withColumns({f"penalty_{k}": p for k, p in penalty.items()} | {"total_penalty": total, "score": F.greatest(F.lit(0), 100 - total)})
    return out.withColumns({"rank": rank_assign(F.col("score"), good_is_high), "flags": F.array_compact(F.array(*flags)), "rules": F.array_compact(F.array(*rules)), "verdict": ratio_verdict(F.col("dist_bias"), F.col("duplicate_rate"), t.ratio)})


def score_eval(features: DataFrame, t: Thresholds | None = None) -> DataFrame:
    return features.withColumn("verdict", verdict(F.col("dist_bias"), F.col("duplicates"), (t or Thresholds()).percent))


def with_default_site_score(products: DataFrame, scores: DataFrame, product: str = "product_id") -> DataFrame:
    """Every product has a SITE score: without reviews risk 0, display 100, A, GENUINE."""
    found = scores.select(product, "risk", "display", "rank", "verdict")
    filled = {"risk": F.lit(0.0), "display": F.lit(100.0), "rank": F.lit("A"), "verdict": F.lit("GENUINE")}
    return products.select(product).join(found, product, "left").select(product, *[F.coalesce(k, v).alias(k) for k, v in filled.items()])


def snapshot_block(average: Column) -> Column:
    """The page's own average as 0 to 100, ranked like a risk, so that five stars are C; null without an average."""
    s = to_score(average)
    return F.when(s.isNotNull(), F.struct(s.alias("score"), s.alias("displayScore"), rank_risk(s).alias("rank")))


def score_response(products: DataFrame, site: DataFrame, amazon: DataFrame, product: str = "product_id") -> DataFrame:
    """Both blocks by product, the overall one from SITE, else from the page; its parts again on top."""
    s = site.select(product, F.struct("risk", "display", "rank", "verdict", "flags").alias("site"))
    a = amazon.select(product, F.col("block").alias("amazon"))
    both = products.select(product).join(s, product, "left").join(a, product, "left")
    return both.select(product, "site", "amazon", F.coalesce("site.risk", "amazon.score").alias("score"), F.coalesce("site.display", "amazon.displayScore").alias("display_score"), F.coalesce("site.rank", "amazon.rank").alias("rank"), F.col("site.verdict").alias("verdict"), F.col("site.flags").alias("flags"))
