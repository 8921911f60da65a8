"""The per-review rule engine: eleven rules over a reviewer's and a review's context.

A rule is registered under its flag with functions that give its trigger, severity and
evidence as columns; its penalty is severity times weight, of triggered rules only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.operators.scoring import rank_assign

# A context's fields where nothing is known.
CONTEXT = {
    "review_text": "", "star_rating": 0, "verified_purchase": False, "anonymous": False, "verified_rate": 1.0, "account_age_days": 365, "reviews_last_24h": 0,
    "star_variance": 0.0, "vendor_concentration": 0.0, "noise_ratio": 0.0, "specificity": 1.0, "unnatural_score": 0.0, "text_similarity": 0.0,
}


@dataclass(frozen=True)
class Limits:
    text_similarity: float = 0.8
    unnatural_score: float = 0.7
    star_variance: float = 0.4
    reviews_per_day: int = 10
    noise_ratio: float = 0.5
    verified_rate: float = 0.5
    account_days: int = 30
    burst_account_days: int = 7
    burst_reviews: int = 3
    vendor_concentration: float = 0.8
    specificity: float = 0.3


@dataclass(frozen=True)
class Profile:
    limits: Limits = Limits()
    weights: dict[str, float] = field(default_factory=lambda: {
        "DUPLICATE_TEXT": 15, "UNNATURAL_LANGUAGE": 5, "STAR_DISTRIBUTION": 5, "EXCESSIVE_FIVE_STAR": 5, "SURGE_ACTIVITY": 10, "NOISE": 3,
        "LOW_VERIFIED_RATE": 5, "ANONYMOUS_REVIEWER": 5, "NEW_ACCOUNT_BURST": 10, "SAME_VENDOR_CONCENTRATION": 5, "LOW_SPECIFICITY": 5,
    })

    def with_weight(self, flag: str, weight: float) -> Profile:
        if weight < 0:
            raise ValueError("a weight cannot be negative")
        return Profile(self.limits, self.weights | {flag: weight})


@dataclass(frozen=True)
class Rule:
    flag: str
    trigger: Callable[[Limits], Column]
    severity: Callable[[Limits], Column]
    evidence: Callable[[Limits], Column]


def _over(flag: str, column: str, limit: str, name: str) -> Rule:
    """Above a limit in (0, 1): severity is the part of the way from there to 1."""
    return Rule(flag, lambda p: F.col(column) > getattr(p, limit), lambda p: (F.col(column) - getattr(p, limit)) / (1.0 - getattr(p, limit)), lambda p: F.format_string(f"{name}=%.2f", F.col(column).cast("double")))


def _under(flag: str, column: str, limit: str, name: str) -> Rule:
    return Rule(flag, lambda p: F.col(column) < getattr(p, limit), lambda p: (getattr(p, limit) - F.col(column)) / getattr(p, limit), lambda p: F.format_string(f"{name}=%.2f", F.col(column).cast("double")))


def _daily(p: Limits) -> Column:
    return F.format_string("reviews24h=%d", F.col("reviews_last_24h"))


_R24 = "reviews_last_24h"
CATALOG = [
    _over("DUPLICATE_TEXT", "text_similarity", "text_similarity", "similarity"),
    _over("UNNATURAL_LANGUAGE", "unnatural_score", "unnatural_score", "unnatural"),
    _over("STAR_DISTRIBUTION", "star_variance", "star_variance", "variance"),
    Rule("EXCESSIVE_FIVE_STAR", lambda p: (F.col("star_rating") >= 5) & (F.col(_R24) > p.reviews_per_day * 0.6), lambda p: (F.col(_R24) - int(p.reviews_per_day * 0.6)) / (p.reviews_per_day * 0.4), _daily),
    Rule("SURGE_ACTIVITY", lambda p: F.col(_R24) > p.reviews_per_day, lambda p: (F.col(_R24) - p.reviews_per_day) / float(p.reviews_per_day), _daily),
    _over("NOISE", "noise_ratio", "noise_ratio", "noise"),
    _under("LOW_VERIFIED_RATE", "verified_rate", "verified_rate", "verified"),
    Rule("ANONYMOUS_REVIEWER", lambda p: F.col("anonymous") & (F.col("account_age_days") < p.account_days), lambda p: (p.account_days - F.col("account_age_days")) / float(p.account_days), lambda p: F.format_string("accountAgeDays=%d", F.col("account_age_days"))),
    Rule("NEW_ACCOUNT_BURST", lambda p: (F.col("account_age_days") < p.burst_account_days) & (F.col(_R24) > p.burst_reviews), lambda p: (F.col(_R24) - p.burst_reviews) / float(p.burst_reviews), _daily),
    _over("SAME_VENDOR_CONCENTRATION", "vendor_concentration", "vendor_concentration", "concentration"),
    _under("LOW_SPECIFICITY", "specificity", "specificity", "specificity"),
]


def with_context_defaults(df: DataFrame) -> DataFrame:
    """Context columns that are missing or null take their defaults; other columns stay."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in CONTEXT.items()})


def score_rules(contexts: DataFrame, profile: Profile | None = None, catalog: list[Rule] | None = None) -> DataFrame:
    """Adds penalty_<FLAG> for each rule, total_penalty, score (100 minus it, rounded, 0 to 100), rank and ``triggered``:
    the triggered rules' (flag, penalty, evidence) in catalog order. Penalties that are no number or below 0 count 0."""
    profile, catalog = profile or Profile(), catalog or CATALOG
    df = with_context_defaults(contexts)
    penalties = {}
    for r in catalog:
        raw = (r.severity(profile.limits) * float(profile.weights[r.flag])).cast("double")
        sound = F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), raw))
        penalties[r.flag] = F.when(r.trigger(profile.limits), sound)
    df = df.withColumns({f"penalty_{k}": p for k, p in penalties.items()})
    total = sum((F.coalesce(f"penalty_{k}", F.lit(0.0)) for k in penalties), F.lit(0.0))
    hits = [F.when(F.col(f"penalty_{r.flag}").isNotNull(), F.struct(F.lit(r.flag).alias("flag"), F.col(f"penalty_{r.flag}").alias("penalty"), r.evidence(profile.limits).alias("evidence"))) for r in catalog]
    df = df.withColumns({"total_penalty": total, "triggered": F.array_compact(F.array(*hits))})
    df = df.withColumn("score", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("total_penalty"))) + 0.5).cast("int"))
    return df.withColumn("rank", rank_assign(F.col("score")))


def evidence_lines(triggered: Column) -> Column:
    """One line for each triggered rule; without evidence, its flag."""
    return F.transform(triggered, lambda t: F.when(F.coalesce(t["evidence"].rlike(r"\S"), F.lit(False)), t["evidence"]).otherwise(t["flag"]))
