"""Verdicts against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxmark.schemas import VERDICTS

LABEL_OF_FOLDER = {"sakura": "SAKURA", "probably_sakura": "LIKELY", "probably_not_sakura": "UNLIKELY", "not_sakura": "GENUINE"}


def confusion(predictions: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """(label, verdict, n) of the pairs that occur."""
    return predictions.groupBy(label, verdict).agg(F.count("*").alias("n"))


def dense_confusion(predictions: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """All sixteen cells, zeros too."""
    spine = predictions.sparkSession.createDataFrame([(a, b) for a in VERDICTS for b in VERDICTS], f"{label} string, {verdict} string")
    return spine.join(confusion(predictions, label, verdict), [label, verdict], "left").select(label, verdict, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy(predictions: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """One row; null without predictions."""
    hits, n = F.count_if(F.col(label) == F.col(verdict)), F.count("*")
    return predictions.agg(n.alias("samples"), hits.alias("hits"), F.when(n > 0, hits / n).alias("accuracy"))


def recall(predictions: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """(label, n, hits, recall); labels without samples have no row."""
    hits, n = F.count_if(F.col(label) == F.col(verdict)), F.count("*")
    return predictions.groupBy(label).agg(n.alias("n"), hits.alias("hits"), (hits / n).alias("recall"))


def derive_thresholds(features: DataFrame) -> DataFrame:
    """One row: 80 % of the largest dist_bias and half of the largest duplicates, rounded to even, 100 at most."""
    top = lambda c, part: F.least(F.lit(100.0), F.bround(F.coalesce(F.max(c), F.lit(0)).cast("double") * part)).cast("int")
    return features.agg(top("dist_bias", 0.80).alias("dist_bias_sakura"), top("duplicates", 0.50).alias("duplicates_sakura"))
