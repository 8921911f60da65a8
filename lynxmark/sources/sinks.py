"""Writers of reviews, snapshots, scores and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxmark.functions.urls import slug
from lynxmark.schemas import CSV_COLUMNS


def ndjson_lines(reviews: DataFrame, histograms: DataFrame) -> DataFrame:
    """(dataset, asin, seq, line): each product's histogram line first, then its reviews; nulls are left out of the JSON."""
    r, h = reviews, histograms
    place = [slug(F.col("dataset")).alias("dataset"), F.upper("asin").alias("asin")]
    heads = h.select(*place, F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("histogram").alias("type"), *[F.col(c) for c in h.columns if c not in ("path", "line_no")])).alias("line"))
    rows = r.select(*place, (F.lit(1) + F.monotonically_increasing_id()).alias("seq"), F.to_json(F.struct(*[F.col(c) for c in r.columns if c not in ("path", "line_no")])).alias("line"))
    return heads.unionByName(rows)


def write_ndjson(lines: DataFrame, path: str, mode: str = "append") -> None:
    """<path>/dataset=<d>/asin=<a>/part-*: a product's lines stay together and in order."""
    lines.repartition("dataset", "asin").sortWithinPartitions("dataset", "asin", "seq").select("dataset", "asin", "line").write.mode(mode).partitionBy("dataset", "asin").text(path)


def write_csv(reviews: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """The fifteen columns in their fixed order; missing ones are empty. Append without a header."""
    cols = [F.col(c) if c in reviews.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]
    reviews.select(*cols).write.mode(mode).option("header", header).option("escape", '"').csv(path)


def as_json_array(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, json): each key's rows as one pretty JSON array."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*[F.col(c) for c in df.columns if c != key]).alias("_r"))))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda x: x["_r"]), {"pretty": "true"}).alias("json"))


def append_rows(df: DataFrame, path: str) -> None:
    """For snapshots and logs: a row is never changed once written."""
    df.write.mode("append").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    features.select("product_id", "label", "dist_bias", "duplicates", "cnt").write.option("header", "true").csv(path)
