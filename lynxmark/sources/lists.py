"""Lists of addresses out of CSV and text files."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lynxmark.functions.text import java_trim
from lynxmark.functions.urls import is_http

# Column names that hold addresses, best first.
URL_HEADERS = ("url", "urls", "product_url", "canonical_url", "asin_url", "link", "href", "商品URL", "リンク")


def pick_url_header(names: list[str]) -> str:
    """The best known name, else the first that contains "url"; none is an error."""
    bare = {n.lstrip("﻿").strip().lower(): n for n in reversed(names)}
    for known in URL_HEADERS:
        if known.lower() in bare:
            return bare[known.lower()]
    for n in names:
        if "url" in n.lower():
            return n
    raise ValueError(f"no column of addresses among {names}")


@F.pandas_udf(StringType())
def _decoded(files: pd.Series) -> pd.Series:
    """UTF-8, with or without a byte order mark; what is not UTF-8 is MS932, which Spark's own readers refuse."""

    def one(data: bytes) -> str:
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError:
            return data.decode("cp932", "replace")

    return files.map(one)


def _addresses(text: str) -> list[str]:
    """The addresses' column of a CSV file, read by the file's own header; lines may lie within quotes."""
    rows = csv.reader(io.StringIO(text, newline=""))
    header = next(rows, None)
    if header is None:
        return []
    at = header.index(pick_url_header(header))
    return [r[at] if at < len(r) else "" for r in rows if r]


def read_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """(n, url): trimmed http addresses of CSV files with a header line each, every address where it comes first.

    Files go by path, each by its own header; n numbers all addresses in that order, from 1.
    """
    files = spark.read.format("binaryFile").load(path).select("path", _decoded("content").alias("text"))
    found = files.mapInPandas(lambda batches: (pd.DataFrame([(p, i, u) for p, t in zip(b["path"], b["text"], strict=True) for i, u in enumerate(_addresses(t))], columns=["path", "i", "url"]) for b in batches), "path string, i long, url string")
    rows = found.select("path", "i", java_trim(F.col("url")).alias("url")).where(is_http(F.col("url")))
    first = first_of_each(rows.withColumn("at", F.struct("path", "i")), "url", "at")
    files_before = first.groupBy("path").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("path")) - F.col("k"))  # a row for each file
    nth = F.row_number().over(Window.partitionBy("path").orderBy("i"))
    return first.join(files_before, "path").select((F.col("before") + nth).cast("long").alias("n"), "url").orderBy("n")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's first row."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth").orderBy(order)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(n, url): of each line that is neither blank nor a # comment, the first comma-separated field that is not blank."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), java_trim(F.regexp_replace("value", "^﻿", "")).alias("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return kept.select("n", F.element_at(F.filter(F.transform(F.split("line", ","), java_trim), lambda x: x != ""), 1).alias("url")).where("url IS NOT NULL")
