"""Search for parts of texts by an inverted index of trigrams: postings say where a part may be, the text whether it is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case; none for shorter ones and null."""
    low = F.lower(text)
    last = F.length(low) - 2
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(3)))
    return F.coalesce(F.when(last >= 1, F.array_distinct(runs)), F.array().cast("array<string>"))


def fixed_parts(pattern: str) -> list[str]:
    """What any match of a LIKE pattern contains; none where a backslash makes wild cards uncertain."""
    return [] if "\\" in pattern else [x for x in re.split("[%_]", pattern.lower()) if len(x) >= 3]


class TrigramIndex:
    """Postings (gram, field, key) of some text fields of a table, below ``path`` in folders by the gram's hash, in each
    ordered by gram, so that a search opens few row groups of few folders. A frequent gram's postings are any number of files."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, key: str, fields: list[str]) -> TrigramIndex:
        each = F.array(*[F.struct(F.lit(f).alias("field"), trigrams(F.col(f)).alias("grams")) for f in fields])
        postings = rows.select(F.col(key).alias("key"), F.inline(each)).select("key", "field", F.explode("grams").alias("gram"))
        dealt = postings.withColumn("bucket", self._bucket(F.col("gram"))).hint("rebalance", F.col("bucket"))
        dealt.sortWithinPartitions("bucket", "gram", "field", "key").write.partitionBy("bucket").parquet(self.path)
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def like(self, rows: DataFrame, key: str, field: str, pattern: str) -> DataFrame:
        """The rows whose ``field`` holds ``pattern`` somewhere, capitals or not; its % and _ are wild. Patterns without three
        fixed characters in a row are sought in all rows."""
        match = F.lower(field).like(f"%{pattern.lower()}%")
        grams = sorted({x[i : i + 3] for x in fixed_parts(pattern) for i in range(len(x) - 2)})
        if not grams:
            return rows.where(match)
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket(F.col("gram"))).distinct().collect()]
        held = self.postings().where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & (F.col("field") == field))
        keys = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(F.col("key").alias(key))
        return rows.join(keys, key, "left_semi").where(match)

    def contain(self, rows: DataFrame, key: str, field: str, asked: DataFrame) -> DataFrame:
        """(q, ``key``): for each different text ``q`` of ``asked``, three characters or more, the rows whose ``field`` contains
        it, capitals or not. Queries meet the postings by gram: no query reads the rows, and no row meets a query that
        it shares not all grams with."""
        wanted = asked.select("q").distinct().withColumn("grams", trigrams(F.col("q"))).withColumn("need", F.size("grams")).where("need > 0")
        grams = wanted.select("q", "need", F.explode("grams").alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        met = grams.join(self.postings().where(F.col("field") == field), ["bucket", "gram"]).groupBy("q", "need", "key").agg(F.count("*").alias("n")).where("n = need")
        texts = rows.select(F.col(key).alias("key"), F.col(field).alias("text"))
        return met.join(texts, "key").where(F.contains(F.lower("text"), F.lower("q"))).select("q", F.col("key").alias(key))
