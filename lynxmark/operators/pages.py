"""Deep pages: a layout by ranges of the sort key with a directory of counts, and pages that go on after a row.

``offset(n)`` makes every task keep n rows. Here a table is written once in ranges of its
order, so that the directory tells which range holds a page, and only that one is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of a table at most: each is a task and a file, of which the driver is told.
RANGES = 1_000
#: A sort order: names of columns and whether they descend; the last ones are to make it unique. Nulls are least.
Order = list[tuple[str, bool]]


def sort_keys(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def after(df: DataFrame, order: Order, last: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows that come after the row with the values ``last`` of the order's columns; the first ones, if that is None."""
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (c, down), value in zip(order, last, strict=True):
            col = F.col(c)
            if value is None:
                further = F.lit(False) if down else col.isNotNull()
            else:
                further = (col < value) | col.isNull() if down else col > value
            beyond |= same & F.coalesce(further, F.lit(False))
            same &= col.eqNullSafe(F.lit(value))
        df = df.where(beyond)
    return df.orderBy(*sort_keys(order)).limit(size)


class PageDirectory:
    """A table in ranges of ``order``, some ``rows`` each, or more where that would make over RANGES, below ``path``: ``ranges/range=<n>`` and ``directory`` (range, begin, n)."""

    def __init__(self, spark: SparkSession, path: str, order: Order):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order
        self.directory = spark.read.parquet(f"{self.path}/directory")

    @classmethod
    def build(cls, df: DataFrame, path: str, order: Order, rows: int = 10_000) -> PageDirectory:
        """Writes the layout; one shuffle, and a count of what has been written."""
        spark, path = df.sparkSession, path.rstrip("/")
        many = max(1, min(RANGES, -(-df.count() // rows)))
        ranged = df.repartitionByRange(many, *sort_keys(order)).sortWithinPartitions(*sort_keys(order))
        ranged.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{path}/ranges")
        counts = spark.read.schema(_with_range(df)).parquet(f"{path}/ranges").groupBy("range").agg(F.count("*").alias("n"))
        begin = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
        counts.select("range", begin.alias("begin"), "n").coalesce(1).write.parquet(f"{path}/directory")
        return cls(spark, path, order)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def total(self) -> int:
        return self.directory.agg(F.sum("n")).first()[0] or 0

    def page(self, number: int, size: int) -> DataFrame:
        """The page, counted from 0: its own range is read, or the few that it reaches into."""
        first = max(0, number) * size
        held = self.directory.where((F.col("begin") < first + size) & (F.col("begin") + F.col("n") > first)).orderBy("range").collect()
        rows = self._rows().where(F.col("range").isin([r["range"] for r in held])).drop("range")
        return rows.orderBy(*sort_keys(self.order)).offset(first - held[0]["begin"] if held else 0).limit(size)

    def numbered(self, name: str = "ordinal") -> DataFrame:
        """All rows with their place in the whole order, from 1: ranges are numbered side by side."""
        place = F.row_number().over(Window.partitionBy("range").orderBy(*sort_keys(self.order)))
        own = self._rows().withColumn(name, place)
        return own.join(self.directory.select("range", "begin"), "range").withColumn(name, F.col("begin") + F.col(name)).drop("range", "begin")


def _with_range(df: DataFrame):
    from pyspark.sql.types import IntegerType, StructType

    return StructType([*df.schema.fields]).add("range", IntegerType())
