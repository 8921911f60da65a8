"""Tables at rest: Parquet folders, or a database that takes part of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Filters and columns asked of the result reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt over tasks of some ``rows`` each, and no fewer than there are cores: tables are read by their bytes, so that
    the rows of a small file are one task's, however much is to be made of each."""
    many = -(-df.count() // rows)
    return df.repartition(max(many, df.sparkSession.sparkContext.defaultParallelism))


def read_jdbc(spark: SparkSession, url: str, table: str, split: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of the numeric or time column ``split``; without one, in a single task.
    Filters, column lists and limits are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, pushDownPredicate="true", pushDownAggregate="true", pushDownLimit="true", **options)
    if split:
        if bounds is None:
            raise ValueError("a split column needs bounds")
        reader = reader.options(partitionColumn=split, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def key_bounds(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> list:
    """Values of ``key`` that cut the table into ``parts`` of as many rows each, found by the database in its key's order."""
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()
    rows = ask(f"SELECT COUNT({key}) AS N FROM {table}")[0][0]
    places = sorted({rows * i // parts for i in range(1, parts)} - {0})
    found = [ask(f"SELECT {key} FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} OFFSET {n} ROWS FETCH NEXT 1 ROWS ONLY")[0][0] for n in places]
    return list(dict.fromkeys(found))


def read_jdbc_by_key(spark: SparkSession, url: str, table: str, key: str, parts: int = 64, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of the text column ``key`` (an id that is no number): the database tells the
    bounds, and each task asks for the rows of its range; rows without a key come with the last. Equal keys stay together."""
    told = lambda v: "'" + str(v).replace("'", "''") + "'"
    bounds = key_bounds(spark, url, table, key, parts, **options)
    ranges = [f"{key} >= {told(a)} AND {key} < {told(b)}" for a, b in zip(bounds, bounds[1:], strict=False)]
    where = [f"{key} < {told(bounds[0])}", *ranges, f"{key} >= {told(bounds[-1])} OR {key} IS NULL"] if bounds else ["1 = 1"]
    given = {"fetchsize": str(fetch), "pushDownPredicate": "true", **options}
    return spark.read.jdbc(url, table, predicates=where, properties=given)
