"""Reviews from a folder of NDJSON that grows, merged and scored as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lynxmark.operators.versions import VersionedTable
from lynxmark.sources import ndjson


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Streamed lines (path, modified, block, line): with the file's time and where in the file Spark's block begins, so that a
    line's place does not depend on how files are dealt to tasks."""
    df = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    meta = F.col("_metadata")
    return df.select(meta["file_path"].alias("path"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("block"), F.col("value").alias("line"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Reviews a product and day, from a stream with product_id and posted_at; days close when ``late`` has passed."""
    return events.withWatermark("posted_at", late).groupBy("product_id", F.window("posted_at", "1 day").alias("day")).agg(F.count("*").alias("n"))


def start(spark: SparkSession, path: str, checkpoint: str, table: VersionedTable, merge_batch: Callable[[DataFrame, DataFrame], DataFrame], rescore: Callable[[DataFrame, tuple[str, int]], None] | None = None):
    """Each batch's reviews are merged into the table, once; ``rescore`` gets the reviews of the products that it touched, whole,
    and the batch's name (the checkpoint and a number).

    ``merge_batch`` gets the table's rows of the partitions that the batch touches (all rows,
    if the table has none) and the batch with line_no, a number that grows with the file's
    time, its path and the place of the line in it, so that the last write is the same one
    however files are dealt to tasks. A batch that is run again after a failure is not merged
    again, for the table's ledger holds its name; ``rescore`` is called again, as it may not
    have come to its end, and is to write under the same name. Only touched partitions are
    written, beside other writers.
    """

    def one(batch: DataFrame, number: int) -> None:
        # Lines of a block come in the file's order; the rank of (time, path, block) goes before it.
        batch = batch.withColumn("offset", F.monotonically_increasing_id())
        blocks = batch.groupBy("modified", "path", "block").agg(F.min("offset").alias("first"))
        place = blocks.select("path", "block", "first", (F.row_number().over(Window.orderBy("modified", "path", "block")) - 1).alias("turn"))  # a row for each block of a trigger's files
        lines = batch.join(F.broadcast(place), ["path", "block"]).withColumn("line_no", F.col("turn") * F.lit(1 << 33) + F.col("offset") - F.col("first"))
        rows = ndjson.reviews(ndjson.parse(lines.select("path", "line", "line_no")))
        if rows.isEmpty():
            return
        touched = rows.select("asin").distinct()
        name = (checkpoint, number)
        table.update(touched, lambda old: merge_batch(old, rows), name)
        if rescore is not None:
            rescore(table.read(touched).join(touched, "asin", "left_semi"), name)

    return read_stream(spark, path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
