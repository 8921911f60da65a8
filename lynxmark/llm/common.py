"""Helpers shared by the corpus operators: scratch storage, row keys, components of a graph."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is cut into words at ASCII white space only: a word is a run of ``[^\x20\x09-\x0D]``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors see.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset and the master is a local one, as in tests, a temporary folder is taken; on a
    cluster each executor would write to its own, so there an unset folder is an error. It is
    removed when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='lynxmark-')}"
        _scratch[app] = f"{base.rstrip('/')}/lynxmark-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def release(spark: SparkSession) -> None:
    """Remove what the operators have written to the shared folder; results that have not been saved read from it."""
    if path := _scratch.pop(spark.sparkContext.applicationId, None):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM has gone first: nothing is left to call
        pass


def materialize(df: DataFrame, name: str = "step", batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Lost executors cost nothing afterwards: the table is read again from shared storage.
    ``batch``: the most rows that a Python worker gets at a time while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    with batches_of(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts go to Python workers so many at a time, or a few MB.
TEXTS, BATCH_BYTES = 200, 4 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs that run inside send ``rows`` rows or ``BATCH_BYTES`` at most to a Python worker at a time (a larger row by
    itself); afterwards the session's own limits hold again. None changes nothing."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in names}
    if rows:
        for k, most in names.items():
            if not 0 < int(before[k].rstrip("b")) <= most:
                spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """Number the rows; stable only once materialized."""
    return df.withColumn(name, F.monotonically_increasing_id())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with so many underscores behind it that no column of ``df`` has it, in capitals or not."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_of(text: Column, mod: int) -> Column:
    """crc32 of a text in UTF-8, modulo ``mod``; null gives null."""
    return F.pmod(F.crc32(text.cast("binary")), F.lit(mod))


def crc_fold(doc_id, mod: int):
    """crc32 of the id written as decimal text, modulo ``mod``; null ids give null."""
    return crc_of(doc_id.cast("string"), mod)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", batch: int | None = None) -> DataFrame:
    """Components of an undirected graph of bigint nodes: rows (node, root), root < node.

    Alternating large-star and small-star rounds. Each round is two aggregations with
    map-side combining and two equi-joins against one row per node, so a hub with a third
    of the edges is split by the skew-join rule and never meets in one task. Every round is
    written to the shared folder. Roots and nodes without links have no row; links of a
    node to itself and null ends are ignored; no edges give no rows. ``batch`` is that of
    ``materialize`` while ``edges`` are computed.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = materialize(e, "links", batch), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(least).distinct(), "links")


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Terms of an array that running() takes in one go.
BLOCK = 64


def running(values: Column, step, first: int = 0) -> Column:
    """What ``step`` makes of ``first`` and all terms (int) before each one; ``step(a, first)`` must be ``a`` for sums and maxima
    alike. In blocks, so that n terms cost some n * BLOCK steps."""

    def run(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda so_far, x: F.struct(step(so_far["at"], x).alias("at"), F.concat(so_far["out"], F.array(so_far["at"])).alias("out")))["out"]

    def blocks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))
        whole = lambda parts: run(F.transform(parts, lambda p: F.aggregate(p, F.lit(first), step)), F.lit(first))
        return let(cut, lambda parts: F.flatten(F.zip_with(parts, whole(parts), run)))

    return let(values, blocks)
