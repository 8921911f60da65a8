"""Versions of tables: layouts, several writers, batches that happen once, changes; and streams that stop half-way."""

import datetime
import json
import os
import threading
from functools import reduce

import pytest
from pyspark.sql import functions as F

from lynxmark.operators import merge
from lynxmark.operators.versions import Conflict, VersionedTable
from lynxmark.plans import streams
from lynxmark.streaming import intake, score_cache
from tests.oracle import difference

REVIEW = {"type": "review", "asin": "B000000001", "reviewId": "R1", "rating": 5, "title": "t", "body": "fine", "reviewDate": "2024-01-02"}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def kept(table):
    return sorted(map(tuple, table.read().collect()))


def test_a_table_is_opened_as_it_was_cut(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", 4)
    t.write(spark.range(40))
    for by, parts in (("id", 16), (None, 64), ("other", 4)):
        with pytest.raises(ValueError, match="is cut by"):
            VersionedTable(spark, str(tmp_path / "t"), by, parts)
    keys = spark.range(40)
    assert VersionedTable(spark, str(tmp_path / "t"), "id", 4).read(keys).count() == 40


def test_writers_of_other_partitions_both_win(spark, tmp_path):
    """From the same version; whoever commits second takes over what the first has written."""
    path = str(tmp_path / "t")
    VersionedTable(spark, path, "k", 16).write(rows(spark, *[(i, "old") for i in range(64)]))
    ready, failed = threading.Barrier(2), []

    def work(key):
        try:
            t = VersionedTable(spark, path, "k", 16)
            keys = rows(spark, (key, "")).select("k")
            base = t.version()
            old = t.read(keys, base)
            ready.wait()
            t.replace(old.withColumn("v", F.when(F.col("k") == key, f"new{key}").otherwise(F.col("v"))), keys, base=base)
        except BaseException as x:  # noqa: BLE001
            failed.append(x)

    t = VersionedTable(spark, path, "k", 16)
    part = {r.k: r.p for r in rows(spark, *[(i, "") for i in range(64)]).select("k", t._part("k").alias("p")).collect()}
    a, b = 0, next(k for k in part if part[k] != part[0])
    threads = [threading.Thread(target=work, args=(k,)) for k in (a, b)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and t.version() == 3
    assert kept(t) == sorted((i, f"new{i}" if i in (a, b) else "old") for i in range(64))


def test_writers_of_the_same_partition(spark, tmp_path):
    """``replace`` of what another has changed is refused; ``update`` makes its change again, so none is lost."""
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 2)
    t.write(rows(spark, (1, "0")))
    keys = rows(spark, (1, "")).select("k")
    t.replace(rows(spark, (1, "a")), keys, base=1)
    with pytest.raises(Conflict):
        t.replace(rows(spark, (1, "b")), keys, base=1)
    calls = []

    def longer(old):
        calls.append(1)
        if len(calls) == 1:  # another writer comes between
            t.replace(rows(spark, (1, "c")), keys)
        return old.withColumn("v", F.concat("v", F.lit("+")))

    t.update(keys, longer)
    assert kept(t) == [(1, "c+")] and len(calls) == 2

    failed = []

    def more():
        try:
            VersionedTable(spark, t.path, "k", 2).update(keys, lambda old: old.withColumn("v", F.concat("v", F.lit("x"))), tries=30)
        except BaseException as x:  # noqa: BLE001
            failed.append(x)

    threads = [threading.Thread(target=more) for _ in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and kept(t) == [(1, "c+xxxx")]


def test_a_batch_is_written_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    assert t.done("w") is None
    assert t.write(rows(spark, (1, "a")), ("w", 0)) == 1 and t.write(rows(spark, (2, "b")), ("w", 0)) == 1
    assert t.update(rows(spark, (1, "")).select("k"), lambda old: old.union(rows(spark, (1, "z"))), ("w", 1)) == 2
    assert t.update(rows(spark, (1, "")).select("k"), lambda old: old.union(rows(spark, (1, "z"))), ("w", 1)) == 2
    assert t.write(t.read(), ("other", 0)) == 3
    assert kept(t) == [(1, "a"), (1, "z")] and (t.done("w"), t.done("other")) == (1, 0)


def test_changes_read_only_what_differs(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 16)
    first = t.write(rows(spark, *[(i, "a") for i in range(50)], (None, "n")))
    keys = rows(spark, (3, ""), (99, "")).select("k")
    second = t.update(keys, lambda old: old.where("k != 4").withColumn("v", F.when(F.col("k") == 3, None).otherwise(F.col("v"))).union(rows(spark, (99, "new"))))
    gone = 4 if t.changed_parts(first, second) & {str(r[0]) for r in rows(spark, (4, "")).select(t._part("k")).collect()} else None
    got = sorted(((r.k, r.v, r.change) for r in t.changes(first, second, ["k"]).collect()), key=str)
    assert got == sorted([(3, None, "updated"), (99, "new", "inserted")] + ([(4, "a", "deleted")] if gone else []), key=str)
    assert 1 <= len(t.changed_parts(first, second)) <= 2
    files = {f.split("/")[-3] for f in t.changes(first, second, ["k"]).inputFiles()}
    assert files == {t._load(v).folders["0"].split("/")[0] for v in ()} | {p.split("/")[0] for v in (first, second) for k, p in t._load(v).folders.items() if k in t.changed_parts(first, second)}
    every = t.changes(first, second, ["k"], unchanged=True).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in every}["unchanged"] == 50 - (1 if gone else 0)
    assert t.changes(second, second, ["k"]).count() == 0


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t = VersionedTable(spark, str(tmp_path / "t"), "k", 4)
        t.write(spark.range(60_000).repartition(6).select((F.col("id") % 2).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert t.read().count() == 60_000 and max(len(list((tmp_path / "t" / f).glob("part-*"))) for f in t.current().folders.values()) > 2


def test_rows_are_written_where_they_are(spark, tmp_path):
    """Without ``gather`` nothing is shuffled for a write; the rows are the same, however a table is opened later."""
    df = spark.range(6000).repartition(6).select((F.col("id") % 50).alias("k"), F.col("id").cast("string").alias("v"))
    t = VersionedTable(spark, str(tmp_path / "t"), "k", 4, gather=False)
    t.write(df)
    files = {f.name.split("-")[1] for p in t.current().folders.values() for f in (tmp_path / "t" / p).glob("part-*")}
    assert len(files) == 6 and len(t.current().folders) == 4
    assert kept(t) == sorted(map(tuple, df.collect())) == kept(VersionedTable(spark, t.path, "k", 4))


def test_an_update_looks_for_its_partitions_once(spark, tmp_path, monkeypatch):
    """And so makes its keys once, which may be as dear as the batch."""
    t, calls = VersionedTable(spark, str(tmp_path / "t"), "k", 4), []
    with pytest.raises(FileNotFoundError):
        t.update(rows(spark, (1, "")).select("k"), lambda old: old)
    t.write(rows(spark, (1, "a"), (2, "b")))
    found = t._touched
    monkeypatch.setattr(t, "_touched", lambda keys: calls.append(1) or found(keys))
    t.update(rows(spark, (1, "")).select("k"), lambda old: old.withColumn("v", F.when(F.col("k") == 1, "z").otherwise(F.col("v"))))
    assert kept(t) == [(1, "z"), (2, "b")] and len(calls) == 1


def test_changes_of_reviews_with_one_id(spark, sf, tmp_path):
    """Line items without all of their numbers may share an id: the product is one that is there, as in the SQL."""
    for f in os.listdir(sf):
        if f != "lineitem.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    given = spark.read.parquet(f"{sf}/lineitem.parquet")
    first = given.limit(1).withColumn("l_linestatus", F.lit("F")).withColumn("l_extendedprice", F.lit(4.0))
    number = lambda **x: first.withColumns({f"l_{k}": F.lit(v).cast(given.schema[f"l_{k}"].dataType) for k, v in x.items()})
    odd = [number(orderkey=-1, linenumber=2, partkey=None, suppkey=3), number(orderkey=-1, linenumber=None, partkey=2, suppkey=3), number(orderkey=-2, linenumber=1, partkey=13, suppkey=3), number(orderkey=-2, linenumber=1, partkey=13, suppkey=3)]
    reduce(lambda a, b: a.union(b), odd, given).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert not difference(spark, str(tmp_path), streams.snk_version_changes, streams.SQL["snk_version_changes"])


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_a_stream_that_stops_between_commit_and_checkpoint(spark, tmp_path):
    """The batch runs again: the table does not change by it, and what follows it under its name is made once."""
    src, table, scores = tmp_path / "in", VersionedTable(spark, str(tmp_path / "t"), "asin", 4), VersionedTable(spark, str(tmp_path / "s"))
    table.write(spark.createDataFrame([], "asin string, reviewId string, times long"))
    scores.write(spark.createDataFrame([], "asin string, n long"))
    stop, merged = [True], []

    def combine(old, lines):
        merged.append(1)
        return old.union(lines.select("asin", "reviewId", F.lit(1).cast("long")))  # would show a second run

    def rescore(found, name):
        if stop and stop.pop():
            raise RuntimeError("stopped")
        scores.write(scores.read().union(found.groupBy("asin").agg(F.count("*").alias("n"))), name)

    put(src / "1.ndjson", json.dumps(REVIEW))
    with pytest.raises(Exception, match="stopped"):
        intake.start(spark, str(src), str(tmp_path / "ck"), table, combine, rescore).awaitTermination()
    assert table.read().count() == 1 and scores.read().count() == 0
    intake.start(spark, str(src), str(tmp_path / "ck"), table, combine, rescore).awaitTermination()
    assert table.read().count() == 1 and [r.n for r in scores.read().collect()] == [1] and len(merged) == 1
    put(src / "2.ndjson", json.dumps(REVIEW | {"reviewId": "R2"}))
    intake.start(spark, str(src), str(tmp_path / "ck"), table, combine, rescore).awaitTermination()
    assert table.read().count() == 2 and sorted(r.n for r in scores.read().collect()) == [1, 2] and len(merged) == 2
    assert merge.COALESCE  # the merge itself is tested elsewhere


def test_scores_live_ten_minutes(spark, tmp_path):
    """Hits, misses and fresh scores over several starts of the stream; a life's end is told once time has passed it."""
    start, src = datetime.datetime(2024, 1, 1), tmp_path / "in"
    schema = "product_id string, id long, at timestamp, score double"
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    score_cache.use_state_store(spark)

    def run(*given):
        spark.createDataFrame(list(given), schema).coalesce(1).write.mode("append").parquet(str(src))
        told = score_cache.answers(spark.readStream.schema(schema).parquet(str(src)))
        told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(told.schema).parquet(str(tmp_path / "out")).collect()
        return {(r.product_id, r.id, r.outcome): r.score for r in out}

    try:
        seen = run(("a", 1, at(0), None), ("a", 2, at(1), None), ("b", 3, at(2), 7.0), ("b", 4, at(2), None))
        assert seen == {("a", 1, "miss"): None, ("a", 2, "hit"): None, ("b", 3, "fresh"): 7.0, ("b", 4, "hit"): 7.0}
        seen = run(("a", 5, at(3), 40.0), ("a", 6, at(12.9), None), ("b", 7, at(11.9), None))  # the state has outlived the first start
        assert seen["a", 6, "hit"] == 40.0 and seen["b", 7, "hit"] == 7.0
        seen = run(("a", 8, at(13), None), ("b", 9, at(40), None))
        assert ("a", 8, "miss") in seen and ("b", 9, "miss") in seen
        seen = run(("b", 10, at(41), None))
        assert ("a", None, "expired") in seen and ("b", 10, "hit") in seen
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
