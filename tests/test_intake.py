"""Files in, tables merged, files out."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lynxmark import schemas
from lynxmark.operators import evaluation, lifecycle, merge, serving, versions
from lynxmark.sources import derby, html, lists, ndjson, sinks, tables
from lynxmark.streaming import intake


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines), encoding="utf-8")


REVIEW = {"dataset": "adhoc", "asin": "b000000001", "url": "https://x/1", "reviewId": "R1", "rating": 5.0, "body": "fine"}


@pytest.fixture
def corpus(tmp_path):
    write(tmp_path / "sakura/B000000001/B000000001__a.ndjson", json.dumps({"type": " Histogram ", "asin": "B000000001", "rating_average": 4.5}), json.dumps(REVIEW), "", "not json", json.dumps(REVIEW | {"rating": "5"}), json.dumps(REVIEW | {"url": None}), "[1]")
    write(tmp_path / "not_sakura/B000000002/x.NDJSON", json.dumps(REVIEW | {"asin": "B000000009"}))
    write(tmp_path / "not_sakura/B000000002/x.txt", "{}")
    return str(tmp_path)


def test_files_and_counters(spark, corpus):
    files = ndjson.list_files(spark, [corpus]).collect()
    assert [f.name for f in files] == ["x.NDJSON", "B000000001__a.ndjson"] and all(f.size > 0 and f.modified for f in files)
    assert ndjson.read_lines(spark, [corpus], "b000000002").count() == 1
    parsed = ndjson.parse(ndjson.read_lines(spark, [corpus]))
    products = spark.createDataFrame([("B000000001", "p1")], "asin string, product_id string")
    taken = ndjson.accepted(ndjson.reviews(parsed), products)
    assert [(r.asin, r.rating, r.product_id) for r in taken.collect()] == [("B000000001", 5, "p1")]
    counts = {r.path.split("/")[-1]: (r.total, r.histogram, r.attempted, r.succeeded, r.skipped) for r in ndjson.counters(parsed, taken).collect()}
    assert counts == {"B000000001__a.ndjson": (6, 1, 3, 1, 4), "x.NDJSON": (1, 0, 1, 0, 1)}
    assert ndjson.intake_totals(ndjson.counters(parsed, taken)).first().skipped == 5
    assert ndjson.reviews(parsed, strict=False).where("rating = 5").count() == 4
    labelled = ndjson.labelled(spark, corpus, evaluation.LABEL_OF_FOLDER)
    assert {(r.folder, r.label) for r in labelled.collect()} == {("sakura", "SAKURA"), ("not_sakura", "GENUINE")}


def test_coercions(spark):
    values = ['"1"', "1", "2.5", "true", '"true"', '" x "', "null", "1e999", '""']
    df = ndjson.parse(spark.createDataFrame([("f", i, f'{{"v":{v}}}') for i, v in enumerate(values)], "path string, line_no long, line string"))
    got = df.orderBy("line_no").select(ndjson.strict_double("v"), ndjson.strict_int("v"), ndjson.lenient_double("v"), ndjson.lenient_int("v"), ndjson.lenient_bool("v"), ndjson.text_field("v")).collect()
    assert tuple(got[0]) == (None, 1, 1.0, 1, True, "1")
    assert tuple(got[1]) == (1.0, 1, 1.0, 1, True, "1")
    assert tuple(got[2]) == (2.5, 2, 2.5, 3, True, "2.5")
    assert tuple(got[3])[:5] == (None, None, None, None, True)
    assert got[4][4] is True and got[5][4] is False and got[5][5] == "x"
    assert tuple(got[6]) == (None,) * 6 and tuple(got[8]) == (None,) * 6


def test_url_lists(spark, tmp_path):
    write(tmp_path / "a.csv", "﻿name,商品URL", "x, https://a/1 ", "y,ftp://b", "z,https://a/1", "w,HTTP://c")
    assert [r.url for r in lists.read_url_csv(spark, str(tmp_path / "a.csv")).collect()] == ["https://a/1", "HTTP://c"]
    (tmp_path / "b.csv").write_bytes("名前,リンク\n品,https://d\n".encode("cp932"))
    assert [r.url for r in lists.read_url_csv(spark, str(tmp_path / "b.csv")).collect()] == ["https://d"]
    both = tmp_path / "both"
    write(both / "1.csv", "x,url", '"two\nlines, quoted",https://a', "y,https://b")
    write(both / "2.csv", "link,x", "https://b,1", "https://c,2", "ftp://d")
    (both / "3.csv").write_text("")
    assert [tuple(r) for r in lists.read_url_csv(spark, str(both)).collect()] == [(1, "https://a"), (2, "https://b"), (3, "https://c")]
    write(tmp_path / "c.txt", "# no", "", " , https://e,f", "https://g")
    assert [r.url for r in lists.read_url_list(spark, str(tmp_path / "c.txt")).collect()] == ["https://e", "https://g"]
    assert lists.pick_url_header(["a", "My URL", "link"]) == "link" and lists.pick_url_header(["my_urls_x"]) == "my_urls_x"
    with pytest.raises(ValueError):
        lists.pick_url_header(["a"])


def test_page_parser():
    page = '<p id=a class="x y">one<br>two<p>three<ul><li data-k="v">l1<li>l2</ul><script>no()</script><div class=z><span>deep &amp; down</span></div>'
    doc = html.parse_html(page)
    assert doc.first("#a.x").text() == "one two" and [n.text() for n in doc.select("ul li")] == ["l1", "l2"]
    assert doc.first("[data-k=v]").text() == "l1" and doc.first("div.z span, p").text() == "one two" and doc.first(".none") is None
    assert "no()" not in doc.text() and doc.text().endswith("deep & down")
    assert html.product_page(" ") is None and html.review_list(None) == [] and html.rating_histogram("") is None
    assert html.product_page("<html>")["partial"] is True
    assert html.balance({5: 50, 4: 50, 3: 10}) == {5: 40, 4: 50, 3: 10, 2: 0, 1: 0}
    bars = html.rating_histogram('<div id="cm_cr_dp_d_rating_histogram"><span data-hook="total-review-count">1,234</span><ul id="histogramTable"><li aria-label="5 stars"><div class="a-meter" aria-valuenow="60"></div></li><li>4 星 <i style="width: 30%"></i></li></ul></div>')
    assert bars["percentageByStar"] == {5: 70, 4: 30, 3: 0, 2: 0, 1: 0} and bars["reviewCount"] == 1234
    assert html.selectors_from("histogram.rows=.own,tr.a-histogram-row\n# x=y")["rows"][:2] == [".own", "tr.a-histogram-row"]


def test_pages_are_dealt_by_their_number(spark, sf, monkeypatch):
    """A small file of many parts: its pages are not one task's."""
    from lynxmark.plans import intake as plans

    monkeypatch.setattr(plans, "PAGES", 20)
    for pages in (plans._pages, plans._layouts):
        sizes = pages(spark, sf).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 40


def test_snapshots_are_read_once(spark):
    """However many fields are asked for; and what is no object gives a stub."""
    texts = [' \n{"asin":"A1","ratingCount":3,"ratingSharePct":{"5":52.0}}', "{broken", "[1]", '"{"', "", None]
    rows = spark.createDataFrame([(i, "kept", "t", t) for i, t in enumerate(texts)], "id int, asin string, title string, snapshot_json string")
    told = ndjson.decode_snapshots(rows, schemas.SNAPSHOT).select("id", "snapshot.asin", "snapshot.partial", "snapshot.ratingCount", F.element_at("snapshot.ratingSharePct", F.lit(5)).alias("five"))
    assert sorted(map(tuple, told.collect())) == [(0, "A1", None, 3, 52.0), *[(i, "kept", True, None, None) for i in range(1, 6)]]
    assert told._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json(") == 1


def test_outlines_keep_references_as_written(spark):
    page = "<title>a &amp; b &quot;c&quot; &am d&amp</title><p>x &lt; y</p>"
    row = html.page_outline(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id").first()
    assert (row.title, row.n_words) == ("a & b &quot;c&quot; &am d&amp", 9)


def test_page_directory_has_so_many_ranges_at_most(spark, tmp_path, monkeypatch):
    from lynxmark.operators import pages

    monkeypatch.setattr(pages, "RANGES", 7)
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    laid = pages.PageDirectory.build(rows, str(tmp_path / "laid"), [("id", True)], rows=10)
    assert laid.directory.count() <= 7 and laid.total() == 1000
    assert [r.id for r in laid.page(33, 10).collect()] == list(range(669, 659, -1))
    assert all(r.id + r.ordinal == 1000 for r in laid.numbered().collect())


def test_merge_nulls_keys_and_order(spark):
    old = spark.createDataFrame([("a", 1, "x", "t0"), (None, 2, "y", "t0")], "k string, n int, s string, updated_at string")
    new = spark.createDataFrame([("a", None, "x2", 2), ("a", 7, None, 1), ("b", 1, "z", 3), (None, 9, "w", 4), (None, 9, "w", 5)], "k string, n int, s string, o int")
    got = sorted(map(str, [tuple(r) for r in merge.merge(old, new, ["k"], ["o"], stamp="t1").collect()]))
    assert got == sorted(map(str, [("a", 7, "x2", "t1"), ("b", 1, "z", "t1"), (None, 2, "y", "t0"), (None, 9, "w", "t1"), (None, 9, "w", "t1")]))
    once = merge.merge(old, new.where("k IS NOT NULL"), ["k"], ["o"], stamp="t1")
    twice = merge.merge(once, new.where("k IS NOT NULL"), ["k"], ["o"], stamp="t1")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    kept = merge.merge(old, new.where("k = 'a'"), ["k"], ["o"], {"s": merge.KEEP, "n": merge.OVERWRITE}).where("k = 'a'").first()
    assert (kept.n, kept.s) == (None, "x")
    assert merge.merge(old.limit(0), new, ["k"], ["o"]).count() == 4 and merge.merge(old, new.limit(0), ["k"], ["o"]).count() == 2


def test_review_upserts_route_by_id(spark):
    target = spark.createDataFrame([], schemas.REVIEWS)
    rows = [("p", "amazon ", 9, "T", "B one", "E1", None, "Ann", None, -3, 1), ("p", None, 4, "T", "B one", None, None, "Ann", None, 2, 2), ("p", "AMAZON", None, "t", "b ONE", " ", None, " ann", None, None, 3)]
    batch = merge.prepare_reviews(spark.createDataFrame(rows, "product_id string, source string, rating int, title string, body string, external_review_id string, reviewer_ref string, reviewer string, review_url string, helpful_votes int, o int").withColumns({"fingerprint": F.lit(None).cast("string"), "review_date": F.lit(None).cast("date")}))
    got = merge.upsert_reviews(target, batch, ["o"], "2024-01-01 00:00:00").collect()
    assert len(got) == 2
    named = next(r for r in got if r.external_review_id == "E1")
    assert (named.source, named.rating, named.helpful_votes, named.fingerprint) == ("AMAZON", 5, 0, None)
    other = next(r for r in got if r.external_review_id != "E1")
    assert other.fingerprint and other.reviewer_ref == "ann" and (other.rating, other.helpful_votes) == (0, 0)
    assert merge.upsert_dev_reviews(target, batch.withColumn("source_review_id", F.lit("s")), ["o"], "2024-01-01 00:00:00").count() == 1
    estimate = merge.estimate_upsert(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string"), "k").first()
    assert tuple(estimate) == (2, 1)


def test_stats_and_scores(spark):
    stats = spark.createDataFrame([], schemas.PRODUCT_STATS)
    batch = spark.sql("SELECT 'p' AS product_id, CAST(4.5 AS DECIMAL(3,2)) AS rating_average, CAST(NULL AS INT) AS rating_count, map('5', 3L) AS ratings_histogram, 1 AS o")
    once = merge.upsert_stats(stats, batch.withColumn("rating_count", F.lit(9)), ["o"], "2024-01-01 00:00:00")
    assert merge.upsert_stats(once, batch, ["o"], "2024-01-02 00:00:00").first().rating_count is None
    scores = spark.createDataFrame([], schemas.REVIEW_SCORES)
    s = spark.sql("SELECT 'p' AS product_id, 'SITE' AS source, 12.0D AS score, 'A' AS rank, 1 AS o")
    assert merge.upsert_scores(scores, s.union(s.withColumn("score", F.lit(13.0)).withColumn("o", F.lit(2))), ["o"], "2024-01-01 00:00:00").first().score == 13.0


@pytest.mark.parametrize("by", [None, "id"])
def test_versioned_table(spark, tmp_path, by):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), by, 4)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.write(spark.range(3))
    first = t.version()
    t.write(t.read().union(spark.range(2)))
    assert t.read().count() == 5 and t.version() == first + 1
    t.write(t.read().limit(0))
    assert t.read().count() == 0 and t.read().columns == ["id"]


@pytest.mark.parametrize("by", [None, "id"])
def test_a_write_that_stops_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, by):
    """Between the folder and the file that makes it count, and between drafting that file and its renaming."""
    t = versions.VersionedTable(spark, str(tmp_path / "t"), by, 4)
    t.write(spark.range(3))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            t.write(spark.range(9))
    other = versions.VersionedTable(spark, str(tmp_path / "t"), by, 4)
    assert other.read().count() == 3
    (tmp_path / "t/drafts").mkdir(exist_ok=True)
    (tmp_path / "t/drafts/v-00000002-x").write_text("- v-00000002-x")
    assert other.read().count() == 3 and other.version() == 1
    # Two writers of the whole table from the same version: the second one is refused.
    t.write(spark.range(4), base=1)
    with pytest.raises(versions.Conflict):
        other.write(spark.range(5), base=1)
    assert t.read().count() == 4
    t.write(spark.range(6))
    t.prune(1)
    assert t.read().count() == 6 and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 1


def test_only_touched_partitions_are_written(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), "k", 8)
    t.write(spark.range(200).select("id", (F.col("id") % 40).alias("k")))
    before = t.current().folders
    touched = spark.createDataFrame([(3,), (3,)], "k long")
    old = t.read(touched)
    assert 0 < old.count() < 200
    t.replace(old.where("k != 3").union(spark.createDataFrame([(999, 3)], "id long, k long")), touched)
    after = t.current().folders
    assert sum(after[k] != before[k] for k in before) == 1 and sorted(r.id for r in t.read().where("k = 3").collect()) == [999] and t.read().count() == 196
    new = spark.createDataFrame([(3,), (1001,)], "k long")
    t.replace(t.read(new).where("k != 3"), new)
    assert t.read().count() == 195 and t.read().columns == ["id", "k"] and t.read(spark.createDataFrame([], "k long")).count() == 0


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("Ad Hoc", "b1", "R1", 5.0), ("Ad Hoc", "b1", "R2", None)], "dataset string, asin string, reviewId string, rating double")
    h = spark.createDataFrame([("Ad Hoc", "b1", 4.5)], "dataset string, asin string, rating_average double")
    sinks.write_ndjson(sinks.ndjson_lines(r, h), str(tmp_path / "out"))
    back = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out/dataset=ad_hoc/asin=B1")).collect()]
    assert back[0]["type"] == "histogram" and [x["reviewId"] for x in back[1:]] == ["R1", "R2"]
    sinks.write_csv(r, str(tmp_path / "csv"))
    assert tuple(spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns) == schemas.CSV_COLUMNS
    sinks.append_rows(r, str(tmp_path / "log"))
    sinks.append_rows(r, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.write_features(spark.createDataFrame([("p", "SAKURA", 1.0, 2, 3)], "product_id string, label string, dist_bias double, duplicates int, cnt int"), str(tmp_path / "f"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "f")).first().label == "SAKURA"
    assert json.loads(sinks.as_json_array(r, "asin", "reviewId").first().json)[0]["reviewId"] == "R1"


@pytest.mark.parametrize("by", [None, "asin"])
def test_stream_merges_what_comes(spark, tmp_path, by):
    src, table = tmp_path / "in", versions.VersionedTable(spark, str(tmp_path / "t"), by, 4)
    schema = "asin string, reviewId string, rating double, body string"
    table.write(spark.createDataFrame([("B000000001", "R0", 1.0, "old")], schema))
    touched = []

    def combine(old, rows):
        return merge.merge(old, rows.select("asin", "reviewId", "rating", "body", "line_no"), ["asin", "reviewId"], ["line_no"])

    for i in (1, 2):
        write(src / f"{i}.ndjson", json.dumps(REVIEW | {"reviewId": f"R{i}", "rating": float(i)}), json.dumps(REVIEW | {"reviewId": "R1", "rating": None, "body": "later"}))
        intake.start(spark, str(src), str(tmp_path / "ck"), table, combine, lambda df, name: touched.append(df.count())).awaitTermination()
    got = {r.reviewId: (r.rating, r.body) for r in table.read().collect()}
    assert got == {"R0": (1.0, "old"), "R1": (1.0, "later"), "R2": (2.0, "fine")} and touched == [2, 3]
    counted = intake.daily_counts(spark.readStream.schema("product_id string, posted_at timestamp").json(str(src)))
    assert counted.isStreaming and counted.columns == ["product_id", "day", "n"]


def test_the_last_write_is_that_of_the_newest_file(spark, tmp_path):
    """Whatever the files' sizes and names, and so the order in which Spark deals them."""
    src, table = tmp_path / "in", versions.VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([], "asin string, reviewId string, rating double, body string"))
    src.mkdir()
    for name, age, lines in (("a", 10, 900), ("b", 30, 1), ("c", 20, 50)):
        write(src / f"{name}.ndjson", *[json.dumps(REVIEW | {"reviewId": "R1", "body": f"{name}{i}"}) for i in range(lines)])
        os.utime(src / f"{name}.ndjson", (1_700_000_000 - age, 1_700_000_000 - age))
    intake.start(spark, str(src), str(tmp_path / "ck"), table, lambda old, rows: merge.merge(old, rows.select("asin", "reviewId", "rating", "body", "line_no"), ["asin", "reviewId"], ["line_no"])).awaitTermination()
    assert [r.body for r in table.read().collect()] == ["a899"]


def test_serving_parameters(spark):
    assert [serving.clamp_limit(n, 100, 100) for n in (None, 0, -1, 5, 500)] == [100, 100, 100, 5, 100]
    assert [serving.parse_bool(x) for x in ("Yes", " off ", "", None)] == [True, False, None, None]
    with pytest.raises(ValueError):
        serving.parse_bool("maybe")
    reviews = spark.createDataFrame([(float("nan"), "b"), (5.4, "b"), (0.2, "b"), (3.0, "x" * 1001), (3.0, " ")], "stars double, body string").withColumn("title", F.lit("t" * 300))
    assert [r.problem for r in serving.checked_user_reviews(reviews).collect()] == ["stars", None, "stars", "body too long", "body missing"]


def test_the_first_request_fills(spark):
    products = spark.createDataFrame([("p1", "A1", None, "n", "b", None, True, "DRAFT", None)], "product_id string, asin string, title string, name string, brand string, url string, visible boolean, publish_status string, updated_at timestamp_ntz")
    asked = [(3, "A1", "late", "p9"), (1, "A1", " ", "p9"), (2, "A1", "early", "p9"), (2, "A2", "z", "q"), (2, "A2", "y", "q")]
    requests = spark.createDataFrame(asked, "n int, asin string, title string, product_id string")
    got = {r.asin: r.title for r in lifecycle.register_products(products, requests, "2024-01-01 00:00:00", ("n",)).collect()}
    assert got == {"A1": "early", "A2": "y"}


def test_job_without_an_end(spark):
    e = spark.sql("SELECT 1 AS job_id, 1 AS seq, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at, 'QUEUED' AS kind, CAST(NULL AS INT) AS collected, CAST(NULL AS INT) AS upserted, '' AS code, '' AS message")
    r = lifecycle.fold_jobs(e).first()
    assert (r.status, r.finished_at, r.attempt_count) == ("QUEUED", None, 0)


def test_database_tables(spark):
    url = "jdbc:derby:memory:t;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "ID int, NAME string")
    rows.write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    df = tables.read_jdbc(spark, url, "T", split="ID", bounds=(0, 50), parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.where("ID >= 40").count() == 10
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,40)]" in df.where("ID >= 40").select("NAME")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, url, "T", split="ID")


def test_archived_databases(spark, tmp_path):
    """Values come back as they were, whichever database they lie in."""
    odd = [(1, 'a "q", é\nnl', None, 1.5e-7, ""), (2, None, 3, None, "x"), (3, " lead ", -4, 1e10, "y, z"), (4, "", 0, 0.1 + 0.2, None), (5, "'", None, None, "\r\n \t"), (6, "'", 1, -1e-300, "日本")]
    rows = spark.createDataFrame(odd, "k long, name string, n int, x double, s string")
    columns = '"k" BIGINT, "name" VARCHAR(64), "n" INTEGER, "x" DOUBLE, "s" VARCHAR(32)'
    urls = derby.write_archives(rows, str(tmp_path), "T", columns, ["name", "k"], 2)
    assert len(urls) == 3 and not derby.write_archives(rows.limit(0), str(tmp_path), "T", columns, ["name", "k"])
    got = [r for u in urls for r in tables.read_jdbc_by_key(spark, u, "T", '"name"', 2, driver=derby.DRIVER).collect()]
    assert sorted(map(tuple, got)) == odd
    with pytest.raises(Exception, match="T was not loaded"):
        derby.write_archives(rows, str(tmp_path), "T", columns.replace("64", "3"), ["name", "k"])


def test_database_on_a_cluster(sf, tmp_path):
    """Executors in processes of their own, in an application of its own."""
    code = f"""from pyspark.sql import SparkSession
import __spark_entry__ as e
from tests.oracle import difference
conf = {{"spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "512m", "spark.sql.warehouse.dir": "{tmp_path}/wh"}}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
print("said", [difference(spark, "{sf}", e.queries()["src_jdbc_by_key"], e.oracle_sql()["src_jdbc_by_key"])[:500]])
spark.stop()"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert "said ['']" in told.stdout, told.stdout + told.stderr[-2000:]
