"""Queries that go through files and settings: what is written is listed and read back, with the SQL that it equals."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark import config
from lynxmark.operators import features, rules, scoring, serving
from lynxmark.plans import scores
from lynxmark.plans.adapters import reviews_text, squeeze, table
from lynxmark.plans.intake import _BASE, _lines, _parsed
from lynxmark.sources import derby, html, lists, ndjson, review_files, sinks, tables

Q: dict = {}
SQL: dict[str, str] = {}
_folders: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM has gone first: nothing is left to call
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below the one that the cluster names in spark.checkpoint.dir; a
    temporary one only where that is unset and the master a local one. It is removed at the end."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='lynxmark-files-')}"
        _folders[app] = f"{base.rstrip('/')}/files-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex[:8]}"


LABELS = {"fake": "SAKURA", "doubtful": "LIKELY", "real": "GENUINE"}


def _corpus(spark, d) -> tuple[DataFrame, str]:
    """The lines of the events in files f0.ndjson to f19.ndjson, every fifth in capitals, in three folders, beside one of another kind."""
    lines, root = _lines(spark, d), scratch(spark, "corpus")
    raw = f"{root}-raw"
    lines.select(F.regexp_replace("path", r"\D", "").cast("int").alias("n"), "line_no", "line").repartition("n").sortWithinPartitions("n", "line_no").select("n", "line").write.partitionBy("n").text(raw)
    fs, p = _fs(spark, raw)
    path = lambda x: _fs(spark, x)[1]
    for folder in LABELS:
        fs.mkdirs(path(f"{root}/{folder}/deep"))
    for status in fs.listStatus(p):  # twenty files
        name = status.getPath().getName()
        if not name.startswith("n="):
            continue
        n = int(name[2:])
        part = next(f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-"))
        fs.rename(part, path(f"{root}/{list(LABELS)[n % 3]}/deep/f{n}.{'NDJSON' if n % 5 == 0 else 'ndjson'}"))
    out = fs.create(path(f"{root}/real/notes.txt"), True)
    out.write(bytearray(b"no review\n"))
    out.close()
    fs.delete(p, True)
    return lines, root


_FILES = "e AS (SELECT user_id % 20 AS n, count(*) AS lines FROM events GROUP BY 1)"


@query(f"WITH {_FILES} SELECT row_number() OVER (ORDER BY CASE n % 3 WHEN 0 THEN 'fake' WHEN 1 THEN 'doubtful' ELSE 'real' END, 'f' || n || '.') AS nth, 'f' || n || CASE WHEN n % 5 = 0 THEN '.NDJSON' ELSE '.ndjson' END AS name, lines, true AS sized, true AS dated FROM e")
def src_file_scan(spark, d):
    """The candidate files in path order with their sizes and times, beside what is read of each."""
    _, root = _corpus(spark, d)
    from pyspark.sql import Window

    files = ndjson.list_files(spark, [root])
    nth = F.row_number().over(Window.orderBy(F.lower("path"), "path"))  # one row a file
    name = F.element_at(F.split("path", "/"), -1)
    read = ndjson.read_lines(spark, [root]).groupBy(name.alias("name")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    return files.withColumn("nth", nth).join(read, "name").select("nth", "name", "lines", (F.col("size") == F.col("bytes")).alias("sized"), F.col("modified").isNotNull().alias("dated"))


@query(f"WITH {_FILES} SELECT CASE n % 3 WHEN 0 THEN 'SAKURA' WHEN 1 THEN 'LIKELY' ELSE 'GENUINE' END AS label, CAST(count(*) AS BIGINT) AS samples, CAST(sum(lines) AS BIGINT) AS lines FROM e GROUP BY 1")
def src_labelled_files(spark, d):
    """One sample a file, labelled by its folder."""
    _, root = _corpus(spark, d)
    return ndjson.labelled(spark, root, LABELS).groupBy("label").agg(F.count_distinct("sample").alias("samples"), F.count("*").alias("lines"))


@query(f"WITH {_BASE} SELECT 'adhoc' AS dataset, asin, count(*) FILTER (m > 2) AS n_reviews, count(*) FILTER (m = 2) AS n_histograms, sum(CASE WHEN m > 2 THEN k ELSE 0 END) AS review_ids FROM b WHERE m > 1 GROUP BY asin")
def snk_ndjson_files(spark, d):
    """Products' lines, written to a file each and read back."""
    parsed, path = _parsed(spark, d), scratch(spark, "ndjson")
    sinks.write_ndjson(sinks.ndjson_lines(ndjson.reviews(parsed), ndjson.histograms(parsed)), path)
    back = ndjson.parse(spark.read.text(path).select("dataset", "asin", F.col("value").alias("line")))
    number = F.try_variant_get("doc", "$.reviewId", "string").substr(2, 30).cast("bigint")
    return back.groupBy("dataset", "asin").agg(F.count_if(~F.col("is_histogram")).alias("n_reviews"), F.count_if("is_histogram").alias("n_histograms"), F.sum(F.coalesce(number, F.lit(0))).alias("review_ids"))


@query(f"WITH {_BASE} SELECT review_id, asin, url, CAST(strict AS DOUBLE) AS rating, CAST(k % 100 AS INTEGER) AS body_length, k % 2 = 0 AS flag, 15 AS columns FROM r")
def snk_csv_files(spark, d):
    """Reviews as CSV with its fixed columns, read back by their names."""
    path = scratch(spark, "csv")
    sinks.write_csv(ndjson.reviews(_parsed(spark, d)), path)
    back = spark.read.option("header", "true").option("escape", '"').csv(path)
    return back.select(F.col("reviewId").alias("review_id"), "asin", "url", F.col("rating").cast("double").alias("rating"), F.col("bodyLength").cast("int").alias("body_length"), F.col("sakura_flag").cast("boolean").alias("flag"), F.lit(len(back.columns)).alias("columns"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def snk_appended(spark, d):
    """Rows appended in two goes: none is changed or lost."""
    e, path = table(spark, d, "events").select("event_id", "event_type"), scratch(spark, "log")
    sinks.append_rows(e.where("event_id % 2 = 0"), path)
    sinks.append_rows(e.where("event_id % 2 <> 0"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"{scores.EXPORT_SQL} SELECT product_id, 'SAKURA' AS label, dist_bias, duplicates, cnt FROM feats")
def snk_features_file(spark, d):
    """The exported features with their label, as CSV and back."""
    path = scratch(spark, "features")
    sinks.write_features(features.exported_features(reviews_text(spark, d)).withColumn("label", F.lit("SAKURA")), path)
    return spark.read.schema("product_id string, label string, dist_bias double, duplicates bigint, cnt bigint").option("header", "true").csv(path)


@query("SELECT row_number() OVER (ORDER BY min(page_id)) AS n, url FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN upper(left(url, 4)) || substr(url, 5) ELSE url END AS url FROM pages WHERE page_id % 7 > 0) GROUP BY url")
def src_url_csv(spark, d):
    """Addresses out of CSV files with a header each: quoted line breaks, blanks around, other schemes, repeats."""
    p, path = table(spark, d, "pages"), scratch(spark, "urls")
    url = F.when(F.col("page_id") % 7 == 0, "ftp://none").when(F.col("page_id") % 4 == 0, F.concat(F.upper(F.left("url", F.lit(4))), F.expr("substr(url, 5)"))).otherwise(F.col("url"))
    rows = p.select("page_id", F.concat(F.lit("a\nb,"), F.col("page_id").cast("string")).alias("note"), F.concat(F.lit(" "), url, F.lit(" ")).alias("Product_URL"))
    twice = rows.union(rows.withColumn("page_id", F.col("page_id") + F.lit(1 << 40)))
    twice.repartitionByRange(4, "page_id").sortWithinPartitions("page_id").select("note", "Product_URL").write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return lists.read_url_csv(spark, f"{path}/*.csv")


@query("SELECT url FROM pages WHERE page_id % 5 > 1")
def src_url_list(spark, d):
    """Lines of addresses: blank ones and comments give none, of several fields the first that is not blank counts."""
    k, path = F.col("page_id") % 5, scratch(spark, "list")
    line = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" # "), "url")).when(k == 2, F.concat(F.lit(" , "), "url", F.lit(",x"))).when(k == 3, F.concat(F.lit("\t"), "url")).otherwise(F.col("url"))
    table(spark, d, "pages").select(line.alias("line")).write.text(path)
    return lists.read_url_list(spark, path).select("url")


@query("SELECT p_partkey AS page_key, CAST(p_partkey % 60 AS INTEGER) AS five, CAST(100 - p_partkey % 60 AS INTEGER) AS four, CAST(p_size % 5 AS DOUBLE) AS average, CAST(p_partkey % 900 + 1 AS INTEGER) AS n FROM part")
def src_selectors(spark, d):
    """Pages in a layout that only the selectors of a properties text know."""
    own = html.selectors_from("# ours\nhistogram.rows = div.bar\naverage.rating = b.mean\nreview.count=#total\nother = x\n")
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    bar = lambda star, pct: F.concat(F.lit(f'<div class="bar" aria-label="{star} stars">'), s(pct), F.lit("%</div>"))
    page = F.concat(bar(5, k % 60), bar(4, 100 - k % 60), F.lit('<b class="mean">'), s(F.col("p_size") % 5), F.lit('</b><i id="total">'), s(k % 900 + 1), F.lit("</i>"))
    pages = table(spark, d, "part").select(k.alias("page_id"), page.alias("html"))
    share = lambda x: F.element_at("percentageByStar", F.lit(x))
    return html.parse_histograms(pages, "page_id", selectors=own).select("page_key", share(5).alias("five"), share(4).alias("four"), F.col("averageRating").alias("average"), F.col("reviewCount").alias("n"))


_WEIGHTS = {"dist_bias": 0.1, "duplicates": 0.6, "surge": 0.05, "noise": 0.25}
_YAML = "# site\nweights:\n" + "".join(f"  {k}: {v}\n" for k, v in _WEIGHTS.items()) + "noise:\n  warn: 'bad'\n  crit: 0.75\nsakura_percent:\n  sakura:\n    dist_bias: 70\n    duplicates: 30\n"


def _from_file() -> config.Thresholds:
    """Settings as the driver reads them from its file."""
    with tempfile.NamedTemporaryFile("w", suffix=".yml") as f:
        f.write(_YAML)
        f.flush()
        return config.ThresholdSource(f.name).get()


#: Of each setting, the feature that it is about.
_ABOUT = {"dist_bias": "dist_bias", "duplicates": "duplicates", "surge": "surge", "noise": "noise", "noise.warn": "noise", "noise.crit": "noise", "sakura.dist": "dist_bias", "sakura.dup": "duplicates", "likely.dist": "dist_bias"}
_VALUES = "('dist_bias', 0.1), ('duplicates', 0.6), ('surge', 0.05), ('noise', 0.25), ('noise.warn', 0.25), ('noise.crit', 0.75), ('sakura.dist', 70.0), ('sakura.dup', 30.0), ('likely.dist', 65.0)"
_PICK = "CASE " + " ".join(f"WHEN name = '{k}' THEN {v}" for k, v in _ABOUT.items()) + " END"


@query(f"""{scores.SITE_SQL}, t AS (SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES {_VALUES}) v(name, value))
    SELECT name, value, count(*) FILTER ({_PICK} >= CASE WHEN value <= 1 THEN value * 100.0 ELSE value END) AS products FROM t, feats GROUP BY name, value""")
def src_thresholds_file(spark, d):
    """A file's values (what it lacks, or what is no number there, stays), each with the number of products that reach it."""
    t = _from_file()
    rows = [*t.weights.items(), ("noise.warn", t.noise.warn), ("noise.crit", t.noise.crit), ("sakura.dist", float(t.percent.dist_sakura)), ("sakura.dup", float(t.percent.dup_sakura)), ("likely.dist", float(t.percent.dist_likely))]
    site = features.site_features(reviews_text(spark, d), normalize=squeeze)
    reached = [F.count_if(F.col(_ABOUT[k]) >= (v * 100.0 if v <= 1 else v)).alias(k) for k, v in rows]
    counts = site.agg(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("value"), c.alias("products")) for (k, v), c in zip(rows, reached, strict=True)]).alias("all"))
    return counts.select(F.inline("all"))


_POINTS = ", ".join(f"CAST(floor(greatest(0.0, least(1.0, {k} / 100.0)) * {w} * 100.0 + 0.5) AS INTEGER) AS points_{k}" for k, w in _WEIGHTS.items())


@query(f"{scores.SITE_SQL}, pts AS (SELECT *, {_POINTS} FROM feats) SELECT product_id, points_dist_bias, points_duplicates, points_surge, points_noise, floor(least(100.0, CAST(points_dist_bias + points_duplicates + points_surge + points_noise AS DOUBLE)) * 10.0 + 0.5) / 10.0 AS risk, {scores._V('dist_bias', 'duplicates', (70, 30, 65, 40, 45))} AS verdict FROM pts")
def score_site_by_file(spark, d):
    """The site's score by that file."""
    s = scoring.score_site(features.site_features(reviews_text(spark, d), normalize=squeeze), _from_file())
    return s.select("product_id", "points_dist_bias", "points_duplicates", "points_surge", "points_noise", "risk", "verdict")


_DOUBLE, _OFF = ("SURGE_ACTIVITY", 20.0), ("NOISE", 0.0)
_PROFILE = {k: f"({v}) * 2.0" if k == _DOUBLE[0] else f"({v}) * 0.0" if k == _OFF[0] else v for k, v in scores._RULE_SQL.items()}
_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"WITH {scores.CONTEXT_SQL} SELECT {_ID}, {_PROFILE['SURGE_ACTIVITY']} AS surge, {_PROFILE['NOISE']} AS noise, " + " + ".join(f"coalesce({v}, 0.0)" for v in _PROFILE.values()) + " AS total_penalty, concat_ws(',', " + ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '{k}' END" for k, v in _PROFILE.items()) + ") AS triggered FROM ctx")
def rule_profile(spark, d):
    """All rules of the catalog in their order, with a profile that doubles one weight and takes another away."""
    s = rules.score_rules(scores._contexts(spark, d), rules.Profile().with_weight(*_DOUBLE).with_weight(*_OFF))
    return s.select(*_ID.split(", "), F.col("penalty_SURGE_ACTIVITY").alias("surge"), F.col("penalty_NOISE").alias("noise"), "total_penalty", F.array_join(F.transform("triggered", lambda t: t["flag"]), ",").alias("triggered"))


_CATALOG = {"DUPLICATE_TEXT": 15, "UNNATURAL_LANGUAGE": 5, "STAR_DISTRIBUTION": 5, "EXCESSIVE_FIVE_STAR": 5, "SURGE_ACTIVITY": 10, "NOISE": 3, "LOW_VERIFIED_RATE": 5, "ANONYMOUS_REVIEWER": 5, "NEW_ACCOUNT_BURST": 10, "SAME_VENDOR_CONCENTRATION": 5, "LOW_SPECIFICITY": 5}


@query(f"{scores.RULES_SQL} " + " UNION ALL ".join(f"SELECT CAST({n + 1} AS BIGINT) AS nth, '{k}' AS flag, CAST({w} AS DOUBLE) AS weight, count(penalty_{k}) AS triggered, coalesce(max(penalty_{k}), 0.0) AS worst FROM sc" for n, (k, w) in enumerate(_CATALOG.items())))
def rule_catalog(spark, d):
    """The eleven rules in order, with their weights, how many reviews each has triggered for, and its highest penalty."""
    weights, scored = rules.Profile().weights, rules.score_rules(scores._contexts(spark, d))
    penalty = lambda r: F.col(f"penalty_{r.flag}")
    sums = scored.agg(*[F.struct(F.count(penalty(r)).alias("triggered"), F.coalesce(F.max(penalty(r)), F.lit(0.0)).alias("worst")).alias(r.flag) for r in rules.CATALOG])
    rows = [F.struct(F.lit(i + 1).cast("long").alias("nth"), F.lit(r.flag).alias("flag"), F.lit(float(weights[r.flag])).alias("weight"), F.col(f"{r.flag}.triggered"), F.col(f"{r.flag}.worst")) for i, r in enumerate(rules.CATALOG)]
    return sums.select(F.inline(F.array(*rows)))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL ELSE true END AS asked, event_id % 6 IN (0, 2, 5) = (event_id % 2 = 0) AND event_id % 6 <> 4 AS kept FROM events")
def flt_bool_parameter(spark, d):
    """Each event's request parameter as a boolean, and whether its row passes."""
    words = {0: " TRUE ", 1: "off", 2: "Yes", 3: "0", 4: " ", 5: "on"}
    told = F.element_at(F.create_map(*[F.lit(x) for k, w in words.items() for x in (k, serving.parse_bool(w))]), (F.col("event_id") % 6).cast("int"))
    e = table(spark, d, "events").select("event_id", told.alias("asked"))
    return e.select("event_id", "asked", F.coalesce(F.col("asked") == (F.col("event_id") % 2 == 0), F.lit(False)).alias("kept"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_jdbc_by_key(spark, d):
    """The customers, loaded into databases of a range of names each, and read back through JDBC by ranges of their names."""
    columns = '"c_custkey" BIGINT, "c_name" VARCHAR(64), "c_nationkey" INTEGER, "c_acctbal" DOUBLE, "c_mktsegment" VARCHAR(32)'
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    urls = derby.write_archives(customers, scratch(spark, "customers"), "CUSTOMER", columns, ["c_name", "c_custkey"])
    if not urls:
        return customers
    parts = max(2, 8 // len(urls))
    return reduce(DataFrame.unionAll, [tables.read_jdbc_by_key(spark, url, "CUSTOMER", '"c_name"', parts, driver=derby.DRIVER) for url in urls])


@query("""SELECT event_type AS dataset, 'B' || lpad(CAST(user_id % 30 AS VARCHAR), 9, '0') AS asin, event_id AS review_id, value AS rating, true AS placed FROM events
    WHERE user_id % 30 IN (7, 11, 29) AND event_type <> 'error' AND event_id % 2 = 0""")
def src_review_files(spark, d):
    """Lines of three products, written by dataset and product and read back by the data source that opens their folders alone."""
    folder = scratch(spark, "reviews")
    e = table(spark, d, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    line = F.to_json(F.struct(F.col("event_id").alias("reviewId"), F.col("value").alias("rating")))
    e.select(F.col("event_type").alias("dataset"), F.format_string("B%09d", F.col("user_id") % 30).alias("asin"), line.alias("line")).repartition("dataset", "asin").write.partitionBy("dataset", "asin").text(folder)
    lines = review_files.read_review_files(spark, folder).where(F.col("asin").isin("B000000007", "B000000011", "B000000029") & (F.col("dataset") != "error"))
    told = lines.select("dataset", "asin", F.get_json_object("line", "$.reviewId").cast("long").alias("review_id"), F.get_json_object("line", "$.rating").cast("double").alias("rating"), (F.col("offset") < F.col("size")).alias("placed"))
    return told.where("review_id % 2 = 0")
