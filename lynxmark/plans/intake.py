"""Queries of sources and sinks: lines, pages, files and snapshots made from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from lynxmark.functions.text import blank_to_null, has_text
from lynxmark.operators import histograms, lifecycle, serving
from lynxmark.plans.adapters import PRODUCTS, products, table
from lynxmark.schemas import SNAPSHOT
from lynxmark.sources import html, lists, ndjson, sinks
from lynxmark.sources.tables import spread

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark, d):
    """Of each event a line: blank, broken, a histogram, or a review whose rating is a number, text, missing, a boolean or half."""
    e, k, m = table(spark, d, "events"), F.col("event_id"), F.col("event_id") % 9
    s = lambda c: c.cast("string")
    asin = F.concat(F.lit("b"), F.lpad(s(k % 400), 9, "0"))
    rating = F.when(m == 3, s(F.floor("value").cast("bigint"))).when(m == 4, F.concat(F.lit('"'), s(k % 6), F.lit('"'))).when(m == 5, F.lit("null")).when(m == 6, F.lit("true")).otherwise(F.concat(s(k % 5), F.lit(".5")))
    review = F.concat(F.lit('{"dataset":" Adhoc ","asin":"'), asin, F.lit('","reviewId":"R'), s(k), F.lit('","url":"'), F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("https://x/"), s(k))), F.lit('","bodyLength":"'), s(k % 100), F.lit('","sakura_flag":'), F.when(k % 2 == 0, F.lit("1")).otherwise(F.lit('"no"')), F.lit(',"collectedAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","rating":'), rating, F.lit("}"))
    hist = F.concat(F.lit('{"type":" Histogram ","asin":"'), asin, F.lit('","captured_at":"'), F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit(" ")), F.lit('","rating_average":'), s(k % 5), F.lit(',"rating_count":"'), s(k % 50), F.lit('","ratings_histogram":{"5":'), s(k % 90), F.lit(',"4":"10"}}'))
    line = F.when(m == 0, F.lit(" \t")).when(m == 1, F.lit('{"asin":')).when(m == 2, hist).otherwise(review)
    return e.select(F.concat(F.lit("f"), s(F.col("user_id") % 20), F.lit(".ndjson")).alias("path"), k.alias("line_no"), line.alias("line"))


_BASE = """b AS (SELECT event_id AS k, event_id % 9 AS m, 'f' || (user_id % 20) || '.ndjson' AS path, value, ts, 'B' || lpad(CAST(event_id % 400 AS VARCHAR), 9, '0') AS asin FROM events),
    r AS (SELECT *, 'R' || k AS review_id, CASE WHEN k % 11 <> 0 THEN 'https://x/' || k END AS url, CASE m WHEN 3 THEN CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) WHEN 7 THEN k % 5 + 0.5 WHEN 8 THEN k % 5 + 0.5 END AS strict, CASE WHEN m = 4 THEN CAST(k % 6 AS DOUBLE) WHEN m = 3 THEN CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) WHEN m > 6 THEN k % 5 + 0.5 END AS lenient FROM b WHERE m > 2),
    known AS (SELECT DISTINCT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin FROM part WHERE p_partkey % 3 > 0),
    ok AS (SELECT *, CAST(greatest(0, least(5, floor(strict + 0.5))) AS INTEGER) AS stars FROM r WHERE url IS NOT NULL AND strict IS NOT NULL AND asin IN (SELECT asin FROM known))"""


def _parsed(spark, d):
    return ndjson.parse(_lines(spark, d))


def _known(spark, d):
    return products(spark, d).where(F.col("product_id").cast("bigint") % 3 > 0)


@query(f"WITH {_BASE} SELECT k AS line_no, asin, review_id, url, CAST(strict AS DOUBLE) AS rating, CAST(k % 100 AS INTEGER) AS body_length, k % 2 = 0 AS sakura_flag FROM r")
def src_reviews_strict(spark, d):
    r = ndjson.reviews(_parsed(spark, d))
    return r.select("line_no", "asin", F.col("reviewId").alias("review_id"), "url", "rating", F.col("bodyLength").alias("body_length"), "sakura_flag")


@query(f"WITH {_BASE} SELECT k AS line_no, CAST(lenient AS DOUBLE) AS rating, CAST(k % 100 AS INTEGER) AS body_length FROM r")
def src_reviews_lenient(spark, d):
    return ndjson.reviews(_parsed(spark, d), strict=False).select("line_no", "rating", F.col("bodyLength").alias("body_length"))


@query(f"WITH {_BASE} SELECT k AS line_no, asin, CASE WHEN k % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS captured_at, CAST(k % 5 AS DOUBLE) AS rating_average, CAST(k % 50 AS INTEGER) AS rating_count, CAST(k % 90 AS INTEGER) AS five, 10 AS four, CAST(NULL AS INTEGER) AS three FROM b WHERE m = 2")
def src_histogram_lines(spark, d):
    h = ndjson.histograms(_parsed(spark, d))
    return h.select("line_no", "asin", "captured_at", "rating_average", "rating_count", *[F.element_at("ratings_histogram", F.lit(s)).alias(n) for s, n in (("5", "five"), ("4", "four"), ("3", "three"))])


@query(f"WITH {_BASE} SELECT k AS line_no, asin, stars FROM ok")
def src_accepted(spark, d):
    return ndjson.accepted(ndjson.reviews(_parsed(spark, d)), _known(spark, d)).select("line_no", "asin", F.col("rating").alias("stars"))


_COUNTERS = "c AS (SELECT path, count(*) FILTER (m > 0) AS total, count(*) FILTER (m = 2) AS histogram, count(*) FILTER (m > 2) AS attempted FROM b GROUP BY path), s AS (SELECT path, count(*) AS n FROM ok GROUP BY path), f AS (SELECT path, total, histogram, attempted, coalesce(n, 0) AS succeeded, total - histogram - coalesce(n, 0) AS skipped FROM c LEFT JOIN s USING (path) WHERE total > 0)"


@query(f"WITH {_BASE}, {_COUNTERS} SELECT * FROM f")
def src_file_counters(spark, d):
    parsed = _parsed(spark, d)
    return ndjson.counters(parsed, ndjson.accepted(ndjson.reviews(parsed), _known(spark, d)))


@query(f"WITH {_BASE}, {_COUNTERS} SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(histogram) AS BIGINT) AS histogram, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(skipped) AS BIGINT) AS skipped FROM f")
def agg_intake_totals(spark, d):
    parsed = _parsed(spark, d)
    return ndjson.intake_totals(ndjson.counters(parsed, ndjson.accepted(ndjson.reviews(parsed), _known(spark, d))))


@query(f"WITH {_BASE} SELECT asin, count(*) AS n FROM r GROUP BY asin")
def src_dataset_filter(spark, d):
    return ndjson.adhoc_only(ndjson.reviews(_parsed(spark, d))).groupBy("asin").agg(F.count("*").alias("n"))


@query(f"WITH {_BASE}, h AS (SELECT asin, arg_max(k, path || lpad(CAST(k AS VARCHAR), 12, '0')) AS last FROM b WHERE m = 2 GROUP BY asin) SELECT b.asin, count(*) FILTER (m > 2) AS n_reviews, CASE WHEN count(*) FILTER (m > 2) > 0 THEN 'Adhoc' END AS dataset, string_agg(DISTINCT path, ',' ORDER BY path) AS sources, CAST(any_value(last) % 5 AS DOUBLE) AS rating_average FROM b LEFT JOIN h USING (asin) WHERE m > 1 GROUP BY b.asin")
def src_buckets(spark, d):
    parsed = _parsed(spark, d)
    b = ndjson.buckets(ndjson.reviews(parsed, strict=False), ndjson.histograms(parsed))
    return b.select("asin", "n_reviews", "dataset", F.array_join("sources", ",").alias("sources"), "histogram.rating_average")


@query(f"""WITH {_BASE}, a AS (SELECT asin, avg(lenient) AS mean, count(*) AS n, max(ts) AS latest, string_agg(DISTINCT path, ',' ORDER BY path) AS sources FROM r GROUP BY asin), h AS (SELECT asin, arg_max(k, path || lpad(CAST(k AS VARCHAR), 12, '0')) AS last FROM b WHERE m = 2 GROUP BY asin),
    t AS (SELECT asin, last % 5 AS avg_, last % 50 AS cnt, CASE WHEN last % 2 = 0 THEN strftime((SELECT ts FROM events WHERE event_id = last), '%Y-%m-%dT%H:%M:%SZ') END AS cap, last FROM h), j AS (SELECT coalesce(a.asin, t.asin) AS asin, CAST(coalesce(avg_, mean) AS DOUBLE) AS rating_average, CAST(coalesce(cnt, n, 0) AS BIGINT) AS rating_count, coalesce(n, 0) AS n_reviews, coalesce(cap, strftime(latest, '%Y-%m-%dT%H:%M:%SZ')) AS captured_at, sources FROM a FULL JOIN t ON a.asin = t.asin)
    SELECT *, CASE WHEN rating_average IS NOT NULL THEN floor(greatest(0.0, least(5.0, rating_average)) / 5.0 * 100.0 * 10.0 + 0.5) / 10.0 END AS score FROM j""")
def agg_snapshot_summary(spark, d):
    parsed = _parsed(spark, d)
    s = histograms.snapshot_summary(ndjson.reviews(parsed, strict=False).withColumn("source_path", F.col("path")), ndjson.histograms(parsed))
    return s.select("asin", "rating_average", "rating_count", "n_reviews", "captured_at", F.array_join("sources", ",").alias("sources"), "score")


def _files(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/"), F.concat(F.lit("B"), F.lpad((F.col("user_id") % 30).cast("string"), 9, "0")), F.lit("/f-"), F.col("event_id").cast("string"), F.lit(".NDJSON")).alias("path"), F.col("ts").alias("modified"))


_FILES = "f AS (SELECT '/data/' || event_type || '/B' || lpad(CAST(user_id % 30 AS VARCHAR), 9, '0') || '/f-' || event_id || '.NDJSON' AS path, ts AS modified, event_type, user_id % 30 AS u, event_id FROM events)"


@query(f"WITH {_FILES} SELECT path FROM f WHERE u = 7 ORDER BY lower(path), path")
def src_path_pruning(spark, d):
    return _files(spark, d).where(ndjson.path_matches(F.col("path"), " b000000007")).select("path").orderBy(F.lower("path"), "path")


@query(f"WITH {_FILES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path, modified FROM (SELECT *, row_number() OVER (PARTITION BY event_type, u ORDER BY modified DESC, path DESC) AS n FROM f) WHERE n = 1")
def win_latest_file(spark, d):
    return ndjson.latest_files(_files(spark, d)).select("folder", "path", "modified")


@query("SELECT event_id AS snapshot_id, CASE WHEN event_id % 3 = 0 THEN 'A1' ELSE 'kept' END AS asin, CASE WHEN event_id % 3 = 0 THEN 'whole' ELSE event_type END AS title, CASE WHEN event_id % 3 = 0 THEN value END AS average, CASE WHEN event_id % 3 = 0 THEN event_id END AS n, CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS partial FROM events")
def src_snapshot_decode(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    whole = F.concat(F.lit('{"asin":"A1","title":"whole","partial":false,"ratingCount":'), k.cast("string"), F.lit(',"ratingAverage":'), F.col("value").cast("string"), F.lit("}"))
    rows = e.select(k.alias("snapshot_id"), F.lit("kept").alias("asin"), F.col("event_type").alias("title"), F.when(k % 3 == 0, whole).when(k % 3 == 1, F.lit("{broken")).otherwise(F.lit("[1]")).alias("snapshot_json"))
    s = ndjson.decode_snapshots(rows, SNAPSHOT)
    return s.select("snapshot_id", "snapshot.asin", "snapshot.title", F.col("snapshot.ratingAverage").alias("average"), F.col("snapshot.ratingCount").alias("n"), "snapshot.partial")


@query("SELECT event_id AS snapshot_id, CAST(user_id AS VARCHAR) AS product_id, 'A1' AS asin, event_type AS title, value AS rating_average, event_id AS rating_count, CAST(event_id % 3 AS INTEGER) AS n_inline, event_id % 2 = 0 AS partial FROM events")
def flt_snapshot_listing(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    inline = F.transform(F.slice(F.array(*[F.lit(x) for x in "ab"]), F.lit(1), (k % 3).cast("int")), lambda t: F.struct(t.alias("title")))
    body = F.to_json(F.struct(F.lit("A1").alias("asin"), F.col("event_type").alias("title"), F.col("value").alias("ratingAverage"), k.alias("ratingCount"), inline.alias("inlineReviews"), (k % 2 == 0).alias("partial")))
    rows = e.select(k.alias("snapshot_id"), F.col("user_id").cast("string").alias("product_id"), F.lit(None).cast("string").alias("asin"), F.lit(None).cast("string").alias("title"), body.alias("snapshot_json"))
    return serving.list_snapshots(ndjson.decode_snapshots(rows, SNAPSHOT))


@query("SELECT url, min(page_id) AS n FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY url ORDER BY n")
def src_url_dedup(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("n"), F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return lists.first_of_each(p, "url", "n").select("url", "n")


@query(r"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS b FROM pages)
    SELECT page_id AS page_key, replace(trim(regexp_extract(b, '(?is)<title>(.*?)</title>', 1)), '&amp;', '&') AS title, CAST(len(regexp_extract_all(b, '(?i)<a\s[^>]*href')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(b, '(?i)<p[\s>]')) AS INTEGER) AS n_paragraphs,
    CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(b, '(?i)</?(b|i|em|strong|a|span)(\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM bare""")
def src_page_outlines(spark, d):
    """All pages through the HTML parser."""
    return html.page_outline(table(spark, d, "pages"), "page_id")


_PAGE = """<html><input id="ASIN" value="{asin}"><span id="productTitle"> {name} </span><a id="bylineInfo">ブランド: {brand}</a>
<div id="corePriceDisplay_desktop_feature_div"><span class="a-offscreen">￥{price}</span></div><span id="acrPopover" title="5つ星のうち{stars}"></span><span id="acrCustomerReviewText">{n}個の評価</span>
<ul id="histogramTable"><li><a href="?filterByStar=five_star" aria-label="52%">5</a><li><a href="?f=four_star" aria-label="26%">4</a></ul>
<div id="cm-cr-dp-review-list"><div data-hook="review" class="review" id="customer_review-R{n}"><a data-hook="review-title" href="/gp/x/dp/{asin}/"><span>T{n}</span></a><i data-hook="review-star-rating"><span class="a-icon-alt">5つ星のうち4.0</span></i>
<span data-hook="review-date">2024年1月{day}日に日本でレビュー済み</span><span data-hook="review-body"><span>Body {name}</span></span><span class="a-profile-name">P{n}</span><span data-hook="helpful-vote-statement">{n}人</span></div></div></html>"""


#: Pages that one task parses.
PAGES = 5_000


def _parts(spark, d):
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), PAGES)


def _pages(spark, d):
    """A product page for each part, written into one template."""
    p, k = _parts(spark, d), F.col("p_partkey")
    values = {"asin": F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")), "name": F.col("p_name"), "brand": F.col("p_brand"), "price": F.format_number(k * 7, 0), "stars": F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (k % 10).cast("string")), "n": (k % 900 + 1).cast("string"), "day": (k % 28 + 1).cast("string")}
    page = F.lit(_PAGE)
    for name, value in values.items():
        page = F.replace(page, F.lit("{" + name + "}"), value)
    return p.select(k.alias("page_id"), page.alias("html"))


@query("SELECT p_partkey AS page_key, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin, p_name AS title, p_brand AS brand, p_partkey * 7 AS price, CAST(CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS DOUBLE) AS average, p_partkey % 900 + 1 AS n, 52.0 AS five, 26.0 AS four, 0.0 AS one, 'Body ' || p_name AS body, 4 AS stars, false AS partial FROM part")
def src_product_pages(spark, d):
    s = html.parse_product_pages(_pages(spark, d), "page_id")
    share = lambda k: F.element_at("ratingSharePct", F.lit(k))
    first = F.get("inlineReviews", F.lit(0))
    return s.select("page_key", "asin", "title", "brand", F.col("priceMinor").alias("price"), F.col("ratingAverage").alias("average"), F.col("ratingCount").alias("n"), share(5).alias("five"), share(4).alias("four"), share(1).alias("one"), first["body"].alias("body"), first["stars"].alias("stars"), "partial")


@query("SELECT p_partkey AS page_key, 'R' || (p_partkey % 900 + 1) AS review_id, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin, 'T' || (p_partkey % 900 + 1) AS title, 5 AS rating, DATE '2024-01-01' + CAST(p_partkey % 28 AS INTEGER) AS review_date, 'P' || (p_partkey % 900 + 1) AS reviewer, 'https://www.amazon.co.jp/gp/x/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '/' AS url, p_partkey % 900 + 1 AS votes FROM part")
def src_review_lists(spark, d):
    r = html.parse_reviews(_pages(spark, d), "page_id")
    return r.select("page_key", F.col("reviewId").alias("review_id"), "asin", "title", "rating", F.col("reviewDate").alias("review_date"), "reviewer", "url", F.col("helpfulVotes").alias("votes"))


@query("SELECT p_partkey AS page_key, CASE WHEN p_partkey % 2 = 0 THEN 74 ELSE 0 END AS five, CASE WHEN p_partkey % 2 = 0 THEN 26 ELSE 0 END AS four, 0 AS one, CASE WHEN p_partkey % 2 = 0 THEN 5.0 END AS average, CAST(p_partkey % 900 + 1 AS INTEGER) AS n FROM part")
def src_rating_histograms(spark, d):
    """Every page, even ones in a layout whose rows carry their percentages as text, odd ones in one where only links do, which count for nothing here."""
    rows, even = F.col("html"), F.col("page_id") % 2 == 0
    told = F.regexp_replace(rows, r'<li><a href="\?filterByStar=five_star" aria-label="52%">5</a>', '<li><a aria-label="5 stars 52%">52%</a>')
    told = F.regexp_replace(told, r'<a href="\?f=four_star" aria-label="26%">4</a>', '<a aria-label="4 stars">26%</a>')
    told = F.regexp_replace(told, r'title="[^"]*"></span>', "> 5,0 / 5</span>")
    h = html.parse_histograms(_pages(spark, d).withColumn("html", F.when(even, told).otherwise(rows)), "page_id")
    share = lambda k: F.element_at("percentageByStar", F.lit(k))
    return h.select("page_key", share(5).alias("five"), share(4).alias("four"), share(1).alias("one"), F.col("averageRating").alias("average"), F.col("reviewCount").alias("n"))


_REVIEW = '<div data-hook="review"><a data-hook="review-title"><span>T</span></a><i data-hook="review-star-rating"><span>5つ星のうち4.0</span></i><span data-hook="review-date">d</span><span data-hook="review-body"><span>Body {name}</span></span>{badge}</div>'
#: A page's parts, in eight layouts: places that are asked first, places that are asked when those are missing or unfit, and nowhere.
_LAYOUTS = {
    0: '<input id="ASIN" value="{asin}"><span id="productTitle">{name}</span><a id="bylineInfo">ブランド: {brand}</a><div id="corePriceDisplay_desktop_feature_div"><span class="a-offscreen">￥{price}</span></div><span id="acrPopover" title="5つ星のうち{stars}"></span><span id="acrCustomerReviewText">{n}個の評価</span><div id="cm-cr-dp-review-list">{review}</div>',
    1: '<div id="detailBullets_feature_div"><ul><li>Size : 3</li><li><span>ASIN :</span> <span>{asin}</span></li></ul></div><span id="productTitle"> {name} </span><a id="bylineInfo">{brand}</a><span id="priceblock_ourprice">￥ {price}</span><span data-hook="rating-out-of-text">5つ星のうち{stars}</span><span data-hook="total-review-count">{n} ratings</span><div id="reviewsMedley">{review}{review}</div>',
    2: '<input id="ASIN" value="short"><table id="productDetails_detailBullets_sections1"><tr><th>Weight</th><td>1</td></tr><tr><th> ASIN </th><td> {asin} </td></tr></table><span id="productTitle">{name}</span><span id="priceblock_dealprice">{price}円</span><span id="acrPopover"></span><span data-hook="rating-out-of-text">{stars} / 5</span><a id="acrCustomerReviewLink"><span>{n}</span></a><div id="cm-cr-dp-review-list"></div><div id="reviewsMedley">{review}</div>',
    3: '<input id="ASIN" value="{asin}"><span id="productTitle">{name}</span><span id="acrPopover" title="5つ星のうち{stars}"></span><span id="acrCustomerReviewText">{n}</span><div id="cm-cr-dp-review-list">{review}</div>',
    4: '<input id="ASIN" value="{asin}"><span id="productTitle">{name}</span><span id="priceblock_ourprice">{price}</span><span id="acrPopover" title="{stars}"></span><span id="acrCustomerReviewText">{n}</span><ul id="histogramTable"><li><a href="?x=five_star">5</a><div class="a-meter" aria-valuenow="61"></div></li><li><a aria-label="4つ星">4</a><span class="a-text-right"><span>30%</span></span></li><li>1つ星 <a aria-label="9%">x</a></li></ul>',
    5: '<span id="productTitle">  </span><div id="imgTagWrapperId"><img id="landingImage" src="https://i/{n}.jpg" data-old-hires="https://i/{n}-big.jpg" data-a-dynamic-image="{{&quot;https://i/{n}.jpg&quot;:[1,2],&quot;https://i/{n}-2.jpg&quot;:[3,4]}}"></div><div id="imageBlock_feature_div"><img data-src="https://i/block.jpg"></div>',
    6: '<input id="ASIN" value="{asin}"><div id="feature-bullets"><ul class="a-unordered-list"><li><span class="a-list-item">One {n}</span></li><li><span class="a-list-item"> </span></li><li><span class="a-list-item">Two</span></li></ul></div><div id="main-image-container"><img src="https://i/main.jpg" data-a-dynamic-image="not json"></div>',
    7: '<div id="feature-bullets"><ul><li>Plain</li></ul></div><div id="detailBullets_feature_div"><ul><li>ASIN：{asin}</li></ul></div><div id="reviewsMedley"><div data-hook="review"></div></div>',
}


def _layouts(spark, d):
    p, k = _parts(spark, d), F.col("p_partkey")
    page = F.element_at(F.create_map(*[F.lit(x) for n, text in _LAYOUTS.items() for x in (n, "<html><body>" + text.replace("{review}", _REVIEW).replace("{{", "{").replace("}}", "}"))]), (k % 8).cast("int"))
    badge = F.when(k % 3 == 0, '<span data-hook="avp-badge">x</span>').when(k % 3 == 1, "<span>Amazonで購入</span>").otherwise("")
    values = {"asin": F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")), "name": F.col("p_name"), "brand": F.col("p_brand"), "price": F.format_number(k * 7, 0), "stars": F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (k % 10).cast("string")), "n": (k % 900 + 1).cast("string"), "badge": badge}
    for name, value in values.items():
        page = F.replace(page, F.lit("{" + name + "}"), value)
    return p.select(k.alias("page_id"), page.alias("html"))


@query(
    "WITH t AS (SELECT *, p_partkey % 8 AS l, CAST(p_partkey % 900 + 1 AS VARCHAR) AS n FROM part) SELECT p_partkey AS page_key, CASE WHEN l <> 5 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS asin, CASE WHEN l < 5 THEN p_name END AS title, CASE WHEN l < 2 THEN p_brand END AS brand, "
    "CASE WHEN l IN (0, 1, 2, 4) THEN p_partkey * 7 END AS price, CASE WHEN l < 5 THEN CAST(CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS DOUBLE) END AS average, CASE WHEN l < 5 THEN CAST(n AS INTEGER) END AS n, CASE WHEN l = 4 THEN 61.0 ELSE 0.0 END AS five, CASE WHEN l = 4 THEN 30.0 ELSE 0.0 END AS four, CASE WHEN l = 4 THEN 9.0 ELSE 0.0 END AS one, "
    "CASE l WHEN 5 THEN 'https://i/' || n || '-big.jpg,https://i/' || n || '.jpg,https://i/' || n || '-2.jpg,https://i/block.jpg' WHEN 6 THEN 'https://i/main.jpg' ELSE '' END AS images, CASE l WHEN 6 THEN 'One ' || n || ',Two' WHEN 7 THEN 'Plain' ELSE '' END AS bullets, "
    "CASE WHEN l IN (0, 2, 3) THEN 1 WHEN l = 1 THEN 2 ELSE 0 END AS n_reviews, CASE WHEN l < 4 THEN 'Body ' || p_name END AS body, CASE WHEN l < 4 AND p_partkey % 3 < 2 THEN true END AS verified, l > 2 AS partial FROM t"
)
def src_page_layouts(spark, d):
    """Every page in one of eight layouts: fallback places, missing and unfit parts, images, bullets, badges."""
    s = html.parse_product_pages(_layouts(spark, d), "page_id")
    share = lambda k: F.element_at("ratingSharePct", F.lit(k))
    first = F.get("inlineReviews", F.lit(0))
    return s.select("page_key", "asin", "title", "brand", F.col("priceMinor").alias("price"), F.col("ratingAverage").alias("average"), F.col("ratingCount").alias("n"), share(5).alias("five"), share(4).alias("four"), share(1).alias("one"), F.array_join("imageUrls", ",").alias("images"), F.array_join("featureBullets", ",").alias("bullets"), F.size("inlineReviews").alias("n_reviews"), first["body"].alias("body"), first["verified"].alias("verified"), "partial")


@query(f"WITH {_BASE} SELECT 'adhoc' AS dataset, asin, count(*) FILTER (m > 2) AS n_reviews, count(*) FILTER (m = 2) AS n_histograms FROM b WHERE m > 1 GROUP BY asin")
def snk_ndjson_lines(spark, d):
    parsed = _parsed(spark, d)
    lines = sinks.ndjson_lines(ndjson.reviews(parsed), ndjson.histograms(parsed))
    back = ndjson.parse(lines)
    return back.groupBy("dataset", "asin").agg(F.count_if(~F.col("is_histogram")).alias("n_reviews"), F.count_if("is_histogram").alias("n_histograms"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def snk_json_arrays(spark, d):
    j = sinks.as_json_array(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")
    rows = F.from_json("json", "array<struct<l_linenumber:bigint,l_partkey:bigint>>")
    return j.select("l_orderkey", F.size(rows).cast("long").alias("n"), F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x["l_linenumber"]).alias("total"))


@query(f"WITH {PRODUCTS} SELECT product_id, asin IS NOT NULL AND length(title) > 4 AS filled, nullif(CASE WHEN brand = 'Brand#2' THEN '  ' ELSE brand END, '  ') AS brand FROM products")
def src_text_fields(spark, d):
    p = products(spark, d)
    brand = blank_to_null(F.when(F.col("brand") == "Brand#2", "  ").otherwise(F.col("brand")))
    return p.select("product_id", (has_text(F.col("asin")) & (F.length("title") > 4)).alias("filled"), brand.alias("brand"))


@query("SELECT p_partkey AS page_key, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'p-B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS product_id, p_name AS product_name, TIMESTAMP '2024-02-01 00:00:00' AS created_at, p_partkey * 7 AS price FROM part")
def dml_intake_from_html(spark, d):
    pages = html.parse_product_pages(_pages(spark, d), "page_id").withColumn("source_url", F.concat(F.lit("https://x/"), F.col("page_key").cast("string")))
    pages = pages.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)  # read twice, parsed once
    _, snapshots = lifecycle.intake_pages(products(spark, d).where(F.col("product_id").cast("bigint") % 3 == 0), pages, "2024-02-01 00:00:00")
    return snapshots.select("page_key", "product_id", "product_name", "created_at", F.get_json_object("snapshot_json", "$.priceMinor").cast("bigint").alias("price"))
