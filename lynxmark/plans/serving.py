"""Queries of filters, joins, lists, upserts and state changes, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxmark.functions import text as T
from lynxmark.functions.hashing import fingerprint, reviewer_ref
from lynxmark.operators import lifecycle, merge, pages, search, serving
from lynxmark.plans.adapters import PRODUCTS, REVIEWS_NUM, REVIEWS_TEXT, products, reviews_num, reviews_text, table
from lynxmark.plans.files import scratch

Q: dict = {}
SQL: dict[str, str] = {}
NEWEST = "ORDER BY posted_at DESC NULLS LAST, review_id"
STAMP = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _num(spark, d):
    return reviews_num(spark, d).withColumn("created_at", F.col("posted_at"))


def _snapshots(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("dataset"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("uploaded_at"), F.lit(None).cast("string").alias("upload_target"), F.col("props").alias("snapshot_json"), "value")


SNAPSHOTS = "snapshots AS (SELECT event_id AS snapshot_id, CAST(user_id AS VARCHAR) AS product_id, event_type AS dataset, ts AS created_at, CASE WHEN event_type = 'purchase' THEN ts END AS uploaded_at, props AS snapshot_json, value FROM events)"


def _logs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("log_id"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("scope"), F.col("ts").alias("created_at"), F.col("props").alias("stack"))


LOGS = "logs AS (SELECT event_id AS log_id, CAST(user_id AS VARCHAR) AS actor, event_type AS scope, ts AS created_at, props AS stack FROM events)"


def _scores(spark, d):
    """Two scores a product: from part's price and size."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string").alias("product_id")
    a = p.where("p_partkey % 3 <> 0").select(key, F.lit("AMAZON").alias("source"), (F.col("p_size") * 2).cast("double").alias("score"), F.when(F.col("p_size") < 18, "A").when(F.col("p_size") < 33, "B").otherwise("C").alias("rank"), F.col("p_brand").alias("sakura_judge"))
    s = p.where("p_partkey % 4 <> 0").select(key, F.lit("SITE").alias("source"), F.col("p_size").cast("double").alias("score"), F.when(F.col("p_size") < 35, "A").otherwise("B").alias("rank"), F.col("p_type").alias("sakura_judge"))
    return a.union(s)


SCORES = """scores AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'AMAZON' AS source, CAST(p_size * 2 AS DOUBLE) AS score, CASE WHEN p_size < 18 THEN 'A' WHEN p_size < 33 THEN 'B' ELSE 'C' END AS rank, p_brand AS sakura_judge FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'SITE', CAST(p_size AS DOUBLE), CASE WHEN p_size < 35 THEN 'A' ELSE 'B' END, p_type FROM part WHERE p_partkey % 4 <> 0)"""


@query(f"WITH {REVIEWS_NUM} SELECT review_id, coalesce(CASE WHEN tax > 0.01 THEN rating END, rating, 0) AS stars, coalesce(CASE WHEN rating > 1 THEN reviewer END, '') AS body, coalesce(CASE WHEN tax > 0.02 THEN posted_at END, posted_at) AS created_at FROM reviews_num")
def flt_coalesced_projection(spark, d):
    r = reviews_num(spark, d)
    return r.select("review_id", F.coalesce(F.when(F.col("tax") > 0.01, F.col("rating")), "rating", F.lit(0)).alias("stars"), F.coalesce(F.when(F.col("rating") > 1, F.col("reviewer")), F.lit("")).alias("body"), F.coalesce(F.when(F.col("tax") > 0.02, F.col("posted_at")), "posted_at").alias("created_at"))


@query(f"WITH {REVIEWS_NUM} SELECT review_id, product_id, rating, posted_at FROM reviews_num WHERE source = 'AMAZON' {NEWEST}")
def flt_amazon_reviews(spark, d):
    r = _num(spark, d)
    return serving.amazon_reviews(r).select("review_id", "product_id", "rating", "posted_at").orderBy(F.col("posted_at").desc_nulls_last(), "review_id")


@query(f"WITH {REVIEWS_NUM} SELECT review_id, product_id, source, status FROM reviews_num WHERE source = 'AMAZON' OR status = 'APPROVED'")
def public_reviews(spark, d):
    return serving.public_reviews(_num(spark, d)).select("review_id", "product_id", "source", "status")


@query(f"WITH {REVIEWS_NUM} SELECT review_id, rating, posted_at FROM reviews_num WHERE product_id = '7' AND (source = 'AMAZON' OR status = 'APPROVED') {NEWEST} LIMIT 20")
def srt_public_page(spark, d):
    r = serving.public_reviews(_num(spark, d), "7")
    return r.orderBy(*serving.newest_first(r)).limit(serving.clamp_limit(20, 100)).select("review_id", "rating", "posted_at")


@query(f"WITH {REVIEWS_NUM} SELECT review_id, product_id, rating, posted_at FROM reviews_num WHERE source = 'USER' AND status = 'APPROVED'")
def flt_approved_user_reviews(spark, d):
    return serving.approved_user_reviews(_num(spark, d)).select("review_id", "product_id", "rating", "posted_at")


@query(f"WITH {REVIEWS_NUM} SELECT product_id, count(*) AS n FROM reviews_num WHERE source IN ('AMAZON', 'USER') AND status = 'PUBLISHED' GROUP BY product_id")
def flt_finders(spark, d):
    return serving.find_reviews(_num(spark, d), source=["AMAZON", "USER"], status="PUBLISHED").groupBy("product_id").agg(F.count("*").alias("n"))


@query(f"WITH {REVIEWS_NUM} SELECT review_id, posted_at FROM reviews_num WHERE status = 'PUBLISHED' {NEWEST} LIMIT 50")
def srt_published_list(spark, d):
    r = serving.find_reviews(_num(spark, d), status="PUBLISHED")
    return r.orderBy(*serving.newest_first(r)).limit(serving.clamp_limit(500, 50)).select("review_id", "posted_at")


@query(f"WITH {PRODUCTS} SELECT product_id, asin, title, updated_at FROM products WHERE (lower(title) LIKE '%re_%' OR lower(name) LIKE '%re_%' OR upper(asin) LIKE '%RE_%') AND visible AND publish_status = 'PUBLISHED' ORDER BY updated_at DESC, product_id")
def search_products(spark, d):
    found = serving.search_products(products(spark, d), q="re_", visible=True, status="PUBLISHED")
    return found.select("product_id", "asin", "title", "updated_at").orderBy(F.desc("updated_at"), "product_id")


@query(f"WITH {PRODUCTS} SELECT product_id, asin, title FROM products WHERE lower(title) LIKE '%widget%' OR lower(asin) LIKE '%widget%' ORDER BY updated_at DESC, product_id LIMIT 100")
def flt_simple_search(spark, d):
    return serving.simple_search(products(spark, d), "Widget", 1000).select("product_id", "asin", "title")


@query(f"WITH {PRODUCTS} SELECT product_id, title FROM products WHERE visible AND publish_status = 'PUBLISHED'")
def flt_visible_products(spark, d):
    return serving.visible_products(products(spark, d)).select("product_id", "title")


@query(f"WITH {PRODUCTS} SELECT product_id, updated_at FROM products WHERE visible ORDER BY updated_at DESC, product_id LIMIT 100")
def srt_top_visible(spark, d):
    return products(spark, d).where("visible").orderBy(F.desc("updated_at"), "product_id").limit(100).select("product_id", "updated_at")


@query(f"WITH {PRODUCTS} SELECT product_id, updated_at FROM products ORDER BY updated_at DESC, product_id LIMIT 200 OFFSET 400")
def srt_product_page(spark, d):
    return serving.page(products(spark, d), [F.desc("updated_at"), F.col("product_id")], 2, 500).select("product_id", "updated_at")


@query(f"WITH {PRODUCTS} SELECT product_id, brand, row_number() OVER (PARTITION BY brand ORDER BY updated_at DESC, product_id) AS ordinal FROM products")
def win_page_ordinal(spark, d):
    return serving.with_ordinal(products(spark, d), ["brand"], [F.desc("updated_at"), F.col("product_id")]).select("product_id", "brand", "ordinal")


@query(f"WITH {SNAPSHOTS} SELECT snapshot_id, created_at FROM snapshots WHERE uploaded_at IS NULL ORDER BY created_at DESC, snapshot_id LIMIT 500")
def flt_pending_uploads(spark, d):
    return serving.pending_uploads(_snapshots(spark, d)).orderBy(F.desc("created_at"), "snapshot_id").limit(serving.clamp_limit(900, 500)).select("snapshot_id", "created_at")


@query(f"WITH {PRODUCTS} SELECT product_id FROM products WHERE upper(asin) = 'B000000042'")
def flt_asin_ignoring_case(spark, d):
    return products(spark, d).where(serving.equal_ignoring_case("asin", "b000000042")).select("product_id")


@query(f"WITH {SNAPSHOTS} SELECT snapshot_id, dataset FROM snapshots WHERE snapshot_id IN (SELECT doc_id FROM documents)")
def flt_in_list(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("snapshot_id"))
    return serving.among(_snapshots(spark, d), "snapshot_id", ids).select("snapshot_id", "dataset")


@query(f"WITH {REVIEWS_NUM} SELECT review_id, source, status FROM reviews_num WHERE status IN ('PENDING', 'DRAFT') AND source = 'SITE'")
def mod_queue(spark, d):
    return serving.moderation_queue(_num(spark, d), " site ").select("review_id", "source", "status")


@query(f"WITH {REVIEWS_NUM}, q AS (SELECT review_id, posted_at, count(*) OVER () AS total FROM reviews_num WHERE status IN ('PENDING', 'DRAFT')) SELECT review_id, posted_at, total FROM q {NEWEST} LIMIT 25 OFFSET 50")
def mod_queue_page(spark, d):
    queue = serving.moderation_queue(_num(spark, d), "ALL")
    total = queue.agg(F.count("*").alias("total"))
    page = serving.page(queue, serving.newest_first(queue), 3 - 1, 25)
    return page.select("review_id", "posted_at").crossJoin(F.broadcast(total))  # one row: the page's total


@query("SELECT page_id, contains(lower(html), 'captcha') AS captcha, contains(lower(html), 'captcha') OR contains(lower(html), 'robot check') OR contains(lower(html), 'enter the characters') OR contains(lower(html), 'signin') AS blocked, contains(lower(html), 'ap_login_form') OR contains(lower(html), 'ap_email_login') OR contains(lower(html), 'validatecaptcha') OR contains(lower(html), 'robot check') OR (contains(lower(html), 'signin') AND contains(lower(html), 'ap_password')) AS login FROM pages")
def flt_blocked_pages(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", T.is_captcha(h).alias("captcha"), T.is_blocked_page(h).alias("blocked"), T.needs_login(h).alias("login"))


@query(f"WITH {REVIEWS_TEXT} SELECT review_id, CASE WHEN toxic = 0 THEN author END AS reviewer, coalesce(CASE WHEN stars > 1 THEN body END, lang) AS body, coalesce(CASE WHEN quality IS NOT NULL THEN stars END, 0) AS stars FROM reviews")
def flt_privacy_view(spark, d):
    r = reviews_text(spark, d)
    rows = r.select("review_id", F.col("author").alias("reviewer"), (F.col("toxic") == 0).alias("reviewer_public"), F.when(F.col("stars") > 1, F.col("body")).alias("body"), F.col("lang").alias("text"), F.when(F.col("quality").isNotNull(), F.col("stars")).alias("stars"))
    return serving.privacy_view(rows)


@query(f"WITH {PRODUCTS} SELECT product_id, regexp_full_match(CASE WHEN visible THEN url ELSE name END, 'https://www\\.amazon\\.co\\.jp/(?:dp|gp/product)/[A-Z0-9]{{10}}(?:/)?(?:\\?.*)?') OR regexp_full_match(CASE WHEN publish_status = 'DRAFT' THEN asin ELSE lower(asin) END, '[A-Z0-9]{{10}}') AS ok FROM products")
def flt_valid_target(spark, d):
    p = products(spark, d)
    return p.select("product_id", serving.valid_target(F.when(F.col("visible"), F.col("url")).otherwise(F.col("name")), F.when(F.col("publish_status") == "DRAFT", F.col("asin")).otherwise(F.lower("asin"))).alias("ok"))


@query("SELECT conv_id, turn, left(role || text, 200) AS title, CASE WHEN floor(turn + 0.5) < 1 OR floor(turn + 0.5) > 5 THEN 'stars' WHEN NOT regexp_matches(text, '\\S') THEN 'body missing' WHEN length(text) > 1000 THEN 'body too long' END AS problem FROM conversations")
def flt_user_review_check(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("double").alias("stars"), F.concat("role", "text").alias("title"), F.col("text").alias("body"))
    return serving.checked_user_reviews(c).select("conv_id", "turn", "title", "problem")


@query(f"WITH {SNAPSHOTS} SELECT snapshot_id FROM snapshots WHERE product_id = '17' AND (lower(dataset) = 'click')")
def flt_snapshot_lookup(spark, d):
    s = _snapshots(spark, d).withColumn("asin", F.concat(F.lit(" "), F.col("product_id")))
    return serving.find_snapshot(s, "17 ", " Click ").select("snapshot_id")


@query(f"WITH {LOGS} SELECT log_id, actor, scope, NULL AS stack FROM logs ORDER BY created_at DESC, log_id LIMIT 100")
def flt_log_view(spark, d):
    return serving.newest_logs(serving.log_view(_logs(spark, d)), "log_id", 0).select("log_id", "actor", "scope", "stack")


@query(f"WITH {LOGS} SELECT log_id, scope, stack FROM logs WHERE scope = 'error' ORDER BY created_at DESC, log_id LIMIT 40")
def srt_newest_exceptions(spark, d):
    return serving.newest_logs(_logs(spark, d), "log_id", 40, scope="error").select("log_id", "scope", "stack")


@query(f"WITH {PRODUCTS} SELECT product_id FROM products WHERE url = 'https://www.amazon.co.jp/dp/B000000090' OR asin = 'B000000007' ORDER BY product_id LIMIT 1")
def flt_by_url_or_asin(spark, d):
    return serving.find_by_url_or_asin(products(spark, d), "https://www.amazon.co.jp/dp/B000000090", "B000000007").select("product_id")


@query(f"WITH {PRODUCTS} SELECT count(*) > 0 AS found FROM products WHERE lower(name) = 'red widget'")
def flt_exists(spark, d):
    return serving.exists(products(spark, d), F.lower("name") == "red widget")


@query(f"WITH {PRODUCTS}, {SNAPSHOTS} SELECT s.snapshot_id, p.title, p.asin FROM snapshots s JOIN products p USING (product_id) ORDER BY s.created_at DESC, s.snapshot_id LIMIT 500")
def jn_snapshots_products(spark, d):
    return serving.joined_snapshots(_snapshots(spark, d), products(spark, d)).orderBy(F.desc("created_at"), "snapshot_id").limit(500).select("snapshot_id", "title", "asin")


@query(f"WITH {PRODUCTS}, {SCORES} SELECT product_id, p.name AS label, p.url, s.score, s.rank, s.sakura_judge FROM scores s JOIN products p USING (product_id) WHERE s.source = 'AMAZON' ORDER BY product_id")
def jn_feature_export(spark, d):
    return serving.scores_with_products(_scores(spark, d), products(spark, d)).select("product_id", F.col("name").alias("label"), "url", "score", "rank", "sakura_judge").orderBy("product_id")


@query(f"WITH {PRODUCTS}, {SCORES} SELECT p.name AS label, s.sakura_judge, count(*) AS n FROM scores s JOIN products p USING (product_id) WHERE s.source = 'AMAZON' GROUP BY ALL ORDER BY label, sakura_judge")
def jn_stored_confusion(spark, d):
    return serving.scores_with_products(_scores(spark, d), products(spark, d)).groupBy(F.col("name").alias("label"), "sakura_judge").agg(F.count("*").alias("n")).orderBy("label", "sakura_judge")


@query("SELECT l.doc_id AS review_id, coalesce(CASE WHEN l.quality = 1 THEN 'own' END, d.source) AS product_id FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'es') d USING (doc_id)")
def jn_legacy_scores(spark, d):
    legacy = table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), F.when(F.col("quality") == 1, "own").alias("product_id"))
    reviews = table(spark, d, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("review_id"), F.col("source").alias("product_id"))
    return serving.scores_with_reviews(legacy, reviews)


@query(f"WITH {PRODUCTS} SELECT product_id, title FROM products p WHERE EXISTS (SELECT 1 FROM part t WHERE t.p_name = p.name AND t.p_type = 'ECONOMY' AND CAST(t.p_partkey AS VARCHAR) = p.product_id)")
def tag_semi_join(spark, d):
    p = products(spark, d)
    tags = p.select(F.col("tag").alias("name")).distinct().select("name", F.xxhash64("name").alias("tag_id"))
    bridge = p.select("product_id", F.xxhash64("tag").alias("tag_id"))
    return serving.with_tag(p, bridge, tags, "ECONOMY").select("product_id", "title")


@query(f"WITH {PRODUCTS}, {SNAPSHOTS} SELECT s.snapshot_id, coalesce(CASE WHEN s.dataset = 'click' THEN 'known' END, nullif(p.title, 'small ring')) AS product_name FROM snapshots s LEFT JOIN products p USING (product_id)")
def jn_update_from(spark, d):
    s = _snapshots(spark, d).withColumn("product_name", F.when(F.col("dataset") == "click", "known"))
    return serving.fill_from(s, products(spark, d), "product_id", "product_name", F.nullif("title", F.lit("small ring"))).select("snapshot_id", "product_name")


@query("SELECT r.doc_id + 500 AS ordinal, r.doc_id * 3 AS snapshot_id, e.event_type AS dataset, e.event_id IS NOT NULL AS found FROM documents r LEFT JOIN (SELECT * FROM events WHERE event_type <> 'view') e ON e.event_id = r.doc_id * 3 ORDER BY ordinal")
def jn_requested_order(spark, d):
    ids = table(spark, d, "documents").select((F.col("doc_id") * 3).alias("snapshot_id"), (F.col("doc_id") + 500).alias("ordinal"))
    return serving.in_requested_order(ids, _snapshots(spark, d).where("dataset <> 'view'").select("snapshot_id", "dataset"), "snapshot_id")


@query(f"WITH {PRODUCTS}, {SCORES} SELECT product_id, coalesce(score, 0.0) AS score, coalesce(rank, 'A') AS rank FROM products LEFT JOIN (SELECT * FROM scores WHERE source = 'SITE') USING (product_id)")
def jn_products_with_scores(spark, d):
    return serving.products_with_scores(products(spark, d), _scores(spark, d).where("source = 'SITE'")).select("product_id", "score", "rank")


@query(f"WITH {SCORES} SELECT product_id, max(score) FILTER (source = 'AMAZON') AS amazon, max(score) FILTER (source = 'SITE') AS site FROM scores GROUP BY product_id")
def jn_scores_by_source(spark, d):
    return serving.scores_by_source(_scores(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT product_id, snapshot_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, snapshot_id DESC) AS n FROM snapshots) WHERE n = 1")
def latest_snapshot(spark, d):
    return serving.latest(_snapshots(spark, d), ["product_id"], "created_at", "snapshot_id").select("product_id", "snapshot_id", "created_at")


@query(f"WITH {REVIEWS_NUM}, b AS (SELECT *, CASE WHEN source = 'AMAZON' THEN 'amazon' ELSE 'user' END AS bucket FROM reviews_num WHERE source = 'AMAZON' OR (source = 'USER' AND status = 'APPROVED')) SELECT product_id, bucket, review_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY product_id, bucket ORDER BY posted_at DESC NULLS LAST, review_id) AS nth FROM b) WHERE nth <= 3")
def grouped_reviews(spark, d):
    return serving.grouped_reviews(_num(spark, d), 3).select("product_id", "bucket", "review_id", "nth")


# Upserts: the first half of the events is the table, the second the batch, in event order.
_SPLIT = "e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS product_id, event_type AS source, CASE WHEN event_id % 3 > 0 THEN value END AS rating, CASE WHEN event_id % 5 > 0 THEN props END AS body, ts FROM events), cut AS (SELECT max(event_id) // 2 AS c FROM events)"


def _halves(spark, d):
    e = table(spark, d, "events")
    cut = e.agg(F.expr("max(event_id) div 2 AS c"))
    rows = e.select("event_id", F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("rating"), F.when(F.col("event_id") % 5 > 0, F.col("props")).alias("body"), F.col("ts").alias("updated_at"))
    rows = rows.crossJoin(F.broadcast(cut))  # one row
    old, new = rows.where("event_id <= c").drop("c"), rows.where("event_id > c").drop("c")
    return merge.fold(old, ["product_id", "source"], ["event_id"], {}, merge.COALESCE), new.drop("updated_at")



_KEYS = "k AS (SELECT product_id, source, arg_max(rating, event_id) FILTER (rating IS NOT NULL AND event_id <= c) AS r0, arg_max(rating, event_id) FILTER (rating IS NOT NULL AND event_id > c) AS r1, arg_max(body, event_id) FILTER (body IS NOT NULL AND event_id <= c) AS b0, arg_max(body, event_id) FILTER (body IS NOT NULL AND event_id > c) AS b1, max(ts) FILTER (event_id <= c) AS t0, count(*) FILTER (event_id > c) AS fresh, max(event_id) FILTER (event_id > c) AS last1, arg_max(event_id, event_id) FILTER (event_id > c) AS l FROM e, cut GROUP BY ALL)"


@query(f"WITH {_SPLIT}, {_KEYS.replace('GROUP BY ALL', 'GROUP BY product_id, source')} SELECT product_id, source, coalesce(r1, r0) AS rating, coalesce(b1, b0) AS body, CASE WHEN fresh > 0 THEN TIMESTAMP '{STAMP}' ELSE t0 END AS updated_at FROM k")
def upsert_reviews(spark, d):
    old, new = _halves(spark, d)
    return merge.merge(old, new, ["product_id", "source"], ["event_id"], stamp=STAMP)


@query(f"WITH {_SPLIT}, {_KEYS.replace('GROUP BY ALL', 'GROUP BY product_id, source')} SELECT k.product_id, k.source, CASE WHEN fresh > 0 THEN x.rating ELSE r0 END AS rating, coalesce(b1, b0) AS body, CASE WHEN fresh > 0 THEN TIMESTAMP '{STAMP}' ELSE t0 END AS updated_at FROM k LEFT JOIN e x ON x.event_id = k.last1")
def upsert_overwrite(spark, d):
    old, new = _halves(spark, d)
    return merge.merge(old, new, ["product_id", "source"], ["event_id"], {"body": merge.COALESCE}, merge.OVERWRITE, STAMP)


@query(f"WITH {_SPLIT}, {_KEYS.replace('GROUP BY ALL', 'GROUP BY product_id, source')} SELECT (SELECT count(*) FROM e, cut WHERE event_id > c) - count(*) FILTER (fresh > 0 AND t0 IS NOT NULL) AS inserted, count(*) FILTER (fresh > 0 AND t0 IS NOT NULL) AS updated FROM k")
def upsert_estimate(spark, d):
    old, new = _halves(spark, d)
    key = F.concat_ws("/", "product_id", "source").alias("key")
    return merge.estimate_upsert(new.select(key), old.select(key), "key")


@query("SELECT conv_id, turn, sha256(CASE WHEN role = 'system' THEN '' ELSE role END || '|' || text || CASE WHEN turn % 2 = 0 THEN '|' || lower(trim(role)) ELSE '|' || 'https://x/' || turn END || CASE WHEN turn % 3 = 0 THEN '|' || CAST(turn AS VARCHAR) ELSE '' END) AS fingerprint FROM conversations WHERE regexp_matches(text, '\\S')")
def fingerprint_dedup(spark, d):
    c = table(spark, d, "conversations").where(F.col("text").rlike(r"\S"))
    title = F.when(F.col("role") != "system", F.col("role"))
    ref = reviewer_ref(F.col("role"), F.when(F.col("turn") % 2 != 0, F.concat(F.lit("https://x/"), F.col("turn").cast("string"))))
    day = F.when(F.col("turn") % 3 == 0, F.date_add(F.lit("1970-01-01").cast("date"), F.col("turn").cast("int")))
    return c.select("conv_id", "turn", fingerprint(title, F.col("text"), ref, day).alias("fingerprint"))


_KIND = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'PROGRESS' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END"


def _jobs(spark, d):
    e, t = table(spark, d, "events"), F.col("event_type")
    kind = F.when(t == "signup", "QUEUED").when(t == "view", "PROGRESS").when(t == "click", "RUNNING").when(t == "purchase", "SUCCEEDED").otherwise("FAILED")
    return lifecycle.fold_jobs(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), F.when(t == "view", F.col("value")).alias("collected"), F.when(t == "purchase", F.col("value")).alias("upserted"), F.lit("E1").alias("code"), F.col("props").alias("message")))


_JOBS = f"""j AS (SELECT user_id AS job_id, arg_max(kind, event_id) FILTER (kind <> 'PROGRESS') AS status, count(*) FILTER (kind = 'RUNNING') AS attempt_count, min(ts) FILTER (kind = 'RUNNING') AS started_at, min(ts) FILTER (kind IN ('SUCCEEDED', 'FAILED')) AS finished_at,
    arg_max(value, event_id) FILTER (kind = 'PROGRESS') AS collected, arg_max(value, event_id) FILTER (kind = 'SUCCEEDED') AS upserted, 'E1: ' || arg_max(props, event_id) FILTER (kind = 'FAILED') AS last_error FROM (SELECT *, {_KIND} AS kind FROM events) GROUP BY user_id)"""


@query(f"WITH {_JOBS} SELECT * FROM j")
def dml_job_states(spark, d):
    return _jobs(spark, d)


@query(f"WITH {_JOBS} SELECT job_id, attempt_count FROM j WHERE status = 'FAILED'")
def flt_jobs_by_state(spark, d):
    return serving.find_reviews(_jobs(spark, d), status="FAILED").select("job_id", "attempt_count")


_DECIDED = "d AS (SELECT review_id, rating >= 3 AS approve, 'admin' AS actor, reviewer AS reason, posted_at AS decided_at FROM reviews_num WHERE CAST(product_id AS BIGINT) % 3 = 0)"


def _decisions(spark, d):
    r = reviews_num(spark, d).where(F.col("product_id").cast("bigint") % 3 == 0)
    return r.select("review_id", (F.col("rating") >= 3).alias("approve"), F.lit("admin").alias("actor"), F.col("reviewer").alias("reason"), F.col("posted_at").alias("at")).dropDuplicates(["review_id"])


def _open_reviews(spark, d):
    none = lambda t: F.lit(None).cast(t)
    return reviews_num(spark, d).dropDuplicates(["review_id"]).select("review_id", "status", none("boolean").alias("visible"), none("string").alias("moderated_by"), none("string").alias("moderated_reason"), none("timestamp_ntz").alias("moderated_at"))


def _moderated_sql(takes: str) -> str:
    new = {"status": "CASE WHEN approve THEN 'APPROVED' ELSE 'REJECTED' END", "visible": "approve", "moderated_by": "actor", "moderated_reason": "reason", "moderated_at": "decided_at"}
    old = {"status": "r.status"}
    return f"WITH {REVIEWS_NUM}, {_DECIDED} SELECT DISTINCT review_id, " + ", ".join(f"CASE WHEN {takes} THEN {v}{f' ELSE {old[k]}' if k in old else ''} END AS {k}" for k, v in new.items()) + " FROM reviews_num r LEFT JOIN d USING (review_id)"


@query(_moderated_sql("approve IS NOT NULL"))
def dml_moderate(spark, d):
    return lifecycle.moderate(_open_reviews(spark, d), _decisions(spark, d))


@query(_moderated_sql("approve IS NOT NULL AND r.status IN ('DRAFT', 'PENDING')"))
def dml_moderate_pending(spark, d):
    return lifecycle.moderate(_open_reviews(spark, d), _decisions(spark, d), need_pending=True)


@query(f"WITH {REVIEWS_NUM}, {_DECIDED} SELECT DISTINCT review_id AS target_id, CASE WHEN approve THEN 'REVIEW_APPROVE' ELSE 'REVIEW_REJECT' END AS action, decided_at AS created_at FROM d WHERE review_id IN (SELECT review_id FROM reviews_num WHERE status IN ('DRAFT', 'PENDING'))")
def dml_moderation_audit(spark, d):
    return lifecycle.moderation_audit(_open_reviews(spark, d), _decisions(spark, d)).select("target_id", "action", "created_at")


_ASK = "ask AS (SELECT 'B' || lpad(CAST(s_suppkey * 40 AS VARCHAR), 9, '0') AS asin, s_name AS title, 'n' || s_suppkey AS product_id FROM supplier)"


@query(f"WITH {PRODUCTS}, {_ASK} SELECT coalesce(p.product_id, a.product_id) AS product_id, coalesce(p.asin, a.asin) AS asin, coalesce(p.title, a.title) AS title, coalesce(p.publish_status, 'DRAFT') AS publish_status, coalesce(p.visible, true) AS visible, CASE WHEN a.asin IS NOT NULL THEN TIMESTAMP '{STAMP}' ELSE p.updated_at END AS updated_at FROM products p FULL JOIN ask a ON p.asin = a.asin")
def dml_register_products(spark, d):
    ask = table(spark, d, "supplier").select(F.concat(F.lit("B"), F.lpad((F.col("s_suppkey") * 40).cast("string"), 9, "0")).alias("asin"), F.col("s_name").alias("title"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("product_id"))
    return lifecycle.register_products(products(spark, d), ask, STAMP).select("product_id", "asin", "title", "publish_status", "visible", "updated_at")


@query(f"WITH {PRODUCTS} SELECT product_id, CASE WHEN tag = 'ECONOMY' THEN 'ARCHIVED' ELSE publish_status END AS publish_status, CASE WHEN tag = 'ECONOMY' THEN false ELSE visible END AS visible, CASE WHEN tag = 'ECONOMY' THEN TIMESTAMP '{STAMP}' END AS hidden_at, CASE WHEN tag = 'ECONOMY' THEN TIMESTAMP '{STAMP}' ELSE updated_at END AS updated_at FROM products")
def dml_archive(spark, d):
    p = products(spark, d)
    return lifecycle.transition(p, p.where("tag = 'ECONOMY'"), "archive", STAMP).select("product_id", "publish_status", "visible", "hidden_at", "updated_at")


@query(f"WITH {PRODUCTS} SELECT product_id, CASE WHEN publish_status = 'DRAFT' THEN 'PUBLISHED' ELSE publish_status END AS publish_status, visible OR publish_status = 'DRAFT' AS visible, CASE WHEN publish_status = 'DRAFT' THEN TIMESTAMP '{STAMP}' END AS published_at FROM products")
def dml_publish(spark, d):
    p = products(spark, d)
    return lifecycle.transition(p, p.where("publish_status = 'DRAFT'"), "publish", STAMP).select("product_id", "publish_status", "visible", "published_at")


@query(f"WITH {SNAPSHOTS} SELECT snapshot_id, CASE WHEN dataset = 'click' THEN TIMESTAMP '{STAMP}' ELSE uploaded_at END AS uploaded_at, CASE WHEN dataset = 'click' THEN 'store' END AS upload_target FROM snapshots")
def dml_mark_uploaded(spark, d):
    s = _snapshots(spark, d)
    return lifecycle.mark_uploaded(s, s.where("dataset = 'click'"), "store", STAMP).select("snapshot_id", "uploaded_at", "upload_target")


@query("SELECT event_id, upper(nullif(event_type, 'x')) AS status, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'UNKNOWN') AS scope, CAST(floor(value + 0.5) AS INTEGER) AS score FROM events")
def dml_backfills(spark, d):
    e = table(spark, d, "events").select("event_id", lifecycle.normalized_status(F.col("event_type")).alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("scope"), F.floor(F.col("value") + 0.5).cast("int").alias("score"))
    return lifecycle.backfilled(e, {"scope": F.lit("UNKNOWN")})


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[rid=' || doc_id || '] ' || source ELSE source END AS message, left(text || text || text || text || text || text || text || text, 20000) AS stack, TIMESTAMP '{STAMP}' AS created_at FROM documents")
def snk_exception_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("message"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("request_id"), F.repeat("text", F.lit(8)).alias("stack"))
    return lifecycle.exception_rows(rows, STAMP).select("doc_id", "message", "stack", "created_at")


_ORDER = [("updated_at", True), ("product_id", False)]


@query(f"""WITH {PRODUCTS}, n AS (SELECT product_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, product_id) - 1 AS place FROM products)
    SELECT place // 90 AS page_no, product_id, updated_at FROM n WHERE place // 90 IN (0, 2, 5) OR place // 90 = (SELECT max(place) // 90 FROM n)""")
def srt_deep_pages(spark, d):
    """First, some and last pages of a table laid out for that, each from the range that holds it."""
    laid = pages.PageDirectory.build(products(spark, d), scratch(spark, "pages"), _ORDER, rows=128)
    last = (laid.total() - 1) // 90
    found = [laid.page(n, 90).select(F.lit(n).cast("long").alias("page_no"), "product_id", "updated_at") for n in sorted({0, 2, 5, last})]
    return reduce(DataFrame.union, found)


@query(f"WITH {PRODUCTS} SELECT product_id, row_number() OVER (ORDER BY updated_at DESC, product_id) AS ordinal FROM products")
def win_whole_order(spark, d):
    """Each product's place among all, numbered range by range."""
    return pages.PageDirectory.build(products(spark, d), scratch(spark, "order"), _ORDER, rows=128).numbered().select("product_id", "ordinal")


@query(f"""WITH {PRODUCTS}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(title), ' ')) AS word FROM products), asked AS (SELECT word AS q FROM w UNION SELECT right(word, 4) FROM w)
    SELECT q, product_id FROM asked JOIN products ON contains(lower(title), q) WHERE length(q) >= 3""")
def search_by_trigrams(spark, d):
    """Where each of many texts occurs in names, by postings."""
    rows = products(spark, d)
    words = rows.select(F.explode(F.split(F.lower("title"), " ")).alias("word"))
    asked = words.select(F.explode(F.array("word", F.right("word", F.lit(4)))).alias("q")).distinct()
    return search.TrigramIndex(spark, scratch(spark, "grams"), 16).build(rows, "product_id", ["title", "asin"]).contain(rows, "product_id", "title", asked)


@query(f"WITH {PRODUCTS} SELECT 'title' AS field, product_id FROM products WHERE lower(title) LIKE '%re%d%' UNION ALL SELECT 'long', product_id FROM products WHERE lower(title) LIKE '%part_1%' UNION ALL SELECT 'asin', product_id FROM products WHERE lower(asin) LIKE '%b00000012%'")
def search_patterns_by_trigrams(spark, d):
    """Patterns with wild cards by their fixed parts; one without any of three characters by all rows."""
    rows = products(spark, d)
    index = search.TrigramIndex(spark, scratch(spark, "grams"), 16).build(rows, "product_id", ["title", "asin"])
    found = [index.like(rows, "product_id", f, q).select(F.lit(name).alias("field"), "product_id") for name, f, q in (("title", "title", "Re%d"), ("long", "title", "part_1"), ("asin", "asin", "B00000012"))]
    return reduce(DataFrame.union, found)
