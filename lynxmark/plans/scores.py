"""Queries of features, scores, rules, heuristics, histograms and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark.functions.numbers import to_score
from lynxmark.operators import evaluation, features, heuristics, histograms, rules, scoring
from lynxmark.plans.adapters import AS_OF, PRODUCTS, REVIEWS_NUM, REVIEWS_TEXT, SQL_EMOJI_EVAL, SQL_EMOJI_SITE, SQL_RUN, SQL_URL, products, reviews_num, reviews_text, sql_java_trim, sql_squeeze, squeeze, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _site(spark: SparkSession, d: str) -> DataFrame:
    return features.site_features(reviews_text(spark, d), normalize=squeeze)


def _percent_sql(body: str, key: str, emoji: str) -> str:
    return f"""rows_ AS (SELECT product_id, stars, review_date AS day, {body} AS body FROM reviews),
    keyed AS (SELECT product_id, {key} AS k FROM rows_),
    clusters AS (SELECT product_id, max(n) AS max_cluster FROM (SELECT product_id, k, count(*) AS n FROM keyed WHERE k IS NOT NULL GROUP BY ALL) GROUP BY product_id),
    days AS (SELECT product_id, max(n) AS max_day, count(*) AS days FROM (SELECT product_id, day, count(*) AS n FROM rows_ WHERE day IS NOT NULL GROUP BY ALL) GROUP BY product_id),
    base AS (SELECT product_id, count(*) AS total_reviews, count(*) FILTER (stars >= 5) AS five_star, count(*) FILTER (body <> '' AND regexp_matches(body, '{SQL_URL}')) AS url_hits,
        count(*) FILTER (body <> '' AND regexp_matches(body, '{emoji}')) AS emoji_hits, count(*) FILTER (body <> '' AND regexp_matches(body, '{SQL_RUN}')) AS symbol_runs, count(*) FILTER (length(body) < 60) AS short_reviews FROM rows_ GROUP BY product_id),
    feats AS (SELECT product_id, total_reviews, five_star, CAST(five_star AS DOUBLE) / total_reviews * 100.0 AS dist_bias, CAST(coalesce(max_cluster, 0) AS DOUBLE) / total_reviews * 100.0 AS duplicates,
        CASE WHEN coalesce(days, 0) > 0 THEN least(100.0, max_day / (CAST(total_reviews AS DOUBLE) / days) * 100.0) ELSE 0.0 END AS surge,
        least(100.0, (CAST(url_hits AS DOUBLE) / total_reviews * 0.4 + CAST(emoji_hits AS DOUBLE) / total_reviews * 0.2 + CAST(symbol_runs AS DOUBLE) / total_reviews * 0.2 + CAST(short_reviews AS DOUBLE) / total_reviews * 0.2) * 100.0) AS noise,
        CAST(coalesce(max_cluster, 0) AS BIGINT) AS max_duplicate_cluster, CAST(coalesce(max_day, 0) AS BIGINT) AS max_day_reviews, CAST(coalesce(days, 0) AS BIGINT) AS day_buckets,
        CASE WHEN days > 0 THEN CAST(total_reviews AS DOUBLE) / days ELSE 0.0 END AS avg_per_day, url_hits, emoji_hits, symbol_runs, short_reviews FROM base LEFT JOIN clusters USING (product_id) LEFT JOIN days USING (product_id))"""


SITE_SQL = f"WITH {REVIEWS_TEXT}, {_percent_sql(sql_java_trim('coalesce(body, chr(32))'), f'nullif({sql_squeeze("body")}, {chr(39) * 2})', SQL_EMOJI_SITE)}"
_STRIP = r"regexp_replace(regexp_replace(coalesce(body, ' '), '^[\s\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x1c-\x1f\x{85}\p{Z}]+$', '')"
EVAL_SQL = f"WITH {REVIEWS_TEXT}, {_percent_sql(_STRIP, 'nullif(body, ' + chr(39) * 2 + ')', SQL_EMOJI_EVAL)}"
_V = lambda d, u, c: f"CASE WHEN {d} >= {c[0]} AND {u} >= {c[1]} THEN 'SAKURA' WHEN {d} >= {c[2]} OR {u} >= {c[3]} THEN 'LIKELY' WHEN {d} >= {c[4]} THEN 'UNLIKELY' ELSE 'GENUINE' END"
_PCT, _RATIO = (80, 50, 65, 40, 45), (0.8, 0.5, 0.65, 0.4, 0.45)
_P = {"dist_bias": 0.35, "duplicates": 0.35, "surge": 0.2, "noise": 0.1}
_POINTS = ", ".join(f"CAST(floor(greatest(0.0, least(1.0, {k} / 100.0)) * {w} * 100.0 + 0.5) AS INTEGER) AS points_{k}" for k, w in _P.items())
SCORED = f"""{SITE_SQL}, pts AS (SELECT *, {_POINTS} FROM feats),
    scored AS (SELECT *, floor(least(100.0, CAST(points_dist_bias + points_duplicates + points_surge + points_noise AS DOUBLE)) * 10.0 + 0.5) / 10.0 AS risk FROM pts)"""
_FLAGS = "concat_ws(',', CASE WHEN dist_bias >= 65 THEN 'ATTN_DISTRIBUTION' END, CASE WHEN duplicates >= 40 THEN 'ATTN_DUPLICATE' END, CASE WHEN surge >= 40 THEN 'ATTN_SURGE' END, CASE WHEN noise >= 35 THEN 'ATTN_NOISE' END)"
_RANK = "CASE WHEN risk < 35 THEN 'A' WHEN risk < 65 THEN 'B' ELSE 'C' END"


@query(f"{SITE_SQL} SELECT * FROM feats")
def agg_site_features(spark, d):
    return _site(spark, d)


@query(f"{SCORED} SELECT product_id, total_reviews, points_dist_bias, points_duplicates, points_surge, points_noise, risk, greatest(0.0, 100.0 - risk) AS display, {_RANK} AS rank, {_FLAGS} AS flags, {_V('dist_bias', 'duplicates', _PCT)} AS verdict FROM scored ORDER BY risk DESC, product_id")
def score_site(spark, d):
    s = scoring.score_site(_site(spark, d))
    return s.select("product_id", "total_reviews", *[f"points_{k}" for k in _P], "risk", "display", "rank", F.concat_ws(",", "flags").alias("flags"), "verdict").orderBy(F.desc("risk"), "product_id")


_FULL = SCORED.replace(sql_squeeze("body"), sql_squeeze("strip_accents(body)"))


@query(f"{_FULL} SELECT product_id, risk, {_RANK} AS rank, {_V('dist_bias', 'duplicates', _PCT)} AS verdict, max_duplicate_cluster FROM scored")
def score_site_full_normalization(spark, d):
    """With decomposition in the cluster key; the texts have composed letters and no compatibility forms, for which SQL has no function."""
    s = scoring.score_site(features.site_features(reviews_text(spark, d)))
    return s.select("product_id", "risk", "rank", "verdict", "max_duplicate_cluster")


@query(f"{SCORED} SELECT product_id, rule, value, points, extra FROM (SELECT product_id, unnest(['dist_bias', 'duplicates', 'surge', 'noise']) AS rule, unnest([dist_bias, duplicates, surge, noise]) AS value, unnest([points_dist_bias, points_duplicates, points_surge, points_noise]) AS points, unnest([CAST(five_star AS DOUBLE), CAST(max_duplicate_cluster AS DOUBLE), CAST(max_day_reviews AS DOUBLE), CAST(url_hits AS DOUBLE)]) AS extra FROM scored)")
def sc_site_rules(spark, d):
    s = scoring.site_rules(scoring.score_site(_site(spark, d))).select("product_id", F.explode("rules").alias("r"))
    first = F.coalesce(*[F.try_element_at("r.extra", F.lit(k)) for k in ("five_star_count", "max_cluster", "max_day_reviews", "url_hits")])
    return s.select("product_id", F.col("r.id").alias("rule"), "r.value", "r.points", first.alias("extra"))


@query(f"{SITE_SQL} SELECT product_id, total_reviews, floor(dist_bias * 100.0 + 0.5) / 100.0 AS dist_bias, floor(duplicates * 100.0 + 0.5) / 100.0 AS duplicate_ratio, floor(surge * 100.0 + 0.5) / 100.0 AS surge_ratio, floor(noise * 100.0 + 0.5) / 100.0 AS noise_ratio, max_duplicate_cluster, max_day_reviews, day_buckets, floor(avg_per_day * 100.0 + 0.5) / 100.0 AS avg_reviews_per_day FROM feats")
def sc_site_metrics(spark, d):
    return _site(spark, d).select("product_id", scoring.site_metrics().alias("m")).select("product_id", "m.*")


@query(f"{SCORED}, {PRODUCTS}, everything AS (SELECT DISTINCT product_id FROM reviews UNION SELECT product_id FROM products) SELECT product_id, coalesce(risk, 0.0) AS risk, CASE WHEN risk IS NULL THEN 100.0 ELSE greatest(0.0, 100.0 - risk) END AS display, coalesce(CASE WHEN risk IS NOT NULL THEN {_RANK} END, 'A') AS rank, coalesce(CASE WHEN risk IS NOT NULL THEN {_V('dist_bias', 'duplicates', _PCT)} END, 'GENUINE') AS verdict FROM everything LEFT JOIN scored USING (product_id)")
def sc_default_scores(spark, d):
    everything = reviews_text(spark, d).select("product_id").union(products(spark, d).select("product_id")).distinct()
    return scoring.with_default_site_score(everything, scoring.score_site(_site(spark, d)))


AMAZON_SQL = f"""WITH {REVIEWS_TEXT}, rows_ AS (SELECT product_id, stars, review_date, author, {sql_squeeze("coalesce(body, '')")} AS norm FROM reviews),
    clusters AS (SELECT product_id, max(n) AS max_cluster FROM (SELECT product_id, coalesce(nullif(norm, ''), author) AS k, count(*) AS n FROM rows_ GROUP BY ALL) WHERE k IS NOT NULL GROUP BY product_id),
    base AS (SELECT product_id, count(*) AS total_reviews, count(*) FILTER (stars >= 5) AS five_star, count(*) FILTER (length(norm) < 120) AS short, count(*) FILTER (norm = '' OR length(norm) < 40 OR len(list_distinct(string_split(norm, ''))) < 10) AS noisy, count(*) FILTER (review_date >= DATE '{AS_OF}' - 7) AS recent_reviews FROM rows_ GROUP BY product_id),
    feats AS (SELECT product_id, total_reviews, greatest(0.0, least(1.0, CAST(five_star AS DOUBLE) / total_reviews * (CAST(short AS DOUBLE) / total_reviews))) AS dist_bias, greatest(0.0, least(1.0, CAST(coalesce(max_cluster, 1) AS DOUBLE) / total_reviews)) AS duplicate_rate,
        greatest(0.0, least(1.0, recent_reviews * CAST(1.0 AS DOUBLE) / greatest(CAST(1.0 AS DOUBLE), total_reviews / CAST(5.0 AS DOUBLE)))) AS surge_ratio, greatest(0.0, least(1.0, CAST(noisy AS DOUBLE) / total_reviews)) AS noise_ratio, recent_reviews, 7 AS window_days FROM base LEFT JOIN clusters USING (product_id))"""
_C01 = lambda x: f"greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), {x}))"
AMAZON_SCORED = f"""{AMAZON_SQL}, pen AS (SELECT *, {_C01('dist_bias')} * 100.0 * 0.35 AS p1, {_C01('duplicate_rate')} * 100.0 * 0.35 AS p2, {_C01('(surge_ratio - 1.8) / (3.0 - 1.8)')} * 100.0 * 0.2 AS p3, {_C01('noise_ratio')} * 100.0 * 0.1 AS p4 FROM feats),
    scored AS (SELECT *, CAST(floor(least(100.0, p1 + p2 + p3 + p4) + 0.5) AS INTEGER) AS total_penalty FROM pen)"""
_ASSIGN = lambda s: f"CASE WHEN {s} <= 34 THEN 'A' WHEN {s} <= 64 THEN 'B' ELSE 'C' END"


def _amazon(spark, d):
    return features.amazon_features(reviews_text(spark, d).withColumn("reviewer", F.col("author")), AS_OF, normalize=squeeze)


@query(f"{AMAZON_SQL} SELECT * FROM feats")
def agg_amazon_features(spark, d):
    return _amazon(spark, d)


@query(f"{AMAZON_SCORED} SELECT product_id, total_penalty, greatest(0, 100 - total_penalty) AS score, {_ASSIGN('greatest(0, 100 - total_penalty)')} AS rank, concat_ws(',', CASE WHEN dist_bias >= 0.35 THEN 'ATTN_DISTRIBUTION' END, CASE WHEN duplicate_rate >= 0.3 THEN 'ATTN_DUPLICATE' END, CASE WHEN surge_ratio >= 1.8 THEN 'ATTN_SURGE' END, CASE WHEN noise_ratio >= 0.25 THEN 'ATTN_NOISE' END) AS flags, CAST((dist_bias >= 0.35)::INT + (duplicate_rate >= 0.3)::INT + (surge_ratio >= 1.8)::INT + (noise_ratio >= 0.25)::INT AS INTEGER) AS n_rules, {_V('dist_bias', 'duplicate_rate', _RATIO)} AS verdict FROM scored")
def score_amazon(spark, d):
    s = scoring.score_amazon(_amazon(spark, d))
    return s.select("product_id", "total_penalty", "score", "rank", F.concat_ws(",", "flags").alias("flags"), F.size("rules").alias("n_rules"), "verdict")


@query(f"{AMAZON_SQL} SELECT product_id, total_reviews, floor(dist_bias * 100.0 + 0.5) / 100.0 AS dist_bias, floor(duplicate_rate * 100.0 + 0.5) / 100.0 AS duplicate_rate, floor(surge_ratio * 100.0 + 0.5) / 100.0 AS surge_ratio, floor(noise_ratio * 100.0 + 0.5) / 100.0 AS noise_ratio, recent_reviews, window_days FROM feats")
def sc_amazon_metrics(spark, d):
    return _amazon(spark, d).select("product_id", scoring.amazon_metrics().alias("m")).select("product_id", "m.*")


@query(f"{AMAZON_SCORED} SELECT product_id, {_ASSIGN('100 - greatest(0, 100 - total_penalty)')} AS rank FROM scored")
def sc_rank_polarity(spark, d):
    return scoring.score_amazon(_amazon(spark, d), good_is_high=True).select("product_id", "rank")


@query(f"{EVAL_SQL} SELECT * FROM feats")
def agg_eval_features(spark, d):
    return features.eval_features(reviews_text(spark, d))


@query(f"{EVAL_SQL} SELECT product_id, dist_bias, duplicates, {_V('dist_bias', 'duplicates', _PCT)} AS verdict FROM feats")
def score_eval(spark, d):
    return scoring.score_eval(features.eval_features(reviews_text(spark, d))).select("product_id", "dist_bias", "duplicates", "verdict")


EXPORT_SQL = f"""WITH {REVIEWS_TEXT}, rows_ AS (SELECT product_id, stars, coalesce(body, '') AS body FROM reviews),
    clusters AS (SELECT product_id, max(n) AS duplicates FROM (SELECT product_id, lower(regexp_replace(body, '[\\t\\n\\x0B\\f\\r ]+', '', 'g')) AS k, count(*) AS n FROM rows_ GROUP BY ALL) GROUP BY product_id),
    base AS (SELECT product_id, count(*) AS cnt, count(*) FILTER (stars >= 5) AS five, quantile_cont(length(body), 0.5) AS median FROM rows_ GROUP BY product_id),
    feats AS (SELECT product_id, round_even(100.0 * (0.7 * (CAST(five AS DOUBLE) / cnt) + 0.3 * least(CAST(1.0 AS DOUBLE), 40.0 / greatest(CAST(1.0 AS DOUBLE), round_even(CAST(median AS DOUBLE), 0)))), 2) AS dist_bias, CAST(duplicates AS BIGINT) AS duplicates, cnt FROM base JOIN clusters USING (product_id))"""


@query(f"{EXPORT_SQL} SELECT * FROM feats")
def agg_exported_features(spark, d):
    return features.exported_features(reviews_text(spark, d))


@query(f"{EXPORT_SQL} SELECT CAST(least(100.0, round_even(CAST(max(dist_bias) AS DOUBLE) * 0.80, 0)) AS INTEGER) AS dist_bias_sakura, CAST(least(100.0, round_even(CAST(max(duplicates) AS DOUBLE) * 0.50, 0)) AS INTEGER) AS duplicates_sakura FROM feats")
def agg_threshold_derivation(spark, d):
    return evaluation.derive_thresholds(features.exported_features(reviews_text(spark, d)))


LABELLED = f"{EVAL_SQL}, predictions AS (SELECT r.review_id, CASE WHEN r.quality = 0 AND r.toxic = 1 THEN 'SAKURA' WHEN r.quality = 0 THEN 'LIKELY' WHEN r.toxic = 1 THEN 'UNLIKELY' ELSE 'GENUINE' END AS label, {_V('f.dist_bias', 'f.duplicates', _PCT)} AS verdict FROM reviews r JOIN feats f USING (product_id) WHERE r.quality IS NOT NULL)"


def _labelled(spark, d):
    reviews = reviews_text(spark, d)
    scored = scoring.score_eval(features.eval_features(reviews)).select("product_id", "verdict")
    label = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "SAKURA").when(F.col("quality") == 0, "LIKELY").when(F.col("toxic") == 1, "UNLIKELY").otherwise("GENUINE")
    return reviews.where("quality IS NOT NULL").join(scored, "product_id").select("review_id", label.alias("label"), "verdict")


@query(f"{LABELLED} SELECT label, verdict, count(*) AS n FROM predictions GROUP BY ALL")
def confusion_matrix(spark, d):
    return evaluation.confusion(_labelled(spark, d))


@query(f"{LABELLED}, v AS (SELECT unnest(['SAKURA', 'LIKELY', 'UNLIKELY', 'GENUINE']) AS x) SELECT a.x AS label, b.x AS verdict, count(p.review_id) AS n FROM v a CROSS JOIN v b LEFT JOIN predictions p ON p.label = a.x AND p.verdict = b.x GROUP BY ALL")
def confusion_matrix_dense(spark, d):
    return evaluation.dense_confusion(_labelled(spark, d))


@query(f"{LABELLED} SELECT count(*) AS samples, count(*) FILTER (label = verdict) AS hits, CAST(count(*) FILTER (label = verdict) AS DOUBLE) / nullif(count(*), 0) AS accuracy FROM predictions")
def accuracy(spark, d):
    return evaluation.accuracy(_labelled(spark, d))


@query(f"{LABELLED} SELECT label, count(*) AS n, count(*) FILTER (label = verdict) AS hits, CAST(count(*) FILTER (label = verdict) AS DOUBLE) / count(*) AS recall FROM predictions GROUP BY label")
def recall_by_label(spark, d):
    return evaluation.recall(_labelled(spark, d))


HEURISTIC_SQL = f"""WITH {REVIEWS_TEXT}, rows_ AS (SELECT *, nullif(lower(regexp_replace(coalesce(body, ''), '[\\t\\n\\x0B\\f\\r ]+', '', 'g')), '') AS bk, nullif(lower(coalesce(author, '')), '') AS ak FROM reviews),
    c AS (SELECT *, CAST(count(*) OVER (PARTITION BY product_id) AS DOUBLE) AS n, count(*) FILTER (stars = 5) OVER (PARTITION BY product_id) AS five, CASE WHEN bk IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY product_id, bk) END AS dup, CASE WHEN ak IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY product_id, ak) END AS au FROM rows_),
    s AS (SELECT review_id, product_id, stars, CAST(dup AS BIGINT) AS dup_count, CAST(au AS BIGINT) AS author_count, CASE WHEN dup > 1 THEN least(1.0, (dup - 1) / greatest(CAST(1.0 AS DOUBLE), n / 10.0)) ELSE 0.0 END AS s1, CASE WHEN au > 1 THEN least(CAST(1.0 AS DOUBLE), (au - 1) / CAST(5.0 AS DOUBLE)) ELSE 0.0 END AS s2,
        CASE WHEN five / n > 0.4 THEN least(CAST(1.0 AS DOUBLE), (five / n - 0.4) / (1.0 - CAST(0.4 AS DOUBLE))) ELSE 0.0 END AS s3, CASE WHEN length(body) BETWEEN 1 AND 20 THEN 1.0 WHEN length(body) BETWEEN 21 AND 60 THEN 0.4 ELSE 0.0 END AS s4,
        CASE WHEN stars >= 4 AND (contains(lower(body), 'ダメ') OR contains(lower(body), '良くない') OR contains(lower(body), 'bad') OR contains(lower(body), 'not') OR contains(lower(body), '嫌')) THEN 1.0 ELSE 0.0 END AS s5 FROM c),
    h AS (SELECT *, greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), 0.35 * CAST(s1 AS DOUBLE) + 0.25 * CAST(s3 AS DOUBLE) + 0.15 * CAST(s2 AS DOUBLE) + 0.15 * CAST(s4 AS DOUBLE) + 0.10 * CAST(s5 AS DOUBLE))) AS score FROM s)"""


@query(f"{HEURISTIC_SQL} SELECT review_id, product_id, score AS heuristic_score, concat_ws(',', CASE WHEN s1 > 0.05 THEN 'dup' || printf('%.2f', CAST(s1 AS DOUBLE)) END, CASE WHEN s2 > 0.05 THEN 'author' || printf('%.2f', CAST(s2 AS DOUBLE)) END, CASE WHEN s3 > 0.05 THEN 'bias' || printf('%.2f', CAST(s3 AS DOUBLE)) END, CASE WHEN s4 > 0.05 THEN 'short' || printf('%.2f', CAST(s4 AS DOUBLE)) END, CASE WHEN s5 > 0.05 THEN 'mismatch' || printf('%.2f', CAST(s5 AS DOUBLE)) END) AS heuristic_reasons, score >= 0.6 AS sakura_flag FROM h")
def heuristic_reviews(spark, d):
    return heuristics.score_reviews(reviews_text(spark, d, heuristics.with_body_signs)).select("review_id", "product_id", "heuristic_score", "heuristic_reasons", "sakura_flag")


@query(f"{HEURISTIC_SQL} SELECT review_id, dup_count, author_count FROM h")
def win_review_counts(spark, d):
    s = heuristics.with_product_stats(reviews_text(spark, d, heuristics.with_body_signs))
    return s.select("review_id", F.coalesce("dup_count", F.lit(0)).alias("dup_count"), F.coalesce("author_count", F.lit(0)).alias("author_count"))


@query(f"WITH {REVIEWS_NUM} SELECT product_id, rating, count(*) AS n FROM reviews_num GROUP BY ALL")
def hist_by_product(spark, d):
    return histograms.rating_histogram(reviews_num(spark, d))


@query(f"WITH {REVIEWS_NUM} SELECT product_id, string_agg(rating || '=' || n, ',' ORDER BY CAST(rating AS VARCHAR)) AS ratings_histogram FROM (SELECT product_id, rating, count(*) AS n FROM reviews_num GROUP BY ALL) GROUP BY product_id")
def hist_maps(spark, d):
    h = histograms.histogram_map(reviews_num(spark, d))
    return h.select("product_id", F.array_join(F.transform(F.sort_array(F.map_entries("ratings_histogram")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("ratings_histogram"))


@query(f"WITH {REVIEWS_NUM} SELECT product_id, count(*) FILTER (rating >= 4) AS positive, count(*) FILTER (rating <= 2) AS negative FROM reviews_num GROUP BY product_id")
def agg_sentiment(spark, d):
    return histograms.sentiment(reviews_num(spark, d))


@query(f"WITH {REVIEWS_NUM}, a AS (SELECT product_id, CAST(sum(rating) AS DOUBLE) / count(*) AS rating_average FROM reviews_num GROUP BY product_id), s AS (SELECT *, floor(greatest(0.0, least(5.0, rating_average)) / 5.0 * 100.0 * 10.0 + 0.5) / 10.0 AS score FROM a) SELECT product_id, rating_average, score, CASE WHEN score < 35 THEN 'A' WHEN score < 65 THEN 'B' ELSE 'C' END AS rank FROM s")
def agg_average_and_score(spark, d):
    a = reviews_num(spark, d).groupBy("product_id").agg(histograms.average_rating(F.col("rating")).alias("rating_average"))
    block = a.select("product_id", "rating_average", scoring.snapshot_block(F.col("rating_average")).alias("b"))
    return block.select("product_id", "rating_average", to_score(F.col("rating_average")).alias("score"), "b.rank")


_SHARES = "p_size % 60 AS s5, p_size * 3 % 40 AS s4, p_size * 7 % 30 AS s3, p_size * 11 % 20 AS s2, p_size * 13 % 10 AS s1"


def _bars(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", size, *[(size * m % n).cast("int").alias(f"s{k}") for k, m, n in ((5, 1, 60), (4, 3, 40), (3, 7, 30), (2, 11, 20), (1, 13, 10))])


@query(f"WITH b AS (SELECT p_partkey, p_size, {_SHARES} FROM part) SELECT p_partkey, " + ", ".join(f"CAST(floor(CASE WHEN p_size % 4 > 0 THEN CAST(s{k} AS DOUBLE) / 100.0 * (p_size % 4 * 250) ELSE CAST(s{k} AS DOUBLE) END + 0.5) AS BIGINT) AS n{k}" for k in (5, 4, 3, 2, 1)) + " FROM b")
def agg_share_counts(spark, d):
    shares = F.create_map(*[x for k in (5, 4, 3, 2, 1) for x in (F.lit(k), F.col(f"s{k}").cast("double"))])
    m = _bars(spark, d).select("p_partkey", histograms.share_to_counts(shares, F.col("p_size") % 4 * 250).alias("m"))
    return m.select("p_partkey", *[F.element_at("m", F.lit(k)).alias(f"n{k}") for k in (5, 4, 3, 2, 1)])


@query(f"WITH b AS (SELECT p_partkey, [CAST(p_size % 60 AS INTEGER), CAST(p_size * 3 % 40 AS INTEGER), CAST(p_size * 7 % 30 AS INTEGER), CAST(p_size * 11 % 20 AS INTEGER), CAST(p_size * 13 % 10 AS INTEGER)] AS v FROM part), c AS (SELECT p_partkey, v, list_sum(v) AS t, list_position(v, list_max(v)) AS pivot_at FROM b) SELECT p_partkey, " + ", ".join(f"CAST(CASE WHEN t NOT IN (0, 100) AND pivot_at = {i} THEN greatest(0, least(100, v[{i}] + 100 - t)) ELSE v[{i}] END AS INTEGER) AS b{6 - i}" for i in range(1, 6)) + " FROM c")
def agg_balanced_shares(spark, d):
    b = _bars(spark, d).select("p_partkey", histograms.balance_shares(F.array("s5", "s4", "s3", "s2", "s1")).alias("b"))
    return b.select("p_partkey", *[F.get("b", F.lit(i)).alias(f"b{5 - i}") for i in range(5)])


@query(f"WITH {REVIEWS_NUM}, h AS (SELECT product_id, count(*) FILTER (rating = 5 AND tax > 0.05) AS n FROM reviews_num GROUP BY product_id) SELECT product_id, n > 0 AS meaningful FROM h")
def flt_meaningful_histogram(spark, d):
    h = reviews_num(spark, d).groupBy("product_id").agg(F.count_if((F.col("rating") == 5) & (F.col("tax") > 0.05)).alias("n"))
    return h.select("product_id", histograms.is_meaningful(F.create_map(F.lit("5"), "n", F.lit("4"), F.lit(None).cast("bigint"))).alias("meaningful"))


CONTEXT_SQL = """ctx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(5, 1 + floor((l_quantity - 1) / 10)) AS INTEGER) AS star_rating, l_returnflag = 'R' AS anonymous, l_discount * 10 AS verified_rate,
    CAST(l_suppkey % 60 AS INTEGER) AS account_age_days, CAST(l_quantity AS INTEGER) % 23 AS reviews_last_24h, l_tax * 12 AS star_variance, CAST(l_partkey % 100 AS DOUBLE) / 100 AS vendor_concentration, l_discount * 9 AS noise_ratio,
    CAST(l_orderkey % 100 AS DOUBLE) / 100 AS specificity, l_tax * 11 AS unnatural_score, CAST(l_suppkey % 50 AS DOUBLE) / 50 AS text_similarity FROM lineitem)"""
_over = lambda c, l, w: f"CASE WHEN {c} > {l} THEN ({c} - {l}) / (CAST(1.0 AS DOUBLE) - {l}) * {w}.0 END"  # noqa: E731,E741
_under = lambda c, l, w: f"CASE WHEN {c} < {l} THEN ({l} - {c}) / CAST({l} AS DOUBLE) * {w}.0 END"  # noqa: E731,E741
_RULE_SQL = {
    "DUPLICATE_TEXT": _over("text_similarity", 0.8, 15), "UNNATURAL_LANGUAGE": _over("unnatural_score", 0.7, 5), "STAR_DISTRIBUTION": _over("star_variance", 0.4, 5),
    "EXCESSIVE_FIVE_STAR": "CASE WHEN star_rating >= 5 AND reviews_last_24h > 6 THEN CAST(reviews_last_24h - 6 AS DOUBLE) / 4.0 * 5.0 END", "SURGE_ACTIVITY": "CASE WHEN reviews_last_24h > 10 THEN CAST(reviews_last_24h - 10 AS DOUBLE) / 10.0 * 10.0 END",
    "NOISE": _over("noise_ratio", 0.5, 3), "LOW_VERIFIED_RATE": _under("verified_rate", 0.5, 5), "ANONYMOUS_REVIEWER": "CASE WHEN anonymous AND account_age_days < 30 THEN CAST(30 - account_age_days AS DOUBLE) / 30.0 * 5.0 END",
    "NEW_ACCOUNT_BURST": "CASE WHEN account_age_days < 7 AND reviews_last_24h > 3 THEN CAST(reviews_last_24h - 3 AS DOUBLE) / 3.0 * 10.0 END", "SAME_VENDOR_CONCENTRATION": _over("vendor_concentration", 0.8, 5), "LOW_SPECIFICITY": _under("specificity", 0.3, 5),
}
RULES_SQL = f"WITH {CONTEXT_SQL}, pen AS (SELECT *, " + ", ".join(f"{v} AS penalty_{k}" for k, v in _RULE_SQL.items()) + " FROM ctx), tot AS (SELECT *, " + " + ".join(f"coalesce(penalty_{k}, 0.0)" for k in _RULE_SQL) + " AS total_penalty FROM pen), sc AS (SELECT *, CAST(floor(greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), 100.0 - total_penalty)) + 0.5) AS INTEGER) AS score FROM tot)"


def _contexts(spark, d):
    x, q = table(spark, d, "lineitem"), F.col("l_quantity")
    of = lambda c, n: (F.col(c) % n).cast("double") / n
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.least(F.lit(5), 1 + F.floor((q - 1) / 10)).cast("int").alias("star_rating"), (F.col("l_returnflag") == "R").alias("anonymous"), (F.col("l_discount") * 10).alias("verified_rate"),
        (F.col("l_suppkey") % 60).cast("int").alias("account_age_days"), (q.cast("int") % 23).alias("reviews_last_24h"), (F.col("l_tax") * 12).alias("star_variance"), of("l_partkey", 100).alias("vendor_concentration"), (F.col("l_discount") * 9).alias("noise_ratio"),
        of("l_orderkey", 100).alias("specificity"), (F.col("l_tax") * 11).alias("unnatural_score"), of("l_suppkey", 50).alias("text_similarity"),
    )


@query(f"{RULES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"penalty_{k}" for k in _RULE_SQL) + " FROM sc")
def rule_penalties(spark, d):
    return rules.score_rules(_contexts(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"penalty_{k}" for k in _RULE_SQL])


@query(f"{RULES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_penalty, score, {_ASSIGN('score')} AS rank, concat_ws(',', " + ", ".join(f"CASE WHEN penalty_{k} IS NOT NULL THEN '{k}' END" for k in _RULE_SQL) + ") AS triggered FROM sc")
def rule_engine_score(spark, d):
    s = rules.score_rules(_contexts(spark, d))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total_penalty", "score", "rank", F.array_join(F.transform("triggered", lambda t: t["flag"]), ",").alias("triggered"))


@query(f"{RULES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('; ', CASE WHEN penalty_EXCESSIVE_FIVE_STAR IS NOT NULL THEN 'reviews24h=' || reviews_last_24h END, CASE WHEN penalty_SURGE_ACTIVITY IS NOT NULL THEN 'reviews24h=' || reviews_last_24h END, CASE WHEN penalty_ANONYMOUS_REVIEWER IS NOT NULL THEN 'accountAgeDays=' || account_age_days END, CASE WHEN penalty_NEW_ACCOUNT_BURST IS NOT NULL THEN 'reviews24h=' || reviews_last_24h END) AS evidence FROM sc")
def sc_evidence(spark, d):
    counted = [r for r in rules.CATALOG if r.flag in ("EXCESSIVE_FIVE_STAR", "SURGE_ACTIVITY", "ANONYMOUS_REVIEWER", "NEW_ACCOUNT_BURST")]
    s = rules.score_rules(_contexts(spark, d), catalog=counted)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(rules.evidence_lines(F.col("triggered")), "; ").alias("evidence"))


@query(f"{SCORED}, {REVIEWS_NUM}, page AS (SELECT 'src' || (CAST(product_id AS BIGINT) % 30) AS product_id, CAST(sum(rating) AS DOUBLE) / count(*) AS a FROM reviews_num GROUP BY 1), blocks AS (SELECT product_id, floor(a / 5.0 * 100.0 * 10.0 + 0.5) / 10.0 AS ps FROM page) SELECT product_id, coalesce(risk, ps) AS score, CASE WHEN risk IS NULL THEN ps ELSE greatest(0.0, 100.0 - risk) END AS display_score, CASE WHEN risk IS NOT NULL THEN {_RANK} WHEN ps < 35 THEN 'A' WHEN ps < 65 THEN 'B' ELSE 'C' END AS rank, CASE WHEN risk IS NOT NULL THEN {_V('dist_bias', 'duplicates', _PCT)} END AS verdict FROM blocks LEFT JOIN scored USING (product_id)")
def sc_score_response(spark, d):
    key = F.concat(F.lit("src"), F.col("product_id").cast("bigint") % 30)
    page = reviews_num(spark, d).groupBy(key.alias("product_id")).agg(histograms.average_rating(F.col("rating")).alias("a"))
    blocks = page.select("product_id", scoring.snapshot_block(F.col("a")).alias("block"))
    return scoring.score_response(blocks, scoring.score_site(_site(spark, d)), blocks).select("product_id", "score", "display_score", "rank", "verdict")
