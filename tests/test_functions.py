"""Golden values of the functions, the null and odd cases among them."""

import datetime as dt
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from lynxmark.functions import dates, hashing, language, numbers, similarity, urls
from lynxmark.functions import text as T
from lynxmark.plans import functions as plans


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


CASES = [
    (T.normalize, ["Ｃａｆé　 が\t x ", None, ""], ["cafe か x", None, ""]),
    (T.normalize_scraped, ["ａ\r\n b​\t c ", " \n ", None], ["a\nb c", None, None]),
    (T.normalize_digits, [" １２％，．"], ["12%,."]),
    (T.java_trim, ["\t a\x00 ", None, "　"], ["a", None, "　"]),
    (T.unicode_strip, ["　a\xa0"], ["a"]),
    (lambda c: T.safe_truncate(c, 5), [" abcdef ", "abc", None], ["ab...", "abc", None]),
    (lambda c: T.safe_truncate(c, 2), ["abcdef"], ["ab"]),
    (T.has_symbol_run, ["a!!!", "!!", "!?!", "〜〜〜"], [True, False, False, True]),
    (T.has_emoji, ["☆", "😀", "a", ""], [True, True, False, False]),
    (lambda c: T.has_emoji(c, "eval"), ["☆", "©", "➰"], [True, False, True]),
    (T.is_captcha, [None, "CAPTCHA", "x"], [True, True, False]),
    (T.needs_login, [None, "SignIn ap_password", "signin"], [True, True, False]),
    (T.normalize_body, [" A b\n", None], ["ab", ""]),
    (numbers.parse_yen, ["￥１,２３４", "none", None, "9" * 30], [1234, None, None, None]),
    (numbers.parse_rating, ["5つ星のうち4.0", "4,5", "3", ".5", "x"], [4.0, 4.5, 3.0, 0.5, None]),
    (numbers.parse_percent, ["-12.5％", "1-2", None], [-12.5, None, None]),
    (numbers.normalize_stars, ["5つ星のうち4.0", "4.5 out of 5", "9", "", None], [5, 5, 5, 0, 0]),
    (numbers.parse_star_rating, ["5つ星のうち4,0", "", None], [4.0, 0.0, 0.0]),
    (numbers.normalize_helpful, ["One person found", "1,234人", "no", None], [1, 1234, 0, 0]),
    (dates.normalize_date, ["2023年10月1日に", "Reviewed in Japan on October 1, 2023", "1 Oct 2023", "2023-10-01", "2023年13月1日", "x", None], [dt.date(2023, 10, 1)] * 4 + [None] * 3),
    (dates.parse_posted_at, ["2024年1月2日", "2024年2月30日"], [dt.datetime(2024, 1, 1, 15), None]),
    (dates.parse_collected_at, ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05.123456789+09:00", "x"], [dt.datetime(2025, 1, 2, 3, 4, 5), dt.datetime(2025, 1, 1, 18, 4, 5, 123456), None]),
    (urls.absolutize, ["/a", "a", "https://x/", " ", None], [f"{urls.SITE}/a", f"{urls.SITE}/a", "https://x/", None, None]),
    (lambda c: urls.extract_asin(c, "input"), ["b0abcdefgh", "https://x/gp/product/b0abcdefgh?a", "say B0ABCDEFGH now", "no"], ["B0ABCDEFGH"] * 3 + [None]),
    (urls.slug, [" Ad-Hoc! ", "!!", None], ["ad_hoc", "adhoc", "adhoc"]),
    (lambda c: hashing.sha256_hex(c), [None], [""]),
    (lambda c: hashing.sha256_hex(c, "digest"), [None], ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]),
    (hashing.fnv64, [None, "", "a"], [0, -3750763034362895579, -5808556873153909620]),
    (hashing.name_uuid, ["admin"], ["21232f29-7a57-35a7-8389-4a0e4a801fc3"]),
    (hashing.ulid_millis, ["01ARZ3NDEKTSV4RRFFQ69G5FAV", "x", None], [1469922850259, None, None]),
    (language.detect, ["これは日本", "plain words", "Привет", "", None], ["ja", "en", "unknown", "unknown", "unknown"]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_golden(spark, n):
    f, given, expected = CASES[n]
    assert values(spark, f, given) == expected


def test_arithmetic(spark):
    assert values(spark, numbers.rating_to_int, [float("nan"), 0.2, 4.5, 9.0, None], "double")[:4] == [0, 1, 5, 5]
    assert values(spark, numbers.to_score, [4.33, 6.0, -1.0, float("nan"), None], "double") == [86.6, 100.0, 0.0, None, None]
    assert values(spark, lambda c: numbers.half_up(c, 2), [0.125, 2.5], "double") == [0.13, 2.5]


def test_similarity(spark):
    df = spark.createDataFrame([("a b", "b c"), (None, "x"), ("", ""), ("kitten", "sitting")], "a string, b string")
    got = df.select(similarity.jaccard(F.col("a"), F.col("b")), similarity.distance(F.col("a"), F.col("b")), similarity.likeness(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got[:3]] == [(1 / 3, 2, 1 - 2 / 3), (0.0, 1, 0.0), (0.0, 0, 1.0)]
    assert got[3][1] == 3


def test_missing_required_text_is_an_error(spark):
    df = spark.createDataFrame([(" ",)], "x string")
    with pytest.raises(Exception, match="required text missing"):
        df.select(T.validate(F.col("x"), 5, required=True)).collect()
    with pytest.raises(Exception, match="fingerprint requires"):
        df.select(hashing.fingerprint(F.col("x"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("date"))).collect()


def test_ulids_differ(spark):
    ids = [r[0] for r in spark.range(50).select(hashing.new_ulid()).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 26 for i in ids)


def test_digits_of_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {i: unicodedata.normalize("NFKC", "１２％ " + t).strip("".join(map(chr, range(33)))) for i, t in texts.items()}
    assert {r.doc_id: r.digits for r in plans.fn_validate_and_digits(spark, sf).collect()} == whole


def test_normalized_edges_of_texts(spark, tmp_path):
    """Blank texts, line ends and control characters at the edges come out as in the SQL."""
    texts = [None, "", " ", " \t\n", "\n", "a", "a ", "a\n", "a \n ", "a\r\n", "a\r", "a\t", "a\x01", "\n a", "\t\r\na", "\x01a", "\x01", "\x01 a \x1f", "\x1c", "|a", "|", "É \n\n b\n", "a \x85", "\t\u0301", "\u0301 \u0301b", "\u0301\x01"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(f"SELECT doc_id, normalized, scraped FROM ({plans.SQL['fn_normalize']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in plans.fn_normalize(spark, str(tmp_path)).orderBy("doc_id").collect()] == theirs


def test_texts_reach_python_in_small_batches(spark):
    """By row and not in Arrow batches, whose ten thousand rows may be long."""
    from lynxmark.functions import text as T

    for f in (T.normalize, T.normalize_scraped, T.compose):
        df = spark.createDataFrame([(None,), ("Ａ①",)], "t string").select(f("t").alias("x"))
        assert "BatchEvalPython" in df._jdf.queryExecution().executedPlan().toString()
        assert [r.x for r in df.collect()] in ([None, "a1"], [None, "A1"])


def test_packed_numbers(spark):
    texts = ["", "1", "-", "12", "-1-2", "123-4-0", "0", "00", "9" * 41, None]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", numbers.pack(F.col("x")).alias("p")).select("x", "p", numbers.unpack(F.col("p")).alias("back")).collect()
    assert [r.back for r in got] == texts and len({r.p for r in got}) == len(texts) and len(got[8].p) == 21
