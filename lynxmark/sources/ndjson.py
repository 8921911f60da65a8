"""Review and histogram lines out of NDJSON files.

Lines are read as text with their file and place, parsed into variants that a bad line
leaves null, and coerced field by field, strictly or leniently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lynxmark.functions.text import blank_to_null, has_text, java_trim

NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def read_lines(spark: SparkSession, dirs: list[str], asin: str | None = None) -> DataFrame:
    """(path, line_no, line) of all *.ndjson files below ``dirs``, whatever their case; ``asin`` keeps files and folders named after it.

    The path filter reaches the scan. line_no grows along a file; it need not be dense.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[nN][dD][jJ][sS][oO][nN]").text(dirs)
    df = df.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") * 0 + F.monotonically_increasing_id()).alias("line_no"), F.col("value").alias("line"))
    return df.where(path_matches(F.col("path"), asin)) if asin else df


def path_matches(path: Column, asin: str) -> Column:
    """The file's name contains the product number, or a folder above is named so."""
    word, up = asin.strip().upper(), F.upper(path)
    return F.element_at(F.split(up, "/"), -1).contains(word) | F.array_contains(F.split(up, "/"), word)


def list_files(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """(path, name, size, modified) in path order, ignoring case; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[nN][dD][jJ][sS][oO][nN]").load(dirs)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.lower("path"), "path")


def parse(lines: DataFrame) -> DataFrame:
    """Adds ``doc`` (a variant object, null for bad lines), ``is_blank`` and ``is_histogram``."""
    doc = F.try_parse_json("line")
    whole = F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)
    df = lines.withColumns({"is_blank": ~has_text(F.col("line")), "doc": whole})
    return df.withColumn("is_histogram", F.coalesce(F.lower(java_trim(F.try_variant_get("doc", "$.type", "string"))) == "histogram", F.lit(False)))


def _kind(field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("doc", f"$.{field}", "variant"))


def _is_number(field: str) -> Column:
    kind = _kind(field)
    return kind.isin(*NUMBER_TYPES) | kind.startswith("DECIMAL")


def text_field(field: str) -> Column:
    """Trimmed, blank is null; other scalars as their text."""
    return blank_to_null(F.try_variant_get("doc", f"$.{field}", "string"))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def strict_double(field: str) -> Column:
    """A JSON number, nothing else."""
    return F.when(_is_number(field), _finite(F.try_variant_get("doc", f"$.{field}", "double")))


def strict_int(field: str) -> Column:
    """A JSON number without its fraction, or text that is a whole number."""
    number = F.when(_is_number(field), F.try_variant_get("doc", f"$.{field}", "double").try_cast("int"))
    return F.coalesce(number, F.when(text_field(field).rlike(r"^[+-]?\d+$"), text_field(field).try_cast("int")))


def lenient_double(field: str) -> Column:
    """A number, or text that reads as one."""
    text = text_field(field)
    read = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(_is_number(field), F.try_variant_get("doc", f"$.{field}", "double")).otherwise(read)


def lenient_int(field: str) -> Column:
    return F.floor(lenient_double(field) + 0.5).try_cast("int")


def lenient_bool(field: str) -> Column:
    """A boolean, a number other than 0, "1" or "true"; all other text is false, a missing value null."""
    text = F.lower(text_field(field))
    return F.when(_kind(field) == "BOOLEAN", F.try_variant_get("doc", f"$.{field}", "boolean")).when(_is_number(field), F.try_variant_get("doc", f"$.{field}", "double").try_cast("int") != 0).when(text.isNotNull(), text.isin("1", "true"))


def reviews(parsed: DataFrame, strict: bool = True) -> DataFrame:
    """Review lines with typed fields; collectedAt, dateText and the rest as text."""
    number, whole = (strict_double, strict_int) if strict else (lenient_double, lenient_int)
    texts = ("dataset", "url", "reviewId", "dateText", "title", "author", "body", "ratingText", "heuristic_reasons", "collectedAt")
    rows = parsed.where("doc IS NOT NULL AND NOT is_histogram")
    return rows.select("path", "line_no", F.upper(text_field("asin")).alias("asin"), *[text_field(c).alias(c) for c in texts], number("rating").alias("rating"), whole("bodyLength").alias("bodyLength"), number("heuristic_sakura_score").alias("heuristic_sakura_score"), lenient_bool("sakura_flag").alias("sakura_flag"))


def histograms(parsed: DataFrame) -> DataFrame:
    bars = F.map_from_arrays(F.array(*[F.lit(str(s)) for s in range(5, 0, -1)]), F.array(*[lenient_int(f"ratings_histogram.{s}") for s in range(5, 0, -1)]))
    rows = parsed.where("doc IS NOT NULL AND is_histogram")
    return rows.select("path", "line_no", text_field("dataset").alias("dataset"), F.upper(text_field("asin")).alias("asin"), text_field("captured_at").alias("captured_at"), text_field("productName").alias("productName"), lenient_double("rating_average").alias("rating_average"), lenient_int("rating_count").alias("rating_count"), bars.alias("ratings_histogram"))


def accepted(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews that name a known product and have asin, reviewId, rating and url; the rating as 0 to 5."""
    known = rows.dropna(subset=["asin", "reviewId", "rating", "url"]).join(products.select(F.upper("asin").alias("asin"), "product_id"), "asin")
    return known.withColumn("rating", F.greatest(F.lit(0), F.least(F.lit(5), F.floor(F.col("rating") + 0.5))).cast("int"))


def counters(parsed: DataFrame, taken: DataFrame) -> DataFrame:
    """Per file: total lines that are not blank, histogram, attempted, succeeded and skipped ones (bad lines are skipped too)."""
    by_file = parsed.where("NOT is_blank").groupBy("path").agg(F.count("*").alias("total"), F.count_if("is_histogram").alias("histogram"), F.count_if(F.col("doc").isNotNull() & ~F.col("is_histogram")).alias("attempted"))
    done = taken.groupBy("path").agg(F.count("*").alias("succeeded"))
    out = by_file.join(done, "path", "left").withColumn("succeeded", F.coalesce("succeeded", F.lit(0)))
    return out.withColumn("skipped", F.col("total") - F.col("histogram") - F.col("succeeded"))


def intake_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "histogram", "attempted", "succeeded", "skipped")])


def adhoc_only(rows: DataFrame) -> DataFrame:
    return rows.where((F.lower(java_trim(F.col("dataset"))) == "adhoc") & F.col("asin").isNotNull())


def buckets(review_rows: DataFrame, histogram_rows: DataFrame) -> DataFrame:
    """Per asin: the last histogram, the first dataset that is not blank, how many reviews, and the files in reading order."""
    at = F.struct("path", "line_no")
    r = review_rows.select("asin", at.alias("at"), "dataset", "path")
    h = histogram_rows.select("asin", at.alias("at"), "dataset", "path")
    both = r.withColumn("n", F.lit(1)).unionByName(h.withColumn("n", F.lit(0)))
    seen = both.groupBy("asin").agg(F.sum("n").alias("n_reviews"), F.min_by("dataset", F.when(has_text(F.col("dataset")), F.col("at"))).alias("dataset"), F.sort_array(F.collect_set("path")).alias("sources"))
    last = histogram_rows.groupBy("asin").agg(F.max_by(F.struct("captured_at", "rating_average", "rating_count", "ratings_histogram"), at).alias("histogram"))
    return seen.where("asin IS NOT NULL").join(last, "asin", "left")


def labelled(spark: SparkSession, root: str, labels: dict[str, str]) -> DataFrame:
    """(sample, folder, label, line_no, line): one sample a file, labelled by the folder below ``root`` that it lies in."""
    folders = "|".join(labels)
    df = read_lines(spark, [root]).withColumn("folder", F.regexp_extract("path", rf"/({folders})/", 1)).where("folder != ''")
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.select(F.col("path").alias("sample"), "folder", F.element_at(names, F.col("folder")).alias("label"), "line_no", "line")


def latest_files(files: DataFrame) -> DataFrame:
    """Of each folder the file that was modified last, of equals that with the larger path."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    order = Window.partitionBy("folder").orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("folder", folder).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def decode_snapshots(rows: DataFrame, schema: str) -> DataFrame:
    """Adds ``snapshot``: the stored JSON; where that cannot be read, a stub with asin and title that is marked partial."""
    as_json = schema.replace("map<int,", "map<string,")  # JSON knows no other keys
    sound = F.try_parse_json("snapshot_json").isNotNull() & F.col("snapshot_json").rlike(r"^[ \t\n\r]*\{")
    stub = F.to_json(F.struct("asin", "title", F.lit(True).alias("partial")))
    found = F.from_json(F.when(sound, F.col("snapshot_json")).otherwise(stub), as_json, {"mode": "PERMISSIVE"})
    once = rows.select("*", F.explode(F.array(found)).alias("snapshot"))  # a column would be read again for each field that is asked for
    return once.withColumn("snapshot", F.col("snapshot").withField("ratingSharePct", F.transform_keys("snapshot.ratingSharePct", lambda k, _: k.try_cast("int"))))
