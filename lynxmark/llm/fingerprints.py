"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest different 40-bit shingle hashes. Two
sketches merge into the sketch of both texts' union, so parts of a text or of a corpus can
be sketched apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxmark.llm.common import SPACE, let

K, WIDTH, BITS = 128, 5, 40


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """array<bigint>. Words are lower-cased and split at ASCII white space; a text of fewer than ``width`` words is
    one shingle; a null text or one without words has the empty sketch."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        at = [lambda i, j=j: F.get(h, i + j) for j in range(width)]
        return F.when(n < width, whole).otherwise(F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[x(i) for x in at])))

    cut = let(hashes, lambda h: F.transform(shingles(h), lambda x: F.shiftrightunsigned(x, 64 - BITS)))
    return F.slice(F.sort_array(F.array_distinct(cut)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1; two empty ones are alike (1), an empty one and another are not (0)."""
    common = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common.cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below ``k``."""
    n = F.size(a)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained."""
    j = resemblance(a, b, k)
    both = distinct_shingles(a, k) + distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def to_text(a: Column) -> Column:
    """The sketch as hex digits, ten a hash; empty for the empty sketch."""
    return F.array_join(F.transform(a, lambda x: F.substring(F.hex(x + F.lit(1 << BITS)), 2, BITS // 4)), "")


#: Buckets that with_next() deals rows to at most, and shares that are asked of one aggregation.
MOST, SHARES = 1 << 18, 1 << 9


def _ends(ids: DataFrame, n: int, parts: int) -> list[int]:
    """Upper ends, with repeats and in order, of ``parts`` ranges of some n / parts ids each (column ``id``, without nulls)."""
    inner = [i / SHARES for i in range(1, SHARES + 1)]
    if parts <= SHARES:
        shares = [i / parts for i in range(1, parts + 1)]
        return ids.agg(F.percentile_approx("id", shares, 20 * parts).alias("p")).first()["p"]
    coarse = sorted(set(_ends(ids, n, -(-parts // SHARES))))
    ranges = ids.groupBy(_below(coarse, F.col("id")).alias("range")).agg(F.percentile_approx("id", inner, 20 * SHARES).alias("p")).collect()
    return sorted(x for r in ranges for x in r["p"])


def _below(ends: list[int], value: Column) -> Column:
    """How many of the ascending ends lie below a value, found by halving."""
    bounds = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    steps = [1 << b for b in reversed(range(max(1, len(ends)).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(ends)) & (F.get(bounds, at + s - 1) < value), at + s).otherwise(at))


def with_next(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int = 1000) -> tuple[DataFrame, Window]:
    """Each row's id and text (null: empty), to be read beside the following row's by ``F.lead`` over the returned window.

    Rows go by descending id (null ids last, equal ids by the text's hash, then by the text);
    after the last comes the first. They are dealt once, into buckets of rows that follow each
    other: some ``bucket_rows`` in each, or a MOST-th of all rows if that is more. An id that
    many rows have (or none: null) has buckets of its own, by ranges of the texts' hashes; only
    rows with the same id and the same text cannot be parted. Each bucket's first row is dealt
    to the bucket before it too, flagged ``extra``, where it follows the last row; drop the
    extra rows after using the window. The driver and the join for the extra rows hold one entry
    a bucket.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = rows.agg(F.count("*").alias("n"), F.count("id").alias("ids")).first()
    found = _ends(rows.select("id").where("id IS NOT NULL"), n["ids"], min(MOST, -(-n["ids"] // bucket_rows))) if n["ids"] else []
    times: dict[int, int] = {}
    for end in found:
        times[end] = times.get(end, 0) + 1
    for end in [x for x, k in times.items() if k > 1]:
        times.setdefault(max(end - 1, -(1 << 63)), 1)  # the id is alone in its range
    ends = sorted(times)
    place = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(_below(ends, F.col("id")) if ends else F.lit(0))
    shares = F.split(F.lit(",".join(str(times[x]) for x in ends)), ",").cast("array<int>") if ends else F.array().cast("array<int>")
    nulls = min(MOST, -(-(n["n"] - n["ids"]) // bucket_rows))
    mixed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    part = lambda k: F.least((F.col("mixed") / float(1 << 63) * k).cast("int"), k - 1)
    several = F.when(F.col("place") < 0, F.lit(max(1, nulls))).otherwise(F.coalesce(F.get(shares, F.col("place")), F.lit(1)))
    placed = rows.withColumn("mixed", mixed).withColumn("place", place).withColumn("part", part(several))
    # The first row of each bucket, and the bucket before: the one with the ids above, for the first the last.
    firsts = placed.groupBy("place", "part").agg(F.min(F.struct(F.bitwise_not("id").alias("down"), "mixed")).alias("first"))
    order = Window.orderBy(F.desc("place"), "part")  # one row a bucket
    ends_at = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    follows = firsts.select(F.col("place").alias("_place"), F.col("part").alias("_part"), F.bitwise_not("first.down").alias("_id"), F.col("first.mixed").alias("_mixed"), ends_at("place").alias("to_place"), ends_at("part").alias("to_part"))
    same = (F.col("place") == F.col("_place")) & (F.col("part") == F.col("_part")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("mixed") == F.col("_mixed"))
    both = placed.join(F.broadcast(follows), same, "left")  # at most MOST rows, a second bucket for heavy ids and one for nulls
    own = F.struct(F.col("place").alias("place"), F.col("part").alias("part"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("to_place").alias("place"), F.col("to_part").alias("part"), F.lit(True).alias("extra"))
    dealt = both.select("id", "text", "mixed", F.explode(F.when(F.col("to_place").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("c")).select("id", "text", "mixed", "c.*")
    return dealt, Window.partitionBy("place", "part").orderBy("extra", F.col("id").desc_nulls_last(), "mixed", "text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the following one's beginning."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Per row: id, n_chars, edited (text), sketch, edited_sketch, next_sketch.

    Null texts are empty. A null id comes after all others; repeated ids and rows follow
    each other by their texts' hashes; a single row follows itself; other columns are
    ignored; no rows give none.
    """
    rows, order = with_next(docs, id_col, text_col)
    told = rows.withColumn("following", F.lead("text").over(order)).withColumn("sketch", sketch(F.col("text"), k, width))
    told = told.withColumn("next_sketch", F.lead("sketch").over(order)).where("NOT extra")
    told = told.select("id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("following")).alias("edited"), "sketch", "next_sketch")
    return told.withColumn("edited_sketch", sketch(F.col("edited"), k, width))
