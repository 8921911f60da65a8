"""How like each review is to another of its group: an exact similarity join of word sets.

Equal sets are one row from the start. A set's words have an order in which rare ones come
first; two sets of the wanted likeness share a word among the first few of each, so only
these few leave a task, and sets meet by group and word: never a whole group in one task, and
no pair without a common rare word. Sizes, the places of a common word and the number of
those among the first words rule out nearly all pairs before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.functions.similarity import token_set

#: Words are counted in so many cells, which the driver and the tasks hold; counts above MOST are MOST.
CELLS, MOST = 1 << 20, (1 << 22) - 1
#: Up to so many sets that are compared as a whole are looked for by a broadcast of their keys.
FEW = 1 << 20


def _needed(size: Column, percent: int) -> Column:
    """Common words that a set shares at least with any that is as like as wanted."""
    return F.ceil(size * percent / 100.0).cast("int")


def word_sets(reviews: DataFrame, group: str, text: str) -> DataFrame:
    """``reviews`` with ``words``, the hashes of their different words, ascending, and ``set_key``, that of group and words, null
    where there is no word."""
    words = F.array_sort(F.transform(token_set(F.col(text)), lambda w: F.xxhash64(w)))
    told = reviews.withColumn("words", words)
    return told.withColumn("set_key", F.when((F.size("words") > 0) & F.col(group).isNotNull(), F.xxhash64(group, "words")))


def _word_counts(sets: DataFrame) -> np.ndarray:
    """How often the words of each cell occur."""
    cells = sets.select(F.explode("words").alias("word")).groupBy(F.pmod("word", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    told, out = cells.toPandas(), np.zeros(CELLS, np.int32)
    out[told["cell"].to_numpy(np.int64)] = np.minimum(told["n"].to_numpy(np.int64), MOST)
    return out


def first_words(sets: DataFrame, group: str, percent: int) -> DataFrame:
    """(g, set_key, size, last, copies, first) of each different set: its ``first`` words, those of which two alike sets have one in
    common, and the place of the ``last`` of them in the order of all words. Groups are told by 64-bit hashes too."""
    counts = sets.sparkSession.sparkContext.broadcast(_word_counts(sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, first = [], []
            for words, some in zip(pdf["words"], pdf["some"], strict=True):
                n, unsigned = counts.value[words % CELLS], words.view(np.uint64)
                order = np.lexsort((unsigned, n))[:some]
                last.append((int(n[order[-1]]) << 40) | int(unsigned[order[-1]] >> np.uint64(24)))
                first.append(words[order])
            yield pd.DataFrame({"g": pdf["g"], "set_key": pdf["set_key"], "size": pdf["size"], "last": last, "first": first})

    size = F.size("words")
    rows = sets.where("set_key IS NOT NULL").select(F.xxhash64(group).alias("g"), "set_key", size.alias("size"), "words", _first_count(size, percent).alias("some"))
    found = rows.mapInPandas(run, "g long, set_key long, size int, last long, first array<long>")
    different = found.groupBy("g", "set_key").agg(F.first(F.struct("size", "last", "first")).alias("x"), F.count("*").alias("copies"))
    return different.select("g", "set_key", "x.size", "x.last", "copies", "x.first").localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)


def _first_count(size: Column, percent: int) -> Column:
    return size - _needed(size, percent) + 1


def _likely_pairs(firsts: DataFrame, percent: int) -> DataFrame:
    """(g, a, b), a < b: pairs of which the first words do not rule out the wanted likeness."""
    rows = firsts.select("g", "set_key", "size", "last", F.posexplode("first").alias("place", "word"))
    a, b = (rows.select("g", "word", F.col("set_key").alias(k), F.col("size").alias(f"size_{k}"), F.col("last").alias(f"last_{k}"), (F.col("place") + 1).alias(f"place_{k}")) for k in "ab")
    least = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100.0 + percent) - 1e-6)  # words that such a pair has in common
    after = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (F.col("a") < F.col("b")) & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (F.least("place_a", "place_b") + after >= least)
    # All words behind the first ones of the set whose first ones end earlier may be common, but no others.
    rest_a, rest_b = (F.col(f"size_{k}") - _first_count(F.col(f"size_{k}"), percent) for k in "ab")
    rest = F.when(F.col("last_a") < F.col("last_b"), rest_a).when(F.col("last_a") > F.col("last_b"), rest_b).otherwise(F.greatest(rest_a, rest_b))
    met = a.join(b, ["g", "word"]).where(fits).select("g", "a", "b", (least - rest).cast("int").alias("wanted"))
    return met.groupBy("g", "a", "b").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).where("n >= wanted").select("g", "a", "b")


def _compared(sets: DataFrame, likely: DataFrame, asked: DataFrame, group: str, percent: int) -> DataFrame:
    """Those of the ``likely`` pairs that are as like as wanted; ``asked``: the keys of their sets."""
    whole = sets.join(asked, "set_key", "left_semi").groupBy("set_key").agg(F.first(group).alias(group), F.first("words").alias("words"))
    of = lambda k: whole.select(F.col("set_key").alias(k), F.col(group).alias(f"group_{k}"), F.col("words").alias(f"words_{k}"))
    both = likely.join(of("a"), "a").join(of("b"), "b").where("group_a = group_b").withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
    union = F.size("words_a") + F.size("words_b") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select(F.col("group_a").alias(group), "a", "b", "common", (F.col("common") / union).alias("likeness"))


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set_key"), *more)


def similar_pairs(sets: DataFrame, group: str, percent: int) -> DataFrame:
    """(group, a, b, common, likeness) of different sets (group, set_key, words), a < b, whose likeness in percent is at least that."""
    likely = _likely_pairs(first_words(sets, group, percent), percent)
    return _compared(sets, likely, _ends(likely).distinct(), group, percent)


def with_text_similarity(reviews: DataFrame, group: str = "product_id", text: str = "body", percent: int = 80, name: str = "text_similarity") -> DataFrame:
    """Adds the highest Jaccard likeness of a review's words to those of another review of its ``group``, if that is ``percent``
    or more, else 0: so ``percent`` must not be above what a rule asks for.

    Words are split at white space, capitals count. Reviews without words or group are like none; equal reviews are copies of
    each other and so alike. Words and sets are told apart by 64-bit hashes. The texts are read several
    times but not shuffled: give them as they lie in a table, not as a join's outcome.
    """
    keyed = word_sets(reviews, group, text)
    firsts = first_words(keyed, group, percent)
    likely = _likely_pairs(firsts, percent).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    asked = _ends(likely).distinct()
    pairs = _compared(keyed, likely, F.broadcast(asked) if asked.count() <= FEW else asked, group, percent)
    best = _ends(pairs, "likeness")
    copies = firsts.where("copies > 1").select("set_key", F.lit(1.0).alias("likeness"))
    found = best.union(copies).groupBy("set_key").agg(F.max("likeness").alias("found"))
    return keyed.join(found, "set_key", "left").withColumn(name, F.coalesce("found", F.lit(0.0))).select(*reviews.columns, name)
