"""Likeness of texts and recent activity beside all pairs and all rows, with hot groups and odd rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lynxmark.functions import hashing
from lynxmark.operators import activity, likeness


def best_of_all_pairs(rows, percent):
    bags = [set((t or "").split()) for _, _, t in rows]
    out = []
    for i, (key, group, _) in enumerate(rows):
        best = 0.0
        for j, (_, other, _) in enumerate(rows):
            if i != j and group is not None and group == other and bags[i] and bags[j]:
                common = len(bags[i] & bags[j])
                union = len(bags[i] | bags[j])
                if 100 * common >= percent * union:
                    best = max(best, common / union)
        out.append((key, best))
    return sorted(out)


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_text_similarity_beside_all_pairs(spark, percent):
    rng = random.Random(percent)
    rows = [(0, "p", None), (1, "p", " "), (2, None, "a b c"), (3, None, "a b c"), (4, "q", "a b c"), (5, "q", "c  b\ta a"), (6, "q", "A b c")]
    for g in range(6):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 9, 20, 40]))]
        for _ in range(25 if g else 120):  # one group holds nearly half of all
            words = [w if rng.random() > 0.08 else f"x{rng.randrange(500)}" for w in base]
            rows.append((len(rows), f"g{g}", " ".join(words + ["the", "and"])))
    df = spark.createDataFrame(rows, "id long, grp string, body string").withColumn("words", F.lit("clash")).withColumnRenamed("words", "kept")
    got = likeness.with_text_similarity(df, "grp", "body", percent)
    assert got.columns == ["id", "grp", "body", "kept", "text_similarity"]
    assert sorted((r.id, r.text_similarity) for r in got.collect()) == best_of_all_pairs(rows, percent)


def test_a_hot_product_is_dealt_by_its_words(spark):
    """Sets meet by product and word: the join that compares them is dealt by both."""
    rows = [(i, "p", f"a{i} b{i} c{i} d{i} e{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, grp string, body string")
    plan = likeness.similar_pairs(likeness.word_sets(df, "grp", "body"), "grp", 80)._jdf.queryExecution().executedPlan().toString()
    dealt = [x.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1] for x in plan.split("\n") if "hashpartitioning(" in x]
    assert ["g", "word"] in [[c.split("#")[0] for c in x] for x in dealt] and all(len(x) > 1 or not x[0].startswith("g#") for x in dealt)
    assert "CartesianProduct" not in plan


def test_only_first_words_leave_a_task(spark):
    """Of 100 words 21; and sets with a few rare words in common, but too few, are not compared as a whole."""
    rows = [(i, "p", " ".join([f"r{i // 2}x{j}" for j in range(5)] + [f"own{i}x{j}" for j in range(45)] + [f"all{j}" for j in range(50)])) for i in range(40)]
    sets = likeness.word_sets(spark.createDataFrame(rows, "id long, grp string, body string"), "grp", "body")
    firsts = likeness.first_words(sets, "grp", 80)
    assert {(r["size"], len(r["first"]), r["copies"]) for r in firsts.collect()} == {(100, 21, 1)}
    assert likeness._likely_pairs(firsts, 80).count() == 0


@pytest.mark.parametrize("slot", [1, 600, 10**6])
def test_recent_counts_beside_all_rows(spark, slot):
    rng = random.Random(slot)
    start = datetime.datetime(2024, 1, 1)
    rows = [(0, None, start), (1, "a", None)]
    for i in range(400):  # one author has a third of all
        who = "hot" if i % 3 == 0 else f"u{rng.randrange(5)}"
        rows.append((len(rows), who, start + datetime.timedelta(seconds=rng.randrange(4 * 86_400) if i % 7 else 86_400 * rng.randrange(4), microseconds=rng.choice([0, 0, 1, 999_999]))))
    rows += [(len(rows), "hot", rows[2][2])]
    df = spark.createDataFrame(rows, "id long, author string, created_at timestamp_ntz")
    got = {r.id: r.reviews_last_24h for r in activity.with_recent_count(df, slot=slot).collect()}
    day = datetime.timedelta(days=1)
    expected = {i: sum(w == who and t is not None and at - day <= t <= at for _, w, t in rows) if who and at else 0 for i, who, at in rows}
    assert got == expected
    ages = {r.id: r.account_age_days for r in activity.with_account_age(df).collect()}
    first = {w: min(t.date() for _, x, t in rows if x == w and t) for _, w, _ in rows if w and w != "a"}
    assert ages == {i: (at.date() - first[who]).days if who in first and at else None for i, who, at in rows}


def test_recent_counts_are_dealt_by_slots(spark):
    """No step deals reviews by their author alone; only sums of slots are."""
    df = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1))], "author string, created_at timestamp_ntz")
    plan = activity.with_recent_count(df)._jdf.queryExecution().executedPlan().toString()
    alone = [x for x in plan.split("\n") if "hashpartitioning(_who#" in x and "," not in x.split("hashpartitioning(")[1].split(", 4)")[0]]
    assert len(alone) <= 1


def test_image_heads(spark):
    heads = ["FFD8FFE000000000", "FFD8000000000000", "89504E4700000000", "4749460000000000", "424D000000000000", "5249464600000000", "424D00000000", "", None]
    df = spark.createDataFrame([(h,) for h in heads], "h string").select(F.unhex("h").alias("data"))
    told = df.select(hashing.image_kind(F.col("data")).alias("kind"), hashing.valid_image(F.col("data"), 8).alias("ok"), hashing.valid_image(F.col("data"), 7).alias("long")).collect()
    assert [r.kind for r in told] == ["jpeg", "jpeg", "png", "gif", "bmp", None, None, None, None]
    assert [r.ok for r in told] == [True] * 5 + [False] * 4 and not any(r.long for r in told)
