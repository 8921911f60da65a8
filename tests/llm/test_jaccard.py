"""The similarity join beside all pairs, with odd rows, edited copies and every way to deal groups."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynxmark.llm import jaccard, queries
from tests.oracle import difference

SCHEMA = "doc_id long, text string"
ODD = [(None, "a b c d e f g h i"), (1, "a b c d e f g h i"), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "one"), (7, "ONE two"), (8, "w " * 20_000), (9, "w " * 9), (2**60 + 1, "x\u0085y É é"), (2**60 + 3, "X\u0085Y É é")]


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=80, width=5):
    sets, root = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family_rows(seed, families, members, words=(5, 120)):
    """Texts of all sizes, with copies edited as far as they may just link or just not; a passage that half of them hold."""
    rng, rows = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(30))
    for f in range(families):
        base = [f"{rng.choice('abc')}{rng.randrange(400)}" for _ in range(rng.randint(*words))]
        for m in range(members):
            text, n = list(base), len(base)
            for _ in range(rng.randrange(0, 2 + n // 40)):
                text[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            text = text[rng.randrange(0, 2 + n // 12) :] + ([f"t{rng.randrange(99)}"] * rng.randrange(0, 2 + n // 10) if m % 2 else [])
            rows.append((1000 * f + m, " ".join(text) + (" " + passage if f % 2 else "")))
    return rows + rows[:9]


def components(spark, rows, percent=80):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "h", "bytes", "node", "size", "sketch", "common", "n", "root", "key", "task"):
        df = df.withColumn(c, F.lit("clash"))
    found = jaccard.Join(df.repartition(3), percent=percent).components().collect()
    return sorted((str(r.id), r["size"], str(r.component_id)) for r in found)


def test_beside_all_pairs(spark):
    rows = ODD + family_rows(1, 40, 6)
    assert components(spark, rows) == brute(rows)


def test_crowded_groups_and_common_blocks(spark, monkeypatch):
    for name, value in {"CROWD": 6, "REPEATS": 2, "SALTS": 3, "SEEN": 2, "ROWS": 7}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = family_rows(2, 12, 14, (30, 60))
    assert components(spark, rows) == brute(rows)
    assert components(spark, rows, 70) == brute(rows, 70)


def test_no_rows(spark):
    assert components(spark, []) == [] and components(spark, ODD[2:5]) == brute(ODD[2:5])


@pytest.mark.parametrize("percent", [67, 80, 90])
def test_sets_that_link_share_a_first_block(percent):
    """Also where many shingles are common, at the bounds of the bands and for sets so small that empty blocks are dealt out."""
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        a, extra = int(rng.integers(1, 90)), rng.integers(0, 2**63, 60).astype(np.uint64)
        x = np.unique(rng.integers(0, 2**63, a).astype(np.uint64))
        gone = int(rng.integers(0, 1 + a // 5))
        y = np.unique(np.concatenate([x[gone:], extra[: int(rng.integers(0, 1 + a // 4))]]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        link = 100 * both >= percent * (len(x) + len(y) - both)
        if not link or (len(x) == len(y) and (x == y).all()):
            continue
        common = np.sort(np.concatenate([jaccard.blocks(x, low, percent)[1][::2] for low in jaccard.bands(len(x), percent)]))
        for late in (np.empty(0, np.uint64), common):
            assert len(np.intersect1d(jaccard.first_blocks(x, percent, late), jaccard.first_blocks(y, percent, late)))
        sketches = jaccard.Sketches([jaccard.narrow(x), jaccard.narrow(y)])
        far = sketches.differ(np.array([0]), np.array([1]))[0]
        assert far <= len(x) + len(y) - 2 * both and jaccard.linked(x, y, percent)
        sizes = np.array([len(x), len(y)])
        assert jaccard.near(sizes, 0, np.array([1]), sketches, percent).tolist() == [1]


def test_same_as_sql(spark, sf):
    assert difference(spark, sf, queries.op13_jaccard_join, queries.ORACLE_SQL["op13_jaccard_join"]) == ""


def test_sketches_of_all_widths():
    """Sketches are compared at the lesser width: as if both had been made at that."""
    rng = np.random.default_rng(1)
    for size in (5, 1000, 1024, 1025, 2100, 9000):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(size * 0.95)], rng.integers(0, 2**63, size // 6).astype(np.uint64)]))
        bits = 64 * min(jaccard.width_of(len(x)), jaccard.width_of(len(y)))
        odd = lambda h: np.bincount((jaccard.mixed(h, jaccard.BIT) % np.uint64(bits)).astype(int), minlength=bits) % 2  # noqa: B023, E731
        far = jaccard.Sketches([jaccard.narrow(x), jaccard.narrow(y)]).differ(np.array([0]), np.array([1]))[0]
        assert far == (odd(x) != odd(y)).sum() <= len(np.setxor1d(x, y))


def test_shingle_sets(monkeypatch):
    """Equal shingles have equal hashes wherever they stand, also where a text is hashed in parts."""
    text = " ".join(random.Random(2).choice(["a", "bb", "Ccc", "é", "😀", "dddd"]) for _ in range(3000)) + " one two three four five"
    whole = jaccard.shingle_set(text.encode(), 5)
    assert len(whole) == len(shingles(text)) and len(jaccard.shingle_set(b"one  TWO\x0bthree four five", 5)) == 1
    assert jaccard.shingle_set(b"one two three four five", 5)[0] in whole and len(jaccard.shingle_set(b"a b", 5)) == 1 and len(jaccard.shingle_set(None, 5)) == len(jaccard.shingle_set(b" \n", 5)) == 0
    monkeypatch.setattr(jaccard, "PART", 100)
    assert (jaccard.shingle_set(text.encode(), 5) == whole).all()
