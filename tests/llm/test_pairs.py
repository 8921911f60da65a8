"""Mixing, top-k, SimHash, fingerprints and repeated passages beside brute force, with odd rows among them."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lynxmark.llm import fingerprints as sketches
from lynxmark.llm import mixing, queries, simhash, suffixes, topk
from lynxmark.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c d e f", "s1"), (1, "a b c d e f", "s1"), (None, "a b c d e f", None), (2, None, "s2"), (3, "", "s2"), (4, " \t\n", ""), (5, "Ａ é\x85x 😀", "s1"), (6, "one", None), (7, "w " * 30_000, "s1")]
SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows=ODD):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "uid", "fp", "size", "source_size", "bucket", "text_hash", "first", "root", "turn", "spans", "h", "key", "seq", "src", "n_words", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_components(spark):
    random.seed(5)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(1, None), (7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_contract(spark):
    rows = queries.op1_mix_sources(spark, "/root/testdata/sf0.001").collect()
    given = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    size = {k: len(WORD.findall(r.text or "")) for k, r in given.items()}
    names = sorted({r.source for r in given.values()})
    whole = {n: sum(size[k] for k, r in given.items() if r.source == n) for n in names}
    left, live, target = 1.5 * sum(whole.values()), dict(zip(names, [3, 1, 2] * 99, strict=False)), {}
    while live:
        over = [n for n in live if left * live[n] / sum(live.values()) > 2 * whole[n]]
        if not over:
            target |= {n: left * w / sum(live.values()) for n, w in live.items()}
            break
        for n in over:
            target[n] = 2.0 * whole[n]
        left -= sum(target[n] for n in over)
        live = {n: w for n, w in live.items() if n not in over}
    assert len(rows) == len(given)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        n = given[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], whole[n]) and r.target == pytest.approx(target[n]) and r.taken <= 2 * r.size
        taken[n] += r.taken
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    again = queries.op1_mix_sources(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_of_odd_rows(spark):
    m = mixing.Mix(docs(spark), block=4, shard_slots=16)
    rows = m.documents().collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(t or "")) for _, t, _ in ODD)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by_source.values()) and set(by_source) == {"s1", "s2", "", None}
    assert [r.source for r in m.sources.orderBy("src").collect()] == ["", "s1", "s2", None]
    texts = m.texts().collect()
    assert sum(len(r.words) for r in texts) == sum(r.taken for r in rows)
    mixed = m.mixed_documents().collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) >= sum(r.taken for r in rows) // 2 and all(r.turn == "clash" for r in mixed)
    assert mixing.Mix(docs(spark, [])).documents().count() == 0 and mixing.Mix(docs(spark, [(1, None, "s")])).texts().count() == 0


def test_permutations_and_shards():
    for n in (1, 2, 3, 100, 1000):
        x = np.arange(n)
        assert sorted(mixing.permute(x, n, 9)) == list(range(n)) and (mixing.permute(mixing.permute(x, n, 9), n, 9, inverse=True) == x).all()
    plan = mixing.make_plan([1000, 10, 0, 333], [3, 1, 2, 3], 1.5 * 1343, 16, 8, 3)
    drawn = [plan.draw(i) for i in range(plan.shards)]
    assert [sum((d["src"] == s).sum() for d in drawn) for s in range(4)] == plan.slots
    for s, size in enumerate(plan.sizes):
        words = sum(min(16, size - b * 16) - c for d in drawn for src, b, c in zip(d["src"], d["blk"], d["cut"], strict=True) if src == s)
        assert words == int(plan.targets[s] + 0.5)
    assert mixing.share([10, 0, 5], [3, 1, 2], 100) == [20.0, 0.0, 10.0]
    assert 0 <= mixing._hyper(np.random.default_rng(1), 10**10, 10**10, 10**9) <= 10**9


def test_topk_with_many_blocks_and_shells_that_leave_out(spark, monkeypatch):
    """Cells of several blocks, several groups and slices; tight clusters far apart, so that most blocks are out of reach."""
    for name, value in (("BLOCK", 32), ("SLICE", 2), ("LEAST_GROUP", 16), ("MOST_GROUP", 16), ("STEP", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    centres = np.vstack([np.eye(6), -np.eye(6)]) * 40
    x = np.round(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)), 1)
    x[:300] = x[0] + np.round(rng.normal(size=(300, 6)) / 4, 1)  # a cell with a fifth of all rows, many equal
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, pairs = topk.search(df, F.col("vec_id") % 7 == 0, "vec_id", "embedding", 5, 256.0, 24, 4096)
    whole = np.floor(256 * x).astype(np.int64)
    scores = whole @ whole.T
    expected = []
    for q in range(0, 1500, 7):
        order = [j for j in np.lexsort((np.arange(1500), -scores[q])).tolist() if j != q][:5]
        expected += [(q, n + 1, j, int(scores[q, j])) for n, j in enumerate(order)]
    assert sorted(tuple(r) for r in found.collect()) == expected
    groups, blocks = pairs.select("grp").distinct().count(), 1500 / 32
    assert groups >= 14 and pairs.count() < 0.6 * groups * blocks and pairs.where("NOT own").count() > 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(v) for v in rng.normal(size=rng.integers(0, 6)).round(1)]) for i in rng.integers(0, 40, 200)]
    rows += [(None, [1.0, 2.0]), (None, None), (0, [float("nan")]), (0, [1.0, None]), (50, [float("inf")])] + [(7, [2.0, 2.0, 2.0])] * 60
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit(0)).withColumn("cell", F.lit(0))
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for a, (i, v) in enumerate(sound):
        if i is not None and i % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), math.inf if j is None else j) for b, (j, w) in enumerate(sound) if b != a)[:5]
            expected += [(i, n + 1, None if j == math.inf else j, -s) for n, (s, j) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(None).cast("boolean")).count() == 0
    two = topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [3.0])], "vec_id long, embedding array<float>"), F.lit(True)).collect()
    assert sorted(map(tuple, two)) == [(1, 1, 2, 256 * 768), (2, 1, 1, 256 * 768)]


def test_topk_of_large_components(spark):
    """Also where products leave a double's exact integers, a long, or a double itself; only scores that leave a long are refused."""
    rng = np.random.default_rng(4)
    schema = "vec_id long, embedding array<double>"
    for rows in (
        [(i, [float(x) for x in rng.choice([1e6, -1e6, 0.5, 3.7], 8)]) for i in range(60)] + [(60, [1e6, 0.5])],
        [(i, [float(x) for x in rng.integers(-11_000_000, 11_000_000, 1)]) for i in range(40)],
        [(1, [2.0**22, 0.0]), (2, [0.0, 1e30]), (3, [2.0**22, 0.0]), (4, [-(2.0**22), 0.0]), (5, [0.0, 0.0])],
        [(1, [1e200, 0.0]), (2, [0.0, 1.0])],
    ):
        whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
        score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))  # noqa: B023, E731
        asked = [i for i in whole if i != 2 or len(rows) > 5]
        expected = sorted((q, n + 1, d, s) for q in asked for n, (s, d) in enumerate(sorted(((score(q, d), d) for d in whole if d != q), key=lambda x: (-x[0], x[1]))[:5]))
        got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id").isin(asked)).collect()
        assert sorted(map(tuple, got)) == expected
    assert topk.top_k(spark.createDataFrame([(1, [1e30])], schema), F.lit(True)).collect() == []
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(1, [1e30]), (2, [1e30])], schema), F.lit(True)).collect()


def plain_simhash(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_contract(spark):
    rows = queries.op3_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    fp = {r.doc_id: plain_simhash(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    part = {i: i for i in fp}
    for a in sorted(fp):
        for b in sorted(fp):
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", part[i]) for i in fp}


def test_simhash_of_odd_rows(spark):
    rows = simhash.near_duplicates(docs(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.component_id for r in rows} == {None: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 7}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_bk_tree_and_shards():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)})
    tree = simhash.BKTree(values)
    near = {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and (x ^ y).bit_count() <= 2}
    assert {(i, j) for i, x in enumerate(values) for j in tree.within(x, 2) if i < j} == near
    a, b = tree.links(2)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == near
    assert simhash.BKTree([]).within(3, 2) == [] and len(simhash.MASKS) == 28


def test_similar_groups(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(2)
    text = [rng.choice(words) for _ in range(300)]
    near = text[:290] + ["x"] * 10
    far = text[:120] + [rng.choice(words) for _ in range(180)]
    rows = [(9, " ".join(text), "a"), (4, " ".join(near), "b"), (6, " ".join(text).upper(), "c"), (3, " ".join(far), "d"), (None, " ".join(text), None), (11, None, "e"), (12, "  ", "f"), (8, "one two", "g"), (8, "one two", "g"), (None, None, None)]
    kept = simhash.drop_similar(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 8, 11] and all(r.uid == "clash" for r in kept)
    assert simhash.drop_similar(docs(spark, [])).count() == 0


def test_sketch_likeness():
    rng = np.random.default_rng(3)
    a, b = np.unique(rng.integers(0, 1 << 32, 3000)), np.unique(rng.integers(0, 1 << 32, 900))
    both = np.unique(np.concatenate([rng.permutation(a)[:2000], b]))
    pad = lambda x: np.concatenate([x[: simhash.SKETCH].astype(np.uint64), np.full(max(0, simhash.SKETCH - len(x)), simhash.FULL)])
    true = len(np.intersect1d(a, both)) / len(np.union1d(a, both))
    got = simhash.sketch_likeness(pad(a), np.stack([pad(both), pad(a), pad(np.empty(0))]))
    assert abs(got[0] - true) < 0.15 and got[1] == 1 and got[2] == 0
    assert simhash.sketch_likeness(pad(np.empty(0)), pad(np.empty(0))[None])[0] == 1


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows, likeness=0.8):
    """Ids of the rows that stay: the smallest of each group that links of exact likeness join."""
    sets, part = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and part[a] != part[b] and jaccard(sets[a], sets[b]) >= likeness:
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    return sorted(set(part.values()))


def test_likeness_near_the_limit_is_exact(spark):
    """Of pairs at likeness 0.775 and 0.825, of some 600 shingles each, sketches get a quarter wrong."""
    rng = random.Random(12)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):
        common, own = new(604), 87 if i % 2 else 64
        rows += [(2 * i, " ".join(common + new(own)), "s"), (2 * i + 1, " ".join(common + new(own)), "s")]
    likeness = [jaccard(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert {round(x, 3) for x in likeness} == {0.775, 0.824}
    assert sorted(r.doc_id for r in simhash.drop_similar(docs(spark, rows)).collect()) == kept_by_brute_force(rows)


def test_smallest_hashes_are_independent():
    """Sets of likeness 0.8 share each smallest hash with that probability, whichever others they share."""
    rng = np.random.default_rng(9)
    shared = []
    for _ in range(6000):
        x = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = simhash.smallest(x[:99]), simhash.smallest(x[11:])  # 88 of 110 in common
        shared.append((a == b).sum())
    counts = np.bincount(shared, minlength=7)
    assert abs(np.mean(shared) - 4.8) < 0.05 and counts[0] <= 4 and abs(counts[6] / 6000 - 0.8**6) < 0.03


def test_few_pairs_of_a_table_are_visited():
    """Of all pairs of texts that share a smallest hash, less than a tenth is visited in shards by bands of sizes; unrelated and
    like fingerprints lie far apart."""
    rng = random.Random(3)
    docs_ = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].dropna().sample(1500, random_state=1)
    told = simhash._features(5).func(pd.Series([t.encode() for t in docs_]))
    shards, wider = {}, {}
    for i, (least, band) in enumerate(zip(told["least"], told["band"], strict=True)):
        for n, x in enumerate(least):
            wider.setdefault((n, int(x)), set()).add(i)
            for b in (band, band + 1):
                shards.setdefault((n, int(x), b), []).append(i)
    prints = np.stack([np.frombuffer(x, np.uint64) for x in told["wide"]])
    sizes = told["size"].to_numpy()
    visited = sum(simhash.likely_in_shard(prints[own], sizes[own], 0.8)[1] for own in map(np.array, shards.values()) if len(own) > 1)
    every = len(docs_) * (len(docs_) - 1) // 2
    print("visited", visited, "of", every, "pairs, of pairs that share a hash", sum(len(x) * (len(x) - 1) // 2 for x in wider.values()))
    assert visited < every / 10
    a, b = (np.array([rng.getrandbits(64) for _ in range(500)], np.uint64) for _ in range(2))
    apart = lambda x, y: int(np.bitwise_count(simhash.wide(x) ^ simhash.wide(y)).sum())
    assert apart(a, np.concatenate([a[56:], b[:56]])) <= simhash.WIDE_RADIUS < 90 < apart(a, b)


def test_pair_recall(spark):
    """All pairs of likeness 0.8 or more of a whole table with planted copies of copies are in one group, and groups are what
    such pairs join: by brute force over the pairs that share a shingle."""
    rng = random.Random(12)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    at = 1_000_000
    for base in rng.sample(sorted(i for i, t in texts.items() if len(t.split()) > 60), 60):
        words = texts[base].split()
        for edits in (1, 2, 4, 6):
            copy = list(words)
            for i in rng.sample(range(len(copy)), max(1, len(copy) * edits // 250)):
                copy[i] = f"new{at}x{i}"
            texts[at] = " ".join(copy)
            at += 1
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    pairs = {p for ids in holders.values() if len(ids) > 1 for p in itertools.combinations(sorted(ids), 2)}
    near = {p: x for p in pairs if (x := jaccard(sets[p[0]], sets[p[1]])) >= 0.8}
    edge = [p for p, x in near.items() if x < 0.85]
    rows = [(i, t, "s") for i, t in texts.items()]
    groups = {r.doc_id: r.g for r in simhash.similar_groups(docs(spark, rows), uid="u", group="g").select("doc_id", "g").collect()}
    assert len(near) > 400 and len(edge) > 30
    assert sum(groups[a] == groups[b] for a, b in near) == len(near)
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        root[top(a)] = top(b)
    assert len({top(i) for i in texts if texts[i].split()}) == len({groups[i] for i in texts if texts[i].split()})


def test_all_pairs_of_a_crowded_shard_meet(spark, monkeypatch):
    """Each pair is at likeness 0.8 or more, shares one min-hash alone, and shares that with short texts that make a crowd."""
    rng = random.Random(13)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    while len(rows) < 24:
        common = new(104)
        a, b = common + new(10), common + new(10)
        least = simhash._features(5).func(pd.Series([" ".join(x).encode() for x in (a, b)]))["least"]
        same = np.flatnonzero(least[0] == least[1])
        if len(same) == 1:
            grams = [" ".join(common[i : i + 5]) for i in range(100)]
            least_of = [x[same[0]] for x in simhash._features(5).func(pd.Series([g.encode() for g in grams]))["least"]]
            crowd = grams[least_of.index(least[0][same[0]])]
            n = len(rows)
            rows += [(n, " ".join(a), "s"), (n + 1, " ".join(b), "s"), (n + 2, crowd, "s"), (n + 3, crowd.upper(), "s"), (n + 4, crowd.title(), "s"), (n + 5, " " + crowd, "s")]
    assert len(kept_by_brute_force(rows)) == 8
    for crowd, size in ((10_000, 1 << 20), (5, 1 << 20), (2, 1 << 20), (10_000, 400)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "CROWD_BYTES", size, raising=False)
        assert sorted(r.doc_id for r in simhash.drop_similar(docs(spark, rows)).collect()) == kept_by_brute_force(rows)


def test_repeats_in_a_text_do_not_part_similar_ones(spark):
    """The same shingles, one of them 296 times in one text and 8 times in the other."""
    rng = random.Random(14)
    rows = []
    for i in range(30):
        text, word = [f"v{rng.randrange(10**9)}" for _ in range(200)], f"v{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(text + [word] * 300), "s"), (2 * i + 1, " ".join(text + [word] * 12), "s")]
    kept = sorted(r.doc_id for r in simhash.drop_similar(docs(spark, rows)).collect())
    assert kept == kept_by_brute_force(rows) == list(range(0, 60, 2))


def test_fingerprint_contract(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.desc("doc_id")).collect()
    rows = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    errors = []
    for i, d in enumerate(given):
        nxt, third = given[(i + 1) % len(given)].text, len(d.text) // 3
        edited = d.text[: len(d.text) - third] + nxt[:third]
        r = rows[d.doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(d.text), shingles(edited), shingles(nxt)
        errors += [abs(r.near_edited - jaccard(a, b)), abs(r.near_next - jaccard(a, c)), abs(r.distinct_shingles / max(1, len(a)) - 1), abs(r.contained_in_edited - len(a & b) / max(1, len(a)))]
    assert len(rows) == len(given) and np.mean(errors) < 0.03 and max(errors) < 0.35


@pytest.mark.parametrize("bucket", [2, 1000])
def test_edits_of_odd_rows(spark, monkeypatch, bucket):
    plain = sketches.with_next
    monkeypatch.setattr(sketches, "with_next", lambda d, i, t: plain(d, i, t, bucket))
    many = ODD + [(i, f"number {i} " * (i % 4), "s") for i in range(20, 60, 3)]
    for rows in (many, ODD[:1], [(None, "only", "s")], [(None, "ab", "s"), (None, "abc", "s")], []):
        order = sorted(((i is None, -(i or 0), xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1, (t or "").encode()), i, t or "") for i, t, _ in rows)
        expected = []
        for n, (_, i, t) in enumerate(order):
            third = len(t) // 3
            expected.append((i, t[: len(t) - third] + order[(n + 1) % len(order)][2][:third]))
        got = [(r.id, r.edited) for r in sketches.with_edits(docs(spark, rows)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))


def test_repeated_and_null_ids_are_spread(spark, monkeypatch):
    """100,000 rows without an id, 50,000 of one id and others: many buckets, each row beside its next one."""
    monkeypatch.setattr(sketches, "SHARES", 8)
    given = spark.range(160_000).select(F.when(F.col("id") < 100_000, None).when(F.col("id") < 150_000, F.lit(77)).otherwise(F.col("id") % 3000).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows, window = sketches.with_next(given, "doc_id", "text", 4000)
    buckets = rows.groupBy("place", "part").count().collect()
    assert len(buckets) >= 38 and max(r["count"] for r in buckets) < 16_000 and sum(r.place == -1 for r in buckets) == 25 and sum(r["count"] for r in buckets) == 160_000 + len(buckets)
    got = {r.text: r.following for r in rows.withColumn("following", F.lead("text").over(window)).where("NOT extra").collect()}
    key = lambda r: (r.doc_id is None, -(r.doc_id or 0), xxhash.xxh64_intdigest(r.text, 42) >> 1)
    order = [r.text for r in sorted(given.collect(), key=key)]
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h", "e f g h i j k", "a b c d e f g h i j k")], "x string, y string, z string")
    s = lambda c: sketches.sketch(F.col(c))
    r = df.select(sketches.merge(s("x"), s("y")).alias("m"), s("z").alias("whole"), sketches.resemblance(s("x"), s("y")).alias("j"), sketches.resemblance(sketches.sketch(F.lit("")), sketches.sketch(F.lit(None).cast("string"))).alias("e"), sketches.containment(s("x"), s("z")).alias("c")).first()
    assert r.m == r.whole and r.j == 0.0 and r.e == 1.0 and r.c == pytest.approx(1.0)


def brute_repeats(rows, length):
    seen, words = {}, {}
    for i, t in {(i, t) for i, t, _ in rows}:
        words[i, t] = w = (t or "").encode().lower().split()
        for j in range(len(w) - length + 1):
            seen.setdefault(tuple(w[j : j + length]), set()).add((i, t))
    out = []
    for (i, _t), w in words.items():
        spans = []
        for j in range(len(w) - length + 1):
            if len(seen[tuple(w[j : j + length])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        out.append(str((i, spans)))
    return sorted(out)


def cut_hashes(monkeypatch, bits):
    mix = suffixes._mix
    monkeypatch.setattr(suffixes, "_mix", lambda x: mix(x) & np.uint64((1 << bits) - 1))


@pytest.mark.parametrize("crowd", [3, 50_000])
@pytest.mark.parametrize("bits", [64, 8])
def test_repeated_passages(spark, monkeypatch, crowd, bits):
    """Also where all hashes have eight bits alone: the words decide."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    cut_hashes(monkeypatch, bits)
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") for _ in range(300)]
    rows = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, 280)
            parts += base[at : at + rng.randint(1, 40)] + [rng.choice("xyz") for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 25) if rng.random() > 0.1 else None, " ".join(parts) if rng.random() > 0.05 else None, "s"))
    rows += [(90, "c d " * 40, "s"), (91, "c d " * 40, "s"), (91, "c d " * 40, "s")]
    found = suffixes.repeated_passages(docs(spark, rows), passage=12, gram=5)
    got = sorted(str((r.id, [[s.low, s.high] for s in r.spans])) for r in found.collect())
    assert got == brute_repeats(rows, 12)
    left = suffixes.without_repeats(docs(spark, rows), found)
    assert left.count() == len(rows) and left.where("doc_id = 90").first().text == ""


def test_passage_query_returns_every_document(spark):
    docs_ = [(r.doc_id, r.text, "s") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r.spans for r in queries.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    told = {i: ",".join(f"{a}:{b}" for a, b in spans) for i, spans in map(eval, brute_repeats(docs_, 50))}
    assert got == told and any(got.values()) and len(got) == len(docs_)


def test_passages_of_odd_rows(spark):
    found = suffixes.repeated_passages(docs(spark)).collect()
    assert len(found) == len({(i, t) for i, t, _ in ODD}) and all(r.spans == [] for r in found)
    assert suffixes.repeated_passages(docs(spark, [])).count() == 0


def test_fifty_words_are_found_and_forty_nine_are_not(spark):
    rng = random.Random(6)
    new = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    fifty, fewer = new(50), new(49)
    rows = [(1, f"{new(70)} {fifty} {new(9)}", "s"), (2, f"{fifty} {new(80)}", "s"), (3, f"{new(5)} {fewer}", "s"), (4, f"{fewer} {new(30)}", "s")]
    got = {r.id: [(s.low, s.high) for s in r.spans] for r in suffixes.repeated_passages(docs(spark, rows)).collect()}
    assert got == {1: [(70, 120)], 2: [(0, 50)], 3: [], 4: []}


@pytest.mark.parametrize("bits", [64, 32, 8, 1])
def test_words_decide_not_hashes(monkeypatch, bits):
    """Twenty words in other surroundings are no repeated passage, fifty are, however many windows have the same hash."""
    cut_hashes(monkeypatch, bits)
    rng = random.Random(8)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]

    def spans(length):
        rows = []
        for _ in range(30):
            common = new(length)
            for _ in range(2):
                words = [w.encode() for w in new(60) + common + new(60)]
                found = [(int(h), len(rows), int(d), b" ".join(words[at : at + n + 49]), int(at)) for part in suffixes.suffixes(words) for h, at, d, n in zip(*part, strict=True)]
                rows.append(found)
        flat = sorted(x for found in rows for x in found)
        h, uid, away, words, at = zip(*flat, strict=True)
        near = suffixes.Neighbours(np.array(h, np.uint64).view(np.int64), np.array(uid), np.array(away), list(words), 50)
        return sorted(set(zip(*(x.tolist() for x in near.spans([[i] for i in at])), strict=True)))

    assert spans(20) == [] and spans(50) == [(i, 60, 110) for i in range(60)]


def test_spans_merge_in_order(spark):
    rng = random.Random(3)
    rows = [(sorted((a, a + rng.randint(1, 30)) for a in (rng.randrange(4000) for _ in range(n))),) for n in (0, 1, 2, 63, 64, 65, 300)]
    df = spark.createDataFrame(rows, "spans array<struct<low:int,high:int>>")
    for r in df.withColumn("merged", suffixes._merged(F.col("spans"))).collect():
        out = []
        for a, b in r.spans:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        assert [list(x) for x in r.merged] == out


def test_segments_make_no_difference(monkeypatch):
    rng = random.Random(7)
    words = [b"%d" % rng.randrange(9) for _ in range(900)]
    flat = lambda: {(int(h), int(s + a)) for part in suffixes.suffixes(words) for h, s, a, _ in zip(*part, strict=True)}
    whole = flat()
    monkeypatch.setattr(suffixes, "SEGMENT", 70)
    assert flat() == whole
