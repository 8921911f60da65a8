"""Vector codes beside brute force and SQL, with odd rows and large components among them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynxmark.llm import queries, quantize
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, size=16, rounds=6, scale=4096):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [[math.floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:size]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        groups = [[[] for _ in first] for _ in range(parts)]
        for v in whole:
            for p in range(parts):
                groups[p][best(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups[p], books[p], strict=True)] for p in range(parts)]
    found = [[best(v, p) for p in range(parts)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), e, by_label[label]) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), books


def some_rows(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 3 * n)) if i % 9 else None, (rng.normal(size=dim) * spread).round(3).tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i in range(n)]
    return rows + rows[:7] + [(1, None, 1), (2, [None] * dim, 1), (3, [math.nan] * dim, 1), (4, [math.inf] * dim, 1)]


@pytest.mark.parametrize("rows", [some_rows(150, 16, 1.0, 1), some_rows(60, 13, 2.0, 2) + [(5, [], 2), (6, [1.5], None)], some_rows(40, 16, 2e4, 3) + [(9, [1e5] * 16, 7)] * 20, some_rows(5, 16, 1.0, 4), [(1, [], 1), (2, [], 1)]])
def test_codes_beside_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "x", "code", "of", "error"):
        df = df.withColumn(c, F.lit("clash"))
    made = quantize.Quantizer(df.repartition(3))
    expected, books = brute(rows)
    assert made.books.entries.astype(object).tolist() == books
    assert sorted((str(r.id), r.code, r.error, r.label_error) for r in made.codes_by_label().collect()) == expected


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([[2e6] * 8, [2e6, -3.0] * 4, [-1e6] * 8, [0.25] * 8] + [[2e6] * 8] * 20)]
    made = quantize.Quantizer(spark.createDataFrame(rows, SCHEMA), parts=8, size=4, rounds=3)
    assert made.books.entries.dtype == object
    assert sorted((str(r.id), r.code, r.error, r.label_error) for r in made.codes_by_label().collect()) == brute(rows, size=4, rounds=3)[0]
    with pytest.raises(ValueError):
        quantize.Quantizer(spark.createDataFrame([(1, [1e300], 1)], SCHEMA))


def test_no_vectors(spark):
    assert quantize.Quantizer(spark.createDataFrame([(1, None, 1)], SCHEMA)).codes_by_label().count() == 0
    assert quantize.Quantizer(spark.createDataFrame([], SCHEMA)).codes_by_label().count() == 0


def test_partial_distances_and_decoding():
    rng = np.random.default_rng(3)
    for dim in (1, 3, 8):
        parts, book = rng.integers(-5, 6, (500, dim)), rng.integers(-5, 6, (16, dim))
        whole = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        index, far = quantize.nearest(parts, book)
        assert (index == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
    books = quantize.Codebooks(np.arange(12).reshape(2, 3, 2), 4.0)
    assert books.decode("0102") == [0.5, 0.75, 2.5, 2.75]


def test_same_as_sql(spark, sf):
    assert difference(spark, sf, queries.op12_vector_codes, queries.ORACLE_SQL["op12_vector_codes"]) == ""
