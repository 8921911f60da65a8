"""Exact top-k by inner product: a kNN join over Voronoi cells.

A point at the end of each vector, sqrt(M*M - |x|**2) with M the largest norm, turns the
largest inner products into the smallest Euclidean distances, where the triangle inequality
holds. Data are dealt to their nearest pivots, in whose cells they lie in blocks that are
ordered by the distance to the pivot; queries are put into groups of neighbouring cells.
Each group is first solved in its own cells. The distance of a query's k-th answer there
bounds what other cells can hold for it: rows on the far side of the plane between two
pivots, or outside the shell of that width around the query's distance to a pivot, are out of
reach. A block goes to a group if one of its queries may need it, once for the whole group,
and is solved where it lands, exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxmark.llm.common import batches_of, materialize, with_uid

#: Rows of a block, blocks of a slice (what one task solves for one group), and the bounds of a group's queries.
BLOCK, SLICE, LEAST_GROUP, MOST_GROUP = 2048, 16, 512, 8192
STEP = 256  # rows of a block that are scored at once
NO_ID = np.iinfo(np.int64).max
LONG = 2.0**63


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the sampled points, each in turn the farthest from those before it."""
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim``."""
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _integers(v: np.ndarray) -> np.ndarray:
    """Whole numbers of any size, as Python's own."""
    out = np.empty(v.shape, object)
    out[:] = [[int(x) for x in row] for row in v]
    return out


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        away = np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1)
    return np.nan_to_num(away, nan=0.0, posinf=1e300)  # squares may leave a double; bounds are not trusted then


class Best:
    """The ``k`` highest scores of each of ``n`` queries, ties to smaller ids, as rows come in."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)  # a lower score is of no use

    def add(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, own: np.ndarray) -> None:
        """Scores of all queries with some rows; ``own`` are the queries' own uids, which are no answers."""
        q, at = np.nonzero(scores >= self.least[:, None])
        other = uids[at] != own[q]
        q, at = q[other], at[other]
        self.query = np.concatenate([self.query, q])
        self.id = np.concatenate([self.id, ids[at]])
        self.score = np.concatenate([self.score, scores[q, at].astype(np.int64)])
        if len(self.query) > 4 * self.k * self.n:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.id, -self.score, self.query))
        q = self.query[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.query, self.id, self.score = self.query[order], self.id[order], self.score[order]
        last = nth == self.k - 1
        self.least[self.query[last]] = self.score[last]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, pivots: int | None = None, sample: int = 4096) -> DataFrame:
    """Each query row's ``k`` highest integer inner products: (query_id, rank, vec_id, score).

    Components become floor(scale * x). Candidates are all rows but the query's own; equal
    scores go to the smaller id, null ids last. Rows whose vector is null or has a null, NaN
    or infinite component take no part; shorter vectors count as padded with zeros, empty
    ones score 0. Repeated rows and ids are rows of their own, so a copy of a query is one
    of its candidates. Where fewer than ``k`` rows are there, all are returned; other
    columns are ignored; no rows or no queries give none. Components of any finite size
    are taken; only a score that does not fit a long is an error.

    The driver holds ``sample`` vectors, of which ``pivots`` become pivots (None: 16 to 1024, by
    the root of the number of rows): nothing that grows with the rows beyond that. A cell is any
    number of blocks and a group's blocks are any number of tasks, so a cell that holds a third
    of all rows is spread like any other rows.
    """
    found, _ = search(vectors, is_query, id_col, vector_col, k, scale, pivots, sample)
    return found


def search(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, scale: float, pivots: int | None, sample: int) -> tuple[DataFrame, DataFrame | None]:
    """The answers, and the pairs (grp, block, cell, own) of groups and blocks that had to meet."""
    spark = vectors.sparkSession
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    scaled = lambda v: v.cast("double") * scale
    whole = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < 2.0**53, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))  # larger doubles are whole
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), whole.alias("x"))
    rows = materialize(with_uid(rows), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    told = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    n = told[0]
    asked, highest = rows.where("query").agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()
    if not asked:
        return empty, None
    dim, longest = int(told[1]), float(told[2] or 0) * (1 + 1e-12) + 1e-9
    greatest = float(told[3] or 0)
    exact_floats = dim * greatest * greatest < 2**52  # then doubles add up to the very integers
    # No score is above the product of the two lengths; where that may leave a long, scores are Python's integers and no bound is trusted.
    wide = not float(highest or 0) ** 0.5 * longest**0.5 * (1 + 1e-9) < LONG
    stored = np.int32 if greatest < 2**31 else np.float64

    def lift(v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))])

    def flat(v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.zeros(len(v))])

    picked = rows.orderBy(F.xxhash64("uid"), "uid").select("x").limit(sample).toPandas()
    centres = _pivots(lift(_matrix(picked["x"], dim)), pivots or min(1024, max(16, isqrt(n) // 8)))
    sent = spark.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = _matrix(pdf["x"], dim)
            away = _distances(flat(v) if pdf["query"].iloc[:1].any() else lift(v), sent.value)
            cell = away.argmin(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32), away=away[np.arange(len(v)), cell])[["uid", "id", "x", "query", "cell", "away"]]

    def packed(size: int, whole: bool):
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None

            def close(own: pd.DataFrame) -> pd.DataFrame:
                ids = np.array([NO_ID if pd.isna(i) else i for i in own["id"]], np.int64)
                return pd.DataFrame({"block": [int(own["uid"].iloc[0])], "cells": [own["cell"].unique().tolist()], "low": [own["away"].min()], "high": [own["away"].max()], "uids": [own["uid"].to_numpy(np.int64).tobytes()], "ids": [ids.tobytes()], "x": [_matrix(own["x"], dim).astype(stored).tobytes()]})

            for pdf in batches:
                held = pdf if held is None else pd.concat([held, pdf])
                while len(held):
                    same = len(held) if whole else int((held["cell"].to_numpy() == held["cell"].iloc[0]).argmin()) or len(held)
                    take = min(same, size)
                    if take == len(held) and take < size:  # more may follow
                        break
                    yield close(held.iloc[:take])
                    held = held.iloc[take:]
            if held is not None and len(held):
                yield close(held)

        return pack

    def dealt(some: DataFrame, size: int, whole: bool, parts: int, name: str) -> DataFrame:
        """Rows in order of cell and distance, ``size`` to a block; of several cells if ``whole``."""
        near = some.mapInPandas(placed, "uid long, id long, x array<double>, query boolean, cell int, away double")
        sorted_ = near.repartitionByRange(parts, "cell", "away", "uid").sortWithinPartitions("cell", "away", "uid")
        return materialize(sorted_.mapInPandas(packed(size, whole), "block long, cells array<int>, low double, high double, uids binary, ids binary, x binary"), name)

    size = min(MOST_GROUP, max(LEAST_GROUP, asked // 64))
    groups = dealt(rows.where("query"), size, True, -(-asked // size), "groups").withColumnRenamed("block", "grp")
    blocks = dealt(rows.withColumn("query", F.lit(False)), BLOCK, False, -(-n // BLOCK), "blocks").withColumn("cell", F.element_at("cells", 1))

    def solved(pairs: DataFrame) -> DataFrame:
        """(grp, quid, query_id, vec_id, score): the best of each query in each slice of its group's blocks."""
        many = F.pmod(F.xxhash64("block"), F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE))).cast("int")
        sized = pairs.join(pairs.groupBy("grp").agg(F.count("*").alias("n")), "grp").select("grp", "block", many.alias("slice"))
        own = sized.select("grp", "slice").distinct().join(groups, "grp").select("grp", "slice", F.lit(0).alias("kind"), F.col("grp").alias("block"), "uids", "ids", "x")
        data = sized.join(blocks, "block").select("grp", "slice", F.lit(1).alias("kind"), "block", "uids", "ids", "x")
        together = own.union(data).repartition("grp", "slice").sortWithinPartitions("grp", "slice", "kind", "block")
        return together.mapInPandas(solve, "grp long, quid long, query_id long, vec_id long, score long")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.float64 if exact_floats else np.int64
        now: tuple | None = None

        def answers() -> pd.DataFrame:
            grp, _, quids, qids, best = now
            best.cut()
            return pd.DataFrame({"grp": grp, "quid": quids[best.query], "query_id": qids[best.query], "vec_id": best.id, "score": best.score})

        for pdf in batches:
            for grp, _, kind, _, uids, ids, x in pdf.itertuples(index=False):
                uids, ids = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64)
                v = np.frombuffer(x, stored).reshape(len(uids), dim)
                v = _integers(v) if wide else v.astype(number)
                if kind == 0:
                    if now:
                        yield answers()
                    now = grp, v, uids, ids, Best(len(uids), k)
                    continue
                for i in range(0, len(v), STEP):
                    scores = now[1] @ v[i : i + STEP].T
                    if wide and any(abs(x) >= LONG for x in scores[uids[i : i + STEP] != now[2][:, None]]):
                        raise OverflowError("a score is beyond a long")
                    now[4].add(scores, ids[i : i + STEP], uids[i : i + STEP], now[2])
        if now:
            yield answers()

    own_cells = groups.select("grp", F.explode("cells").alias("cell")).join(blocks.select("block", "cell"), "cell").select("grp", "block", "cell")
    with batches_of(spark, 64):
        first = materialize(solved(own_cells), "first")
        order = Window.partitionBy("quid").orderBy(F.desc("score"))
        kth = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).groupBy("grp").agg(F.collect_list(F.struct("quid", "score")).alias("known"))

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            between = np.linalg.norm(sent.value[:, None] - sent.value[None], axis=2)
            slack = np.inf if wide else 1e-6 * (1 + float(np.sqrt(longest)))
            for pdf in batches:
                for grp, uids, x, known in pdf.itertuples(index=False):
                    uids = np.frombuffer(uids, np.int64)
                    v = np.frombuffer(x, stored).reshape(len(uids), dim).astype(float)
                    scores = {r["quid"]: r["score"] for r in known} if known is not None else {}
                    least = np.array([scores.get(u, -np.inf) for u in uids.tolist()])
                    theta = np.sqrt(np.maximum((v * v).sum(1) + longest - 2 * least, 0)) + slack
                    away = _distances(flat(v), sent.value)
                    cell = away.argmin(axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (away**2 - away[np.arange(len(v)), cell][:, None] ** 2) / (2 * between[cell])
                    out = np.nan_to_num(plane, nan=-np.inf, posinf=-np.inf) > theta[:, None]  # beyond the plane between the pivots
                    low = np.where(out, np.inf, away - theta[:, None]).min(axis=0)
                    high = np.where(out, -np.inf, away + theta[:, None]).max(axis=0)
                    some = np.flatnonzero(low <= high)
                    yield pd.DataFrame({"grp": grp, "cell": some.astype(np.int32), "from": low[some], "upto": high[some]})

        reach = groups.join(kth, "grp", "left").select("grp", "uids", "x", "known").mapInPandas(bound, "grp long, cell int, from double, upto double")
        meet = reach.join(blocks.select("block", "cell", "low", "high"), "cell").where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("upto"))).select("grp", "block", "cell")
        others = materialize(meet.join(own_cells, ["grp", "block"], "left_anti"), "pairs")
        best = materialize(first.union(solved(others.select("grp", "block"))), "best")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    back = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c)).alias(c)
    found = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(back("query_id"), F.col("rank").cast("int").alias("rank"), back("vec_id"), "score")
    return found, own_cells.withColumn("own", F.lit(True)).union(others.withColumn("own", F.lit(False)))
