"""Compression of vectors to codes: product quantization in whole numbers, searched by partial distances.

A vector's components become whole numbers and are cut into equal parts; each part is told
by its nearest entry in a small codebook of its own. The nearest entry is found one entry at
a time, dimension after dimension, those first in which the codebook differs most: a part
leaves the race with an entry as soon as the distance so far is beyond the best whole one.
Rounds of fitting run over all rows; a task returns sums per entry, Spark adds them up, and
the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxmark.llm.common import materialize

#: Rows that are compared with an entry at a time; labels up to which their sums are sent to every task.
STEP, LABELS = 4096, 100_000
LONG = (1 << 63) - 1


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the index of its nearest entry in ``book`` (squared distance, ties to the lower index) and that distance."""
    whole = book.astype(object)
    spread = len(book) * (whole * whole).sum(axis=0) - whole.sum(axis=0) ** 2  # len(book)**2 times the variance
    order = sorted(range(book.shape[1]), key=lambda j: (-spread[j], j))
    columns = [np.ascontiguousarray(parts[:, j]) for j in order]
    best = np.zeros(len(parts), parts.dtype)
    for column, j in zip(columns, order, strict=True):
        best += (column - book[0, j]) ** 2
    index = np.zeros(len(parts), np.int64)
    for e in range(1, len(book)):
        alive, far = np.arange(len(parts)), np.zeros(len(parts), parts.dtype)
        for column, j in zip(columns, order, strict=True):
            far += (column[alive] - book[e, j]) ** 2
            stay = (far <= best[alive]).astype(bool)
            alive, far = alive[stay], far[stay]
            if not len(alive):
                break
        closer = (far < best[alive]).astype(bool)
        best[alive[closer]], index[alive[closer]] = far[closer], e
    return index, best


@dataclass
class Codebooks:
    """``entries[p][e]``: the whole numbers of entry e of part p; ``dim`` components a vector, zeros behind its end included."""

    entries: np.ndarray
    scale: float

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def whole(self, vectors: pa.Array) -> np.ndarray:
        """Vectors as whole numbers (rows, parts, places): 64-bit ones or, where their squares might not fit, Python's own."""
        n, offsets = len(vectors), vectors.offsets.to_numpy()
        sizes, flat = np.diff(offsets), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.zeros((n, self.dim))
        out[np.arange(self.dim) < sizes[:, None]] = np.floor(flat * self.scale)  # exact: the scale is a power of two
        if self.entries.dtype == object:
            whole = np.empty(out.shape, object)
            whole[:] = [[int(x) for x in row] for row in out]
        else:
            whole = out.astype(np.int64)
        return whole.reshape(n, self.entries.shape[0], self.entries.shape[2])

    def assign(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows at a time: their whole numbers, the entries of their parts and the distances to these."""
        for i in range(0, len(vectors), STEP):
            x = self.whole(vectors.slice(i, STEP))
            found = [nearest(x[:, p], book) for p, book in enumerate(self.entries)]
            yield x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        chosen = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
        return [float(x) / self.scale for book, e in zip(self.entries, chosen, strict=True) for x in book[e]]


class Quantizer:
    """Codebooks for the vectors of a table, and all its vectors' codes.

    Rows whose vector is null or holds a null or non-finite component are left out. Each
    component x becomes floor(scale * x); shorter vectors count as padded with zeros, as all
    are where the longest does not cut into equal parts. Codebooks start with the parts of
    the ``size`` smallest ids, ascending (nulls last, ties by the vector; fewer rows give fewer entries),
    and are fitted in ``rounds`` rounds over all rows: every part goes to its nearest entry,
    and an entry becomes the floor of its parts' mean; one without parts stays. Repeated rows
    and ids count each for themselves, other columns are ignored, no rows give no codes. Work
    is in exact whole numbers, 64-bit ones wherever these suffice; a component beyond 2**62 after
    scaling and an error beyond a long are refused.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, size: int = 16, rounds: int = 6, scale: float = 4096.0):
        if size > 256:
            raise ValueError("a code has two hex digits a part: size must be 256 at most")
        x = F.col(vector_col)
        sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
        self.parts, self.spark = parts, vectors.sparkSession
        self.rows = materialize(vectors.where(sound).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")), "vectors")
        told = self.rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()
        width = -(-(told[1] or 0) // parts)
        most = float(told[2] or 0) * scale + 1
        if most > 2.0**62:
            raise ValueError("a component is beyond 2**62 after scaling")
        number = np.int64 if max(parts * width, 1) * (2 * most) ** 2 < 2.0**62 else object
        first = self.rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(size).toArrow()["x"].combine_chunks() if told[0] else None
        seeds = Codebooks(np.zeros((parts, 0, width), number), scale)
        self.books = Codebooks(np.ascontiguousarray(seeds.whole(first).transpose(1, 0, 2)) if told[0] else seeds.entries, scale)
        for _ in range(rounds if told[0] and width else 0):
            fitted = self._fitted()
            if (fitted == self.books.entries).all():
                break  # so would all further rounds
            self.books = Codebooks(fitted, scale)

    def _fitted(self) -> np.ndarray:
        """The codebooks after one more round."""
        sent = self.spark.sparkContext.broadcast(self.books)
        schema = "part int, entry int, place int, n long, total string"

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books: Codebooks = sent.value
            shape = books.entries.shape
            n, total = np.zeros(shape[:2], np.int64), np.zeros(shape, books.entries.dtype)
            for batch in batches:
                for x, index, _ in books.assign(batch.column(0)):
                    for p in range(shape[0]):
                        n[p] += np.bincount(index[:, p], minlength=shape[1])
                        np.add.at(total[p], index[:, p], x[:, p])
            part, entry, place = (a.ravel() for a in np.indices(shape))
            used = n[part, entry] > 0
            part, entry, place = part[used], entry[used], place[used]
            arrays = [pa.array(a, pa.int32()) for a in (part, entry, place)] + [pa.array(n[part, entry]), pa.array([str(int(v)) for v in total[part, entry, place]], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "place", "n", "total"])

        added = self.rows.select("x").mapInArrow(sums, schema).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
        out = self.books.entries.copy()
        for r in added.collect():  # one row for each component of the codebooks
            out[r.part, r.entry, r.place] = int(r.total) // r.n
        sent.destroy()
        return out

    def codes(self) -> DataFrame:
        """(id, label, code, error): two hex digits for each part's entry, and the squared distance to what they stand for."""
        sent = self.spark.sparkContext.broadcast(self.books)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books: Codebooks = sent.value
            for batch in batches:
                codes, errors = [], []
                for _, index, far in books.assign(batch.column(2)):
                    codes += [x.tobytes().hex() for x in index.astype(np.uint8)]
                    errors += [int(x) for x in far.astype(object).sum(axis=1)] if far.dtype == object else far.sum(axis=1).tolist()
                if errors and max(errors) > LONG:
                    raise OverflowError("an error is beyond a long")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

        types = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return materialize(self.rows.mapInArrow(told, f"id {types['id']}, label {types['label']}, code string, error long"), "codes")

    def codes_by_label(self) -> DataFrame:
        """``codes`` with label_error, the errors added up over equal labels (nulls are one), and codebooks_sha256."""
        codes = self.codes()
        sums = materialize(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
        if sums.count() <= LABELS:
            sums = F.broadcast(sums)
        return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(self.books.sha256()))


def sql(parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """What ``codes_by_label`` returns for the table ``embeddings``, in DuckDB's SQL; vectors of equal length that cut into equal parts."""
    distance = "list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))"

    def assigned(r: int) -> str:
        return f"a{r} AS MATERIALIZED (SELECT uid, part, any_value(p) AS p, min({{'far': far, 'entry': entry}}) AS best FROM (SELECT uid, part, p, entry, {distance} AS far FROM pieces JOIN b{r} USING (part)) AS met GROUP BY uid, part)"

    def fitted(r: int) -> str:
        return f"""means{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                SELECT part, best.entry AS entry, i, sum(p[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(p) + 1)) AS t(i) GROUP BY part, best.entry, i) AS sums GROUP BY part, entry),
            b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(CAST(m AS HUGEINT[]), c) AS c FROM b{r} LEFT JOIN means{r} USING (part, entry))"""

    steps = ", ".join(f"{assigned(r)}, {fitted(r)}" for r in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pieces AS MATERIALIZED (SELECT uid, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS p FROM kept, unnest(range({parts})) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, uid - 1 AS entry, p AS c FROM pieces WHERE uid <= {size}),
        {steps}, {assigned(rounds)},
        coded AS (SELECT uid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY uid),
        books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (uid), books"""
