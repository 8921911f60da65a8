"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes (by words) those are retained that start at a minimiser: a position whose
20-word hash is the smallest in some window of ``PASSAGE`` words. What a window selects
depends on its words alone, so the same passage selects the same suffixes wherever it
stands. Suffixes are dealt by their first words' hash. They carry the words of all windows
that selected them, up to 30 to the left of the suffix's start and 50 to its right. Those
that are dealt together are sorted by their words; neighbours are compared by the words they
begin with, and matches are extended to the left word by word, so no hash can make one.
A word is repeated if some window of ``PASSAGE`` words over it stands in another document too.

Texts are read for their suffixes' hashes first; only texts with suffixes that several texts
have are read again, for these suffixes' words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.llm.common import TEXTS, let, materialize, running

PASSAGE, GRAM = 50, 20
SEGMENT = 1 << 17  # words of a huge text that are in work at once
#: Texts with the same start beyond which their suffixes are compared by a distributed aggregation, not in one task.
CROWD = 512
#: Groups of copies up to which their list (24 bytes each) is sent to every task; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SPANS = "array<struct<low:int,high:int>>"

_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))])
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int) -> np.ndarray:
    """Of every ``length`` words in turn, given where words start and stop in the bytes, the hash of their bytes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, len(raw)))])
    a, b = starts[: max(0, len(starts) - length + 1)], stops[length - 1 :]
    return _mix((sums[b] - sums[a]) * _powers_of(_INVERSE, len(raw))[a])


def suffixes(words: list[bytes], passage: int = PASSAGE, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """The retained suffixes of a text, a segment at a time: (hash of the first words, first window's start, its distance
    to the suffix, number of windows)."""
    for s in range(0, max(0, len(words) - passage + 1), SEGMENT):
        raw = np.frombuffer(b" ".join(words[s : s + SEGMENT + passage - 1]) + b" ", np.uint8)
        stops = np.flatnonzero(raw == 32)
        grams = _hashes(raw, np.concatenate([[0], stops[:-1] + 1]), stops, gram)
        windows = len(stops) - passage + 1
        at = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, passage - gram + 1).argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        yield grams[at[first]], first + s, at[first] - first, np.diff(np.append(first, windows))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _starts(passage: int, gram: int):
    """(h, uid) of the texts' retained suffixes, each once a text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                if found := [h for h, *_ in suffixes(_words(text.as_py()), passage, gram)]:
                    h = np.unique(np.concatenate(found)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), uid))], ["h", "uid"])

    return find


def _kept(passage: int, gram: int):
    """Rows of the suffixes whose hashes are in ``hs``: (h, crowd, uid, starts, away, words); ``starts`` are the places of all
    suffixes of a text that have the same words around them (a word said a thousand times has a thousand)."""
    names = ["h", "crowd", "uid", "starts", "away", "words"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, uid in enumerate(batch.column("uid").to_pylist()):
                words = _words(batch.column("text")[i].as_py())
                hs, crowded = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("hs", "crowded"))
                places: dict[tuple, list[int]] = {}
                for h, start, away, n in suffixes(words, passage, gram):
                    h = h.view(np.int64)
                    some = np.flatnonzero(np.isin(h, hs))
                    for key, at, d, k in zip(h[some].tolist(), start[some].tolist(), away[some].tolist(), n[some].tolist(), strict=True):
                        places.setdefault((key, d, b" ".join(words[at : at + k + passage - 1])), []).append(at)
                much = set(crowded.tolist())
                for (key, d, around), at in places.items():
                    rows.append((key, key in much, uid, at, d, around))
                    size += len(around) + 8 * len(at)
                    if size > 4 << 20:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        h, crowd, uid, starts, away, words = zip(*rows, strict=True)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h, crowd, uid, starts, away, words), types, strict=True)], names)

    return find


def _joined_spans(uid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each uid in order, with overlapping and touching ones made one."""
    if not len(uid):
        return uid, low, high
    order = np.lexsort((low, uid))
    uid, low, high = uid[order], low[order], high[order]
    turn = np.cumsum(np.concatenate([[0], uid[1:] != uid[:-1]])).astype(np.int64) << 33
    reach = np.maximum.accumulate(turn + high)
    new = np.concatenate([[True], turn[1:] + low[1:] > reach[:-1]])
    begins = np.flatnonzero(new)
    return uid[begins], low[begins], (reach - turn)[np.append(begins[1:], len(uid)) - 1]


class Neighbours:
    """Suffixes in the order of their words, with the words around them: which windows do other documents have too?

    Words are numbers here, so equal numbers are equal words. Sorted suffixes that have a prefix
    in common are a run; a window that begins so many words left of the suffix is repeated
    if another document's suffix of its run, for the rest of the window, has the same words to its left."""

    def __init__(self, h: np.ndarray, uid: np.ndarray, away: np.ndarray, words: list[bytes], passage: int):
        self.h, self.uid, self.away, self.passage = h, uid, away, passage
        count = np.array([w.count(b" ") + 1 for w in words])
        n = count - passage + 1
        self.row = np.repeat(np.arange(len(h)), n)
        self.begin = np.cumsum(n) - n  # each suffix's first window
        self.place = np.arange(n.sum()) - self.begin[self.row]
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        stops = np.flatnonzero(raw == 32)
        offsets = np.concatenate([[0], stops - np.arange(len(stops))])
        said = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[raw != 32]))])
        codes = said.dictionary_encode().indices.to_numpy().astype(np.int64)
        start, none = np.cumsum(count) - count + away, -1 - np.arange(len(h))[:, None]  # a missing word is like no other
        self.right = self._around(codes, start, np.arange(passage), count - away, none)
        self.left = self._around(codes, start, -1 - np.arange(int(away.max(initial=0))), away, none)

    @staticmethod
    def _around(codes: np.ndarray, start: np.ndarray, steps: np.ndarray, have: np.ndarray, none: np.ndarray) -> np.ndarray:
        """Of each suffix the words at ``steps`` from its start, as far as there are any."""
        at = np.clip(start[:, None] + steps, 0, max(0, len(codes) - 1))
        return np.where(np.arange(len(steps)) < have[:, None], codes[at], none)

    def repeated(self) -> np.ndarray:
        """Of each window, whether another document has its words."""
        hit = np.zeros(len(self.row), bool)
        order = np.lexsort([*self.right.T[::-1], self.h])
        h, right = self.h[order], self.right[order]
        common = np.cumprod(right[1:] == right[:-1], axis=1).sum(axis=1)  # words that neighbours begin with
        common[h[1:] != h[:-1]] = -1
        same_left, have = np.zeros(len(order), np.int64), (self.right >= 0).sum(axis=1)
        for left in range(self.left.shape[1] + 1):
            if left:  # one word further to the left
                pair = same_left * (int(self.left.max()) + len(order) + 2) + self.left[:, left - 1] + len(order) + 1
                same_left = np.unique(pair, return_inverse=True)[1]
            rest = self.passage - left
            run = np.empty(len(order), np.int64)
            run[order] = np.cumsum(np.concatenate([[0], common < rest]))
            some = np.flatnonzero((self.away >= left) & (have >= rest))
            if len(some) < 2:
                continue
            key = run[some] * (int(same_left.max()) + 1) + same_left[some]
            by = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            uid = self.uid[some][by]
            several = np.minimum.reduceat(uid, begins) != np.maximum.reduceat(uid, begins)
            found = some[by][np.repeat(several, np.diff(np.append(begins, len(by))))]
            hit[self.begin[found] + self.away[found] - left] = True
        return hit

    def spans(self, starts: list[list[int]]) -> tuple[np.ndarray, ...]:
        """(uid, low, high): what is repeated of each suffix, wherever the suffix starts."""
        hit = self.repeated()
        turn = self.row[1:] != self.row[:-1]
        low = np.flatnonzero(hit & np.concatenate([[True], turn | ~hit[:-1]]))
        high = np.flatnonzero(hit & np.concatenate([turn | ~hit[1:], [True]]))
        sizes = np.array([len(x) for x in starts])
        flat = np.concatenate([np.array(x, np.int64) for x in starts])
        times = sizes[self.row[low]]
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat((np.cumsum(sizes) - sizes)[self.row[low]], times)
        at = flat[each]
        return _joined_spans(np.repeat(self.uid[self.row[low]], times), at + np.repeat(self.place[low], times), at + np.repeat(self.place[high] + self.passage, times))


def _compare(passage: int):
    """Over suffixes dealt by their hash: spans (uid, low, high) of words that other documents have too."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h, uid, away, words, starts = zip(*rows, strict=True)
        uids, low, high = Neighbours(np.array(h, np.int64), np.array(uid, np.int64), np.array(away, np.int64), list(words), passage).spans(list(starts))
        return pa.RecordBatch.from_arrays([pa.array(uids), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["uid", "low", "high"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "away", "words", "starts")), strict=True)
            cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]), -1) + 1  # the last hash's rows may go on
            if cut:
                yield solve(held[:cut])
                held = held[cut:]
        if held:
            yield solve(held)

    return compare


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """One row per document: (id, text_hash, n_words, spans array<struct<low,high>>).

    Spans are ascending, apart, in words (A-Z lower-cased, cut at ASCII white space), ends
    exclusive, each at least ``passage`` long; every word of them lies in a window of
    ``passage`` words that another document has too. Rows with the same id and text are one
    document and never repeat themselves; a passage twice in one document alone does not
    count. Null, empty and shorter texts have no spans; null ids are ids; other columns are
    ignored; no rows give none.
    """
    text = F.col(text_col)
    words = F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")), F.lit(0)).cast("long")
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.hash(text).alias("more"))
    all_docs = materialize(own.select("id", "text_hash", "more", words.alias("n_words")).distinct(), "texts")
    # Texts that several documents have are repeated as a whole; one of each stands for all in what follows.
    copies = all_docs.groupBy("text_hash", "more").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(copies, "copies")
    small = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    single = own.join(small, ["text_hash", "more"], "left").where(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first")))
    rows = single.select(F.xxhash64("text_hash", "id").alias("uid"), F.col("text").cast("binary").alias("text"))
    bare = materialize(rows.mapInArrow(_starts(passage, gram), "h long, uid long"), "hashes", TEXTS)
    # All texts of a start count, by map-side sums; those in one text alone are done with.
    known = bare.groupBy("h").agg(F.min("uid").alias("a"), F.max("uid").alias("b"), F.count("*").alias("n")).where("a != b").select("h", (F.col("n") > CROWD).alias("crowd"))
    asked = bare.join(known, "h").groupBy("uid").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("crowd"), F.col("h"))).alias("crowded"))
    kept = materialize(rows.join(asked, "uid").mapInArrow(_kept(passage, gram), "h long, crowd boolean, uid long, starts array<int>, away int, words binary"), "suffixes", TEXTS)
    few = kept.where("NOT crowd").drop("crowd").repartition("h").sortWithinPartitions("h").mapInArrow(_compare(passage), "uid long, low int, high int")
    many = _crowds(kept.where("crowd"), passage)
    lists = few.select("uid", F.array(F.struct("low", "high")).alias("spans")).union(many)
    spans = lists.groupBy("uid").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    spans = materialize(spans.select("uid", _merged(F.col("spans")).alias("spans")), "spans", 4096)
    found = all_docs.join(small.withColumn("copied", F.lit(True)).drop("first"), ["text_hash", "more"], "left").withColumn("uid", F.xxhash64("text_hash", "id")).join(spans, "uid", "left")
    whole = F.when(F.col("n_words") >= passage, F.array(F.struct(F.lit(0).alias("low"), F.col("n_words").cast("int").alias("high")))).otherwise(F.array())
    shown = F.when(F.col("copied"), whole.cast(SPANS)).otherwise(F.coalesce("spans", F.array().cast(SPANS)))
    return found.select("id", "text_hash", "n_words", shown.alias("spans"))


def _crowds(kept: DataFrame, passage: int) -> DataFrame:
    """The same comparison for starts that very many texts share: suffixes with the same words are one from the start, by
    map-side sums; their windows are compared by a second aggregation, and each suffix is joined once to the spans that its
    windows make. Words are told apart by two 64-bit hashes of theirs."""
    twice = lambda x: [F.xxhash64(x), F.xxhash64(F.lit("other"), x)]
    rows = kept.select("uid", "starts", "words", F.struct(*(x.alias(n) for x, n in zip(twice(F.col("words")), "ab", strict=True))).alias("same"))
    lists = rows.groupBy("same").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.min_by("words", "uid").alias("words"))
    words = F.split(F.col("words").cast("string"), " ", -1)
    windows = let(words, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_) - passage + 1), lambda i: F.struct(*(x.alias(n) for x, n in zip(twice(F.slice(all_, i, passage)), "ab", strict=True)))))
    spread = lists.select("same", "low", "high", F.posexplode(windows).alias("place", "key"))
    common = spread.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("key")
    hits = spread.join(common, "key", "left_semi").groupBy("same").agg(F.sort_array(F.collect_set(F.struct(F.col("place").alias("low"), (F.col("place") + passage).alias("high")))).alias("spans"))
    hits = materialize(hits, "hits", 4096)  # one row for suffixes with the same words, however many: the join below can be split where they are many
    shifted = F.flatten(F.transform("starts", lambda at: F.transform(_merged(F.col("spans")), lambda s: F.struct((at + s["low"]).alias("low"), (at + s["high"]).alias("high")))))
    return rows.select("uid", "starts", "same").join(hits, "same").select("uid", shifted.alias("spans"))


def _merged(spans: Column) -> Column:
    """Ascending spans with overlapping and touching ones made one."""

    def join(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda s: s["high"]), lambda a, b: F.greatest(a, b), -1)
        heads = F.filter(F.zip_with(all_, reach, lambda s, r: F.when(s["low"] > r, F.struct(s["low"].alias("low"), r.alias("before")))), lambda x: x.isNotNull())
        last = F.array_max(F.transform(all_, lambda s: s["high"]))
        return let(heads, lambda x: F.transform(x, lambda one, i: F.struct(one["low"].alias("low"), F.coalesce(F.get(x, i + 1)["before"], last).alias("high"))))

    return F.when(F.size(spans) == 0, F.array().cast(SPANS)).otherwise(let(spans, join))


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of the text (the words left are joined by one space where any went).

    Every copy of a passage goes; rows without spans keep their text as it is.
    """
    spans = passages.where(F.size("spans") > 0).select(F.col("id").alias("_rep_id"), F.col("text_hash").alias("_rep_hash"), F.col("spans").alias("_rep_spans"))
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["_rep_id"]) & (F.xxhash64(docs[text_col]) == spans["_rep_hash"]), "left")
    words = F.filter(F.split(docs[text_col], r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    gaps = lambda all_: F.transform(F.col("_rep_spans"), lambda s, i: F.slice(all_, F.coalesce(F.get("_rep_spans", i - 1)["high"], F.lit(0)) + 1, s["low"] - F.coalesce(F.get("_rep_spans", i - 1)["high"], F.lit(0))))
    rest = lambda all_: F.slice(all_, F.element_at("_rep_spans", -1)["high"] + 1, F.size(all_))
    left = let(words, lambda all_: F.concat(F.flatten(gaps(all_)), rest(all_)))
    kept = F.when(F.col("_rep_spans").isNull(), docs[text_col]).otherwise(F.array_join(left, " "))
    return joined.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])
