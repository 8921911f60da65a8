"""Token counts of whole texts, huge ones by encoding overlapping chunks and splicing them.

A cut between chunks must fall where no token can reach across whatever stands around it.
With a sentencepiece BPE model that is before a space that follows something else: no piece
of the vocabulary has its space mark after another character (checked when the model is
loaded), so no merge ever crosses there. Neighbouring chunks overlap; a splice is made at
such a place that both encodings have as a token boundary. Where the overlap has none, it
is widened, at last to the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MARK = "▁"


class Counter:
    """Counts a text's tokens; ``chunk`` and ``overlap`` are in characters."""

    def __init__(self, model: bytes, chunk: int = 1 << 16, overlap: int = 1 << 9):
        self.lib, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_proto=model), chunk, overlap
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        self.can_cut = not any(MARK in p.lstrip(MARK) for p in pieces)

    def bounds(self, text: str) -> np.ndarray:
        """Where each token of a text begins, in characters."""
        begins = np.array([p.begin for p in self.lib.encode(text, return_type="proto").pieces], np.int64)  # in bytes
        before = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return np.append(before, len(text))[begins]

    def _cut(self, text: str, lo: int, hi: int, left: set[int], right: set[int]) -> int:
        """The last place in (lo, hi) that is proven stable and that both encodings have as a boundary; -1: none."""
        p = text.rfind(" ", lo + 1, hi)
        while p > lo:
            if text[p - 1] not in (" ", MARK) and p in left and p in right:
                return p
            p = text.rfind(" ", lo + 1, p)
        return -1

    def spliced(self, text: str) -> int:
        """The tokens of ``text``, of which no more than about two chunks are encoded at once where it can be cut."""
        total, begin, start, end = 0, 0, 0, min(self.chunk, len(text))
        own = self.bounds(text[start:end])
        while end < len(text):
            overlap, least = self.overlap, max(0, begin - 1)  # with what stands before the cut, or the model's own first mark would meet its space
            while True:
                at = max(least, end - overlap)  # the next chunk begins there
                upto = min(len(text), at + max(self.chunk, 2 * overlap))
                following = self.bounds(text[at:upto])
                cut = self._cut(text, at, end, set((own + start).tolist()), set((following + at).tolist()))
                if cut > begin:
                    break
                if at == least:  # all of this chunk overlaps: make it longer
                    own, start, end = following, at, upto
                    if end == len(text):
                        break
                overlap *= 2
            if cut <= begin:
                break
            absolute = own + start
            total += int(((absolute >= begin) & (absolute < cut)).sum())
            begin, own, start, end = cut, following, at, upto
        absolute = own + start
        return total + int((absolute >= begin).sum())

    def count(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk or not self.can_cut else "" for t in texts]
        counts = [len(x) for x in self.lib.encode(short, num_threads=1)]
        return [self.spliced(t) if t and not s else n for t, s, n in zip(texts, short, counts, strict=True)]


_models: dict[str, Counter] = {}


class TokenCounter:
    """A Spark column of counts for one model file, which the driver reads and sends out once (half a MB)."""

    def __init__(self, spark: SparkSession, path: str, chunk: int = 1 << 16, overlap: int = 1 << 9):
        with open(path, "rb") as f:
            data = f.read()
        self.name, self.data, self.sizes = f"{hashlib.sha256(data).hexdigest()} {chunk} {overlap}", spark.sparkContext.broadcast(data), (chunk, overlap)

    def count(self, text: Column) -> Column:
        """bigint; a null text counts as empty, 0. Texts go in small groups, so that memory is bounded by a few texts."""
        name, data, sizes = self.name, self.data, self.sizes

        @F.pandas_udf(LongType())
        def count(texts: pd.Series) -> pd.Series:
            if name not in _models:
                _models[name] = Counter(data.value, *sizes)
            values, out = texts.tolist(), []
            for i in range(0, len(values), 64):
                out += _models[name].count([x or "" for x in values[i : i + 64]])
            return pd.Series(out, dtype="int64")

        return count(text)
