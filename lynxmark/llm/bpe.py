"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SHIFT = 20
#: What a worker remembers of chunks between white space and their pre-tokens: two generations of so many.
CACHED, CACHED_CHARS = 200_000, 48
#: Unicode's white space; str.split() also splits at the four separators 1C to 1F.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case, a character at a time: no form depends on its neighbours."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class BPE:
    """An encoder and decoder for a tokenizer file with byte-level symbols and word-end marks."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["post_processor"] or spec["decoder"]:
            raise ValueError("a tokenizer of another kind")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a] << SHIFT | vocab[b]] = rank << SHIFT | vocab[a + b]
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"^\s", f"^{SPACE}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.known = _Known(self._chunk)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, until no rule applies."""
        n, rule = len(symbols), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m >> SHIFT) << 32 | i for i in range(n - 1) if (m := rule(symbols[i] << SHIFT | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if symbols[i] < 0 or (j := after[i]) >= n:
                continue
            m = rule(symbols[i] << SHIFT | symbols[j])
            if m is None or m >> SHIFT != rank:  # stale: one of the two has been merged since
                continue
            symbols[i], symbols[j] = m & ((1 << SHIFT) - 1), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := rule(symbols[i] << SHIFT | symbols[k])) is not None:
                    heapq.heappush(queue, (m >> SHIFT) << 32 | i)
            if (h := before[i]) >= 0 and (m := rule(symbols[h] << SHIFT | symbols[i])) is not None:
                heapq.heappush(queue, (m >> SHIFT) << 32 | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return np.array(self.merge(symbols), np.int32).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        parts = self.words.findall(lower(unicodedata.normalize("NFC", chunk)))
        if len(parts) == 1 and parts[0] == chunk:  # a single pre-token as it stands
            return self._piece(chunk)
        return b"".join([self.known[x] for x in parts])

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids (int32). Null is taken as empty; special strings in the text become their ids."""
        if not text:
            return np.empty(0, np.int32)
        out = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32).tobytes())
                continue
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            out += map(self.known.__getitem__, filter(None, self.spaces.split(part)) if odd else part.split())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray | None) -> str:
        """The vocabulary strings, one space between them, as a tokenizer file without a decoder asks; unknown ids are left out."""
        if ids is None or not len(ids):
            return ""
        known = self.strings
        try:
            return " ".join(map(known.__getitem__, ids.tolist()))
        except KeyError:
            return " ".join(known[i] for i in ids.tolist() if i in known)


class _Known(dict):
    """Results by argument. When a generation is full it grows old, and what is not asked for again goes with it."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.old.get(key)) is None:
            out = self.compute(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


_models: dict[str, BPE] = {}


class Codec:
    """Spark columns for one tokenizer file, which the driver reads and sends out once (a few MB, however large the corpus)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.name, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def encode(self, text: Column) -> Column:
        """array<int> of token ids; null and empty texts give an empty array."""
        name, data = self.name, self.data

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(texts: pd.Series) -> pd.Series:
            model = load(name, data)
            return pd.Series([model.encode(x) for x in texts], dtype=object)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """The decoded string; null and empty arrays give an empty one."""
        name, data = self.name, self.data

        @F.pandas_udf(StringType())
        def decode(rows: pd.Series) -> pd.Series:
            model = load(name, data)
            return pd.Series([model.decode(x) for x in rows], dtype=object)

        # With a JVM expression between them, ids that come from encode() are not computed a second time for this.
        return decode(F.coalesce(ids, F.array().cast("array<int>")))

    def round_trip(self, text: Column) -> Column:
        """struct<ids array<int>, decoded string>: what encode() gives and what decode() makes of it, in one worker."""
        name, data = self.name, self.data
        kind = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

        @F.pandas_udf(kind)
        def both(texts: pd.Series) -> pd.DataFrame:
            model = load(name, data)
            ids = [model.encode(x) for x in texts]
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(map(model.decode, ids), dtype=object)})

        return both(text)


def load(name: str, data) -> BPE:
    """A worker's model, kept from task to task."""
    if name not in _models:
        _models[name] = BPE(data.value)
    return _models[name]
