"""Class-based n-gram language model (Brown et al.): exchange clustering, class transitions, word emissions.

Every word of the training texts gets a class by exchange, in three steps that see more and
more of the vocabulary:

1. the most frequent words are moved one at a time, on the grid of their bigrams, until no
   move raises the bigrams' likelihood under classes (``exchange``);
2. the frequent words are moved all at once to the class where each raises that likelihood
   most, by distributed counts of their neighbours' classes; a sweep that does not raise it
   is taken back;
3. so is every other word, by its neighbours among the frequent ones.

Counts and classes of all words stay in a table; what the driver and the broadcasts hold is
the classes' own counts and ``COMMON`` words. Texts are read once, into packs: some MB of
texts as numbers into the pack's own word list. Each pack gets back the counts and classes of
its own words alone, so no task holds the vocabulary; those of the commonest words, which
nearly every pack has, are broadcast and take no part in that join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxmark.llm.common import TEXTS, batches_of, materialize

PACK_BYTES = 8 << 20
ROWS = 10_000  # words that enter or leave a worker at a time
#: Words that are clustered one at a time, words moved next, words whose counts are broadcast.
SEEDS, FREQUENT, COMMON = 510, 8192, 1 << 16
#: Sweeps over the frequent words at most, and the share of all that classes have gained below which a sweep is the last.
SWEEPS, ENOUGH = 5, 0.01
LONGEST = 256  # bytes of a word that may be among those
EQUAL = 1e-6  # gains that differ by less are equal
CLASSES = 48  # class 0 is the text's end
REST = CLASSES  # stands for the class of a neighbour that has none yet
SIDES = CLASSES + 1
ENDINGS = 63  # groups of words by their last bytes; only words unseen in training get their class from these
SMOOTH, TRUST = 0.1, 20.0
WEIGHT = 1 << 16


#: ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def tokens(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of UTF-8 texts, A-Z lower-cased, split at ASCII white space, and how many each text has."""
    raw = np.frombuffer(b" ".join(x.lower() for x in texts), np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stops = np.cumsum([len(x) + 1 for x in texts])
    return _binary(raw[~space], np.concatenate([[0], np.cumsum(ends - starts)])), np.diff(np.searchsorted(starts, stops), prepend=0)


def _names(words: bytes) -> pa.BinaryArray:
    """A pack's words, from their list in one text."""
    if not words:
        return pa.array([], pa.binary())
    raw = np.frombuffer(words, np.uint8)
    cuts = np.flatnonzero(raw == 32)
    return _binary(raw[raw != 32], np.concatenate([[0], cuts - np.arange(len(cuts)), [len(raw) - len(cuts)]]))


class Known:
    """A bounded set of words with a number each."""

    def __init__(self, numbers: dict[bytes, int]):
        self.words, self.numbers = list(numbers), np.array(list(numbers.values()), np.int64)

    def of(self, names: pa.BinaryArray, other: int) -> np.ndarray:
        """The words' numbers; ``other`` for words not in the set."""
        at = pc.index_in(names, value_set=pa.array(self.words, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.append(self.numbers, other)[at]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _planes(x: np.ndarray) -> bytes:
    """uint32 numbers, all lowest bytes first: most higher ones are zeros and compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


PACK = "pack long, words binary, trained binary, tokens binary, lengths binary, ids array<long>, learn array<boolean>, held array<boolean>"


def _packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, n = TaskContext.get().partitionId(), 0
    rows, texts, size = [], [], 0

    def close() -> pd.DataFrame:
        words, lengths = tokens(texts)
        coded = words.dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.uint32)
        ids, learn, held = (list(x) for x in zip(*rows, strict=True))
        counts = np.bincount(numbers[np.repeat(learn, lengths)], minlength=len(coded.dictionary))
        return pd.DataFrame({
            "pack": [part << 32 | n], "words": [b" ".join(coded.dictionary.to_pylist())], "trained": [_planes(counts)], "tokens": [_planes(numbers)],
            "lengths": [_planes(lengths)], "ids": [ids], "learn": [learn], "held": [held],
        })

    for pdf in batches:
        for doc_id, text, learn, held in zip(pdf["id"], pdf["text"], pdf["learn"], pdf["held"], strict=True):
            texts.append(text or b"")
            rows.append((None if pd.isna(doc_id) else int(doc_id), bool(learn), bool(held)))
            size += len(texts[-1])
            if size >= PACK_BYTES or len(rows) >= 100_000:
                yield close()
                n += 1
                rows, texts, size = [], [], 0
    if rows:
        yield close()


def _flow(kinds: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, learn: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The learnt texts' bigrams (kind before, kind), each text between two ends; ``kinds`` are those of the pack's words."""
    flow = np.insert(kinds[numbers] if len(numbers) else np.empty(0, kinds.dtype), np.cumsum(lengths), end)
    before = np.concatenate([[end], flow[:-1]])
    keep = np.repeat(learn, lengths + 1)
    return before[keep].astype(np.int64), flow[keep].astype(np.int64)


def _grid(packs: DataFrame, kinds_of, size: int, end: int) -> np.ndarray:
    """How often each kind follows each, in the learnt texts of all packs: a size x size matrix.
    ``kinds_of`` gives the kinds of a pack's words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size * size, np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b = _flow(kinds_of(row), _numbers(row.tokens), _numbers(row.lengths).astype(np.int64), np.array(row.learn, bool), end)
                seen += np.bincount(a * size + b, minlength=size * size)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"pair": some, "n": seen[some]})

    found = packs.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most size x size rows
    grid = np.zeros(size * size)
    grid[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return grid.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(c: np.ndarray) -> float:
    """Log-likelihood of bigrams under their classes' counts, but for the words' own part, which no move changes."""
    return float(_f(c).sum() - _f(c.sum(0)).sum() - _f(c.sum(1)).sum())


def exchange(counts: np.ndarray, classes: int, fixed: dict[int, int], sweeps: int = 12) -> np.ndarray:
    """Class of each unit: start dealt round, then move one unit at a time to the class where the bigrams' likelihood
    under classes is highest, until a sweep moves none. The units in ``fixed`` keep their classes, which no other unit
    enters; their classes are 0 and such as lie beyond ``classes``."""
    n = len(counts)
    weight = counts.sum(0) + counts.sum(1)
    order = [u for u in np.argsort(-weight, kind="stable") if u not in fixed]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    of[list(fixed)] = list(fixed.values())
    size = max(classes, *(c + 1 for c in fixed.values()))
    members = np.eye(size)[of]
    c = members.T @ counts @ members
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            was, own = of[u], counts[u, u]
            out, into = counts[u] @ members, members.T @ counts[:, u]
            out[was] -= own
            into[was] -= own
            c[was] -= out
            c[:, was] -= into
            c[was, was] -= own
            left, right = c.sum(1), c.sum(0)
            fc = _f(c)
            rows, cols = _f(c + out) - fc, _f(c + into[:, None]) - fc
            diag = _f(np.diag(c) + out + into + own) - np.diag(fc)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + diag
            gain -= _f(left + out.sum() + own) - _f(left) + _f(right + into.sum() + own) - _f(right)
            gain[list(fixed.values())] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9 * abs(gain[was]):
                best = was
            moved += best != was
            of[u] = best
            members[u] = 0
            members[u, best] = 1
            c[best] += out
            c[:, best] += into
            c[best, best] += own
        if not moved:
            break
    return of


class Mover:
    """Finds words' best classes from the counts of their neighbours' classes, all words at once against the same bigrams ``c``
    of classes (SIDES x SIDES, the last for words without a class)."""

    SMALL = 32  # gains of counts below are tabled

    def __init__(self, c: np.ndarray):
        self.c = c
        self.left, self.right = c.sum(1), c.sum(0)
        # Of a code (0 to SIDES-1: class before the word; from SIDES: class after it), what count it adds to, for each class of the word.
        self.cells = np.concatenate([c, c.T])[:, 1:CLASSES]
        self.table = np.stack([_f(self.cells + m) - _f(self.cells) for m in range(self.SMALL)])

    def best(self, word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int, now: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
        """Classes 1 to CLASSES-1 of ``words`` words; (word, code, n) are their neighbours, by word; ``now`` are their
        present classes, REST where they have none. Bigrams of a word with itself count as with its present class. Ties
        go to the present class, else to that of the equal ones which ``turn`` (a number for each word) tells, so that words
        of which nothing is known do not make up one class."""
        out = np.empty(words, np.int64)
        begins = np.searchsorted(word, np.arange(words + 1))
        for lo in range(0, words, 4096):
            hi = min(words, lo + 4096)
            a, b = begins[lo], begins[hi]
            w, k, m = word[a:b] - lo, code[a:b], n[a:b]
            terms = self.table[np.minimum(m, self.SMALL - 1), k]
            if len(big := np.flatnonzero(m >= self.SMALL)):
                terms[big] = _f(self.cells[k[big]] + m[big, None]) - _f(self.cells[k[big]])
            # A word's present class counts without the word: gains there are what leaving it would lose.
            own = now[lo:hi]
            at = np.flatnonzero(own[w] < REST)
            cell = self.cells[k[at], own[w[at]] - 1]
            terms[at, own[w[at]] - 1] = _f(cell) - _f(np.maximum(cell - m[at], 0))
            gain = np.zeros((hi - lo, CLASSES - 1))
            if len(w):
                some, first = np.unique(w, return_index=True)
                gain[some] = np.add.reduceat(terms, first, axis=0)
            for side, whole in ((k < SIDES, self.right), (k >= SIDES, self.left)):
                times = np.bincount(w[side], weights=m[side], minlength=hi - lo)[:, None]
                whole = whole[1:CLASSES]
                add = _f(whole + times) - _f(whole)
                held = np.flatnonzero(own < REST)
                sub = whole[own[held] - 1]
                add[held, own[held] - 1] = _f(sub) - _f(np.maximum(sub - times[held, 0], 0))
                gain -= add
            highest = gain.max(axis=1, keepdims=True)
            equal = gain >= highest - EQUAL
            nth = (turn[lo:hi] if turn is not None else np.zeros(hi - lo, np.int64)) % equal.sum(axis=1)
            top = (equal.cumsum(axis=1) > nth[:, None]).argmax(axis=1)
            stay = np.flatnonzero(own < REST)
            same = equal[stay, own[stay] - 1]
            top[stay[same]] = own[stay[same]] - 1
            out[lo:hi] = top + 1
        return out


def _contexts(packs: DataFrame, sent, gather, only_gathered: bool) -> DataFrame:
    """(word, n, around): of learnt words the count, and the neighbours' classes as bytes in turn (code, times).

    Words in ``gather``, which are in nearly every pack, are added up in each task and leave it once; each pack sends its
    other words, those excepted that ``sent`` knows, or none if ``only_gathered``."""

    def rows(names: pa.BinaryArray, n: np.ndarray, codes: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``codes`` are word number * 2 SIDES + code, ascending; a count over 255 is several entries."""
        parts = -(-times // 255)
        each = np.full(parts.sum(), 255, np.int64)
        each[np.cumsum(parts) - 1] = times - 255 * (parts - 1)
        codes = np.repeat(codes, parts)
        word = codes // (2 * SIDES)
        data = np.stack([codes % (2 * SIDES), each], axis=1).astype(np.uint8).ravel()
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        bounds = np.append(begins, len(word))
        for i in range(0, len(begins), ROWS):
            some, cut = word[begins[i : i + ROWS]], bounds[i : i + ROWS + 1]
            own = _binary(data[2 * cut[0] : 2 * cut[-1]], 2 * (cut - cut[0]))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(n[some].astype(np.int64)), own], ["word", "n", "around"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: Known = gather.value
        n, seen = np.zeros(len(whole.words), np.int64), np.zeros(len(whole.words) * 2 * SIDES, np.int32)
        for batch in batches:
            for row in batch.to_pylist():
                names = _names(row["words"])
                kinds, slots = sent.value.of(names, -1), whole.of(names, -1)
                numbers, lengths, learn = _numbers(row["tokens"]), _numbers(row["lengths"]).astype(np.int64), np.array(row["learn"], bool)
                trained = _numbers(row["trained"])
                wanted = (trained > 0) & (slots >= 0 if only_gathered else (slots >= 0) | (kinds < 0))
                kinds = np.where(kinds < 0, REST, kinds)
                codes, times = around(kinds, numbers, lengths, np.repeat(learn, lengths) & (wanted[numbers] if len(numbers) else np.empty(0, bool)))
                slot = slots[codes // (2 * SIDES)] if len(codes) else codes
                own = slot >= 0
                seen[slot[own] * (2 * SIDES) + codes[own] % (2 * SIDES)] += times[own].astype(np.int32)
                some = np.flatnonzero((slots >= 0) & (trained > 0))
                n[slots[some]] += trained[some]
                yield from rows(names, trained, codes[~own], times[~own])
        some = np.flatnonzero(seen)
        yield from rows(pa.array(whole.words, pa.binary()), n, some, seen[some].astype(np.int64))

    def around(kinds: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before and after the kept tokens: (word number * 2 SIDES + code, times), ascending."""
        flow = np.insert(kinds[numbers].astype(np.uint8) if len(numbers) else np.empty(0, np.uint8), np.cumsum(lengths), 0)
        place = (np.arange(len(numbers)) + np.repeat(np.arange(len(lengths)), lengths))[keep]
        who = numbers[keep].astype(np.uint32 if len(kinds) < 1 << 25 else np.uint64) * (2 * SIDES)
        before = np.where(place > 0, flow[place - 1], 0).astype(np.uint8)
        codes, times = np.unique(np.concatenate([who + before, who + SIDES + flow[place + 1]]), return_counts=True)
        return codes.astype(np.int64), times

    return packs.select("words", "trained", "tokens", "lengths", "learn").mapInArrow(find, "word binary, n long, around binary")


def _placed(contexts: DataFrame, grid: np.ndarray, sent) -> DataFrame:
    """(word, n, cls): each word's class; ``sent`` holds the present ones. Words come sorted, a batch at a time; of a word whose
    rows go on in the next batch a task holds the sums, one number for each code."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mover = Mover(grid)

        def solve(names: pa.BinaryArray, total: np.ndarray, word: np.ndarray, code: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            turn = np.array([zlib.crc32(w) for w in names.to_pylist()], np.int64)
            cls = mover.best(word, code, times, len(names), sent.value.of(names, REST), turn)
            return pa.RecordBatch.from_arrays([names, pa.array(total.astype(np.int64)), pa.array(cls.astype(np.int32))], ["word", "n", "cls"])

        def alone(word: bytes, n: int, sums: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(sums)
            return solve(pa.array([word], pa.binary()), np.array([n]), np.zeros(len(some), np.int64), some, sums[some])

        last: tuple[bytes, int, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            words, around = batch.column("word"), batch.column("around")
            new = np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])
            names, turn = words.filter(pa.array(new)), np.cumsum(new) - 1
            cuts = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1]
            data = around.buffers()[2]
            pairs = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].reshape(-1, 2).astype(np.int64) if data else np.empty((0, 2), np.int64)
            codes, back = np.unique(np.repeat(turn, np.diff(cuts) // 2) * (2 * SIDES) + pairs[:, 0], return_inverse=True)
            times = np.bincount(back, weights=pairs[:, 1], minlength=len(codes)).astype(np.int64)
            total = np.bincount(turn, weights=batch.column("n").to_numpy(), minlength=len(names)).astype(np.int64)
            word, code = codes // (2 * SIDES), codes % (2 * SIDES)
            for i in sorted({0, len(names) - 1}):  # the words that may have rows in the batches beside this one
                sums = np.zeros(2 * SIDES, np.int64)
                sums[code[word == i]] = times[word == i]
                name, n = names[i].as_py(), int(total[i])
                if last and last[0] == name:
                    n, sums = n + last[1], sums + last[2]
                elif last:
                    yield alone(*last)
                last = name, n, sums
            if len(names) > 2:
                inner = (word > 0) & (word < len(names) - 1)
                yield solve(names[1:-1], total[1:-1], word[inner] - 1, code[inner], times[inner])
        if last:
            yield alone(*last)

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(place, "word binary, n long, cls int")


def _top(counts: DataFrame, most: int) -> dict[bytes, tuple]:
    """The ``most`` words of up to LONGEST bytes with the highest counts (all, if fewer), in order, each with the rest of its row.

    Nothing is ranked over all words: of those whose counts share their first binary digits the last that fit
    in are told by a hash, whatever their number, and what is collected beyond ``most`` is cut."""
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("digits", F.floor(8 * F.log2(F.col("n").cast("double"))))
    told = short.groupBy("digits").agg(F.count("*").alias("words")).orderBy(F.desc("digits")).collect()  # 8 x 64 rows at most
    wanted, left = F.lit(True), most
    for r in told:
        if r["words"] > left:  # the last group: as many of it as are missing
            share = min(1.0, (left + 6 * left**0.5 + 32) / r["words"])
            within = F.pmod(F.xxhash64("word"), F.lit(1 << 52)) < int(share * (1 << 52))
            wanted = (F.col("digits") > r["digits"]) | ((F.col("digits") == r["digits"]) & within)
            break
        left -= r["words"]
    rows = short.where(wanted).drop("digits").collect()  # most, and some hundred by chance
    ranked = sorted(rows, key=lambda r: (-r["n"], zlib.crc32(bytes(r["word"])), bytes(r["word"])))[:most]
    return {bytes(w): rest for w, *rest in ranked}


@dataclass
class ClassModel:
    """The model's fixed-size part; the words' counts and classes stay in a table."""

    transitions: np.ndarray  # log10 P(class | class before)
    totals: np.ndarray  # tokens of each class
    kinds: np.ndarray  # different words of each class
    tokens: int
    words: int
    ends: int

    def emission(self, counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class); all unseen words of a class share one part."""
        return np.log10((counts + SMOOTH) / (self.totals[cls] + SMOOTH * (self.kinds[cls] + 1)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.words + 1)))

    def score(self, numbers: np.ndarray, lengths: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> pd.DataFrame:
        """Of each text of a pack, from the counts and classes of the pack's words: n_tokens, n_known, base_score, score
        (log10 probabilities of its words and end)."""
        n = len(lengths)
        doc = np.repeat(np.arange(n), lengths)
        cls = classes[numbers] if len(numbers) else np.empty(0, np.int64)
        first, last = np.cumsum(lengths) - lengths, np.cumsum(lengths) - 1
        some = lengths > 0
        before = np.concatenate([[0], cls[:-1]]) if len(cls) else cls
        before[first[some]] = 0
        c = counts[numbers] if len(numbers) else np.empty(0)
        word_score = (self.transitions[before, cls] + self.emission(counts, classes)[numbers]) if len(numbers) else c
        word_base = self.base(counts)[numbers] if len(numbers) else c
        final = np.zeros(n, np.int64)
        final[some] = cls[last[some]]
        sums = lambda x: np.bincount(doc, weights=x, minlength=n)
        end = np.array([float(self.ends)])
        return pd.DataFrame({"n_tokens": lengths + 1, "n_known": sums(c > 0).astype(np.int64) + int(self.ends > 0), "base_score": sums(word_base) + self.base(end)[0], "score": sums(word_score) + self.transitions[final, 0]})


def fit_and_score(docs: DataFrame, learn: Column, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``learn`` is true, score all: (id, held, n_tokens, n_known, train_tokens, base_score, score).

    Null texts are empty: their one token is the end. A null condition is false. Null and
    repeated ids and repeated rows are scored each for itself; other columns are ignored.
    Without rows to learn from every word is unknown. No rows give none.
    """
    packs = packed(docs, learn, held, id_col, text_col)
    with batches_of(docs.sparkSession, ROWS):
        words = cluster(packs)
        told = _told(packs, words)
        return materialize(_score(told, _model(told, words)), "scores")


def packed(docs: DataFrame, learn: Column, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of packs."""
    no = F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(learn, no).alias("learn"), F.coalesce(held, no).alias("held"))
    return materialize(rows.mapInPandas(_packs, PACK), "packs", TEXTS)


def cluster(packs: DataFrame) -> DataFrame:
    """The table of all words of the packs' learnt texts: (word, n, cls)."""
    spark = packs.sparkSession

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, names = _numbers(row["trained"]), _names(row["words"])
                learnt = np.flatnonzero(n)
                for i in range(0, len(learnt), ROWS):
                    some = learnt[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(n[some].astype(np.int64))], ["word", "n"])

    counts = packs.select("words", "trained").mapInArrow(lists, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = _top(materialize(counts, "counts"), max(COMMON, FREQUENT))
    frequent = list(common)[:FREQUENT]
    seeds = frequent[:SEEDS]
    slim = packs.select("words", "tokens", "lengths", "learn")

    numbers = spark.sparkContext.broadcast(Known({w: i for i, w in enumerate(seeds)}))
    rest, end = len(seeds), len(seeds) + 1
    grid = _grid(slim, lambda row: numbers.value.of(_names(row.words), rest), end + 1, end)
    of = exchange(grid, CLASSES, {end: 0, rest: REST})
    classes = dict(zip(seeds, of.tolist(), strict=False))
    members = np.eye(SIDES)[of]
    c = members.T @ grid @ members

    def bigrams(sent) -> np.ndarray:
        return _grid(slim, lambda row: sent.value.of(_names(row.words), REST), SIDES, 0)

    one = np.eye(2)[[0] + [1] * (SIDES - 1)]
    alone = likelihood(one.T @ c @ one)  # with all words in one class
    gather = spark.sparkContext.broadcast(Known({w: i for i, w in enumerate(frequent)}))
    for _ in range(SWEEPS if len(frequent) > len(seeds) else 0):
        sent = spark.sparkContext.broadcast(Known(classes | {w: REST for w in frequent if w not in classes}))
        moved = {bytes(r["word"]): r["cls"] for r in _placed(_contexts(packs, sent, gather, True), c, sent).collect()}  # FREQUENT rows
        after = bigrams(spark.sparkContext.broadcast(Known(moved)))
        gain = likelihood(after) - likelihood(c)
        if gain <= 0:
            break
        enough = len(classes) == len(frequent) and gain < ENOUGH * abs(likelihood(c) - alone)
        classes, c = moved, after
        if enough:
            break
    sent = spark.sparkContext.broadcast(Known(classes))
    gather = spark.sparkContext.broadcast(Known({w: i for i, w in enumerate(w for w in common if w not in classes)}))
    placed = _placed(_contexts(packs, sent, gather, False), c, sent)
    known = spark.createDataFrame([(bytearray(w), int(common[w][0]), int(k)) for w, k in classes.items()], "word binary, n long, cls int")
    return materialize(placed.union(known), "words")


def _told(packs: DataFrame, words: DataFrame) -> DataFrame:
    """The packs with their words' counts (0: not learnt) and classes in place of the words."""
    spark = packs.sparkSession
    seen = words.groupBy(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).alias("end"), "cls").agg(F.count("*").alias("n")).collect()  # ENDINGS x CLASSES rows at most
    kinds = np.zeros((ENDINGS, CLASSES))
    for r in seen:
        kinds[r["end"], r["cls"]] = r["n"]
    kinds[:, 0] = 0
    general = kinds.sum(0)[1:].argmax() + 1
    unseen = np.where(kinds.any(axis=1), kinds.argmax(axis=1), general).astype(np.int64)
    common = Known({w: n * CLASSES + cls for w, (n, cls) in _top(words, COMMON).items()})
    sent = spark.sparkContext.broadcast((common, unseen))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = _names(row["words"])
                rare = np.flatnonzero(sent.value[0].of(names, -1) < 0)
                for i in range(0, len(rare), ROWS):
                    at = rare[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["pack"])), pa.array(at.astype(np.int32)), names.take(pa.array(at))], ["pack", "at", "word"])

    wanted = packs.select("pack", "words").mapInArrow(asked, "pack long, at int, word binary")
    answers = wanted.join(words, "word").select("pack", "at", (F.col("n") * CLASSES + F.col("cls")).alias("said"))

    def fill(pack: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        known, endings = sent.value
        out = []
        for row in pack.itertuples():
            names = _names(row.words)
            told = known.of(names, -1)
            told[found["at"].to_numpy()] = found["said"].to_numpy(np.int64)
            n, cls = np.maximum(told, 0) // CLASSES, told % CLASSES
            new = np.flatnonzero(told < 0)
            cls[new] = [endings[ending(w)] for w in names.take(pa.array(new)).to_pylist()]
            out.append({"counts": n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "classes": cls.astype(np.uint8).tobytes(), "tokens": row.tokens, "lengths": row.lengths, "ids": row.ids, "learn": row.learn, "held": row.held})
        return pd.DataFrame(out, columns=["counts", "classes", "tokens", "lengths", "ids", "learn", "held"])

    kept = packs.select("pack", "words", "tokens", "lengths", "ids", "learn", "held")
    both = kept.groupBy("pack").cogroup(answers.groupBy("pack"))
    return materialize(both.applyInPandas(fill, "counts binary, classes binary, tokens binary, lengths binary, ids array<long>, learn array<boolean>, held array<boolean>"), "told")


def _longs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _transitions(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each class follows each in the learnt texts, and the part of it that teaches: a word seen n times has chosen
    its class by each of its places to 1/n, so a bigram counts less by that share of its rarer word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, taught = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(CLASSES * CLASSES)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lengths, learn, numbers = _numbers(row.lengths).astype(np.int64), np.array(row.learn, bool), _numbers(row.tokens)
                a, b = _flow(np.frombuffer(row.classes, np.uint8).astype(np.int64), numbers, lengths, learn, 0)
                share = (WEIGHT - WEIGHT // np.maximum(_longs(row.counts), 1)).astype(np.int64)
                own = np.minimum(*_flow(share, numbers, lengths, learn, WEIGHT))
                seen += np.bincount(a * CLASSES + b, minlength=CLASSES * CLASSES)
                taught += np.bincount(a * CLASSES + b, weights=own, minlength=CLASSES * CLASSES)  # whole numbers far below 2**53
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"pair": some, "n": seen[some], "taught": taught[some].astype(np.int64)})

    found = told.select("classes", "counts", "tokens", "lengths", "learn").mapInPandas(count, "pair long, n long, taught long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("taught").alias("taught")).toPandas()
    out = np.zeros((2, CLASSES * CLASSES))
    out[:, found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float), found["taught"].to_numpy(float) / WEIGHT
    return out[0].reshape(CLASSES, CLASSES), out[1].reshape(CLASSES, CLASSES)


def _model(told: DataFrame, words: DataFrame) -> ClassModel:
    c, taught = _transitions(told)
    kinds, whole = np.zeros(CLASSES), 0
    for r in words.groupBy("cls").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
        kinds[r["cls"]] = r["words"]
        whole += r["n"]
    ends = int(c[:, 0].sum())
    kinds[0] += ends > 0
    totals = c.sum(0)
    prior = (totals + 1) / (totals.sum() + CLASSES)
    loose = (c - taught).sum(1, keepdims=True) + TRUST  # goes to the classes as they are without a class before them
    transitions = np.log10((taught + loose * prior) / (c.sum(1, keepdims=True) + TRUST))
    return ClassModel(transitions, totals, kinds, whole + ends, int(kinds.sum()), ends)


def _score(told: DataFrame, model: ClassModel) -> DataFrame:
    sent = told.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                scores = sent.value.score(_numbers(row.tokens), _numbers(row.lengths).astype(np.int64), _longs(row.counts).astype(float), np.frombuffer(row.classes, np.uint8).astype(np.int64))
                yield scores.assign(id=pd.array(list(row.ids), "Int64"), held=np.array(row.held, bool), train_tokens=sent.value.tokens)

    return told.mapInPandas(judge, "id long, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
