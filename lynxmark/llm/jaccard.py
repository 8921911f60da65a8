"""Similarity join of texts by their shingle sets: parity sketches, pigeonhole, exact counts.

Every shingle flips bits of sketches, so that what two sets share cancels out:

* a wide sketch, cut into blocks: a block holds the parity of the shingles dealt to it, told
  by the exclusive or of their hashes. A shingle that only one set has changes one block, so
  two sets that differ in d shingles differ in d blocks at most and agree in all others. The
  number of blocks goes by bands of set sizes, a set at a band's upper end is in the next too;
* a narrow one of 1,024 bits or, for larger sets, of as many as shingles, one bit a shingle,
  whose Hamming distance is never more than the number of shingles in which two sets differ.

Sets of likeness 0.8 and size n differ in n // 4 shingles at most. All blocks have an order in
which those come last that are empty or common in the corpus; of two sets that link, the
first n // 4 + 1 blocks of each have one in common. Only these are dealt out. Sets that meet
in a block are compared by their narrow sketches where they meet, and what these cannot tell
apart makes up the groups in which whole sets are compared, each shipped once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxmark.llm.common import TEXTS, connected_components, materialize

WORDS = 16  # of 64 bits in a narrow sketch at least
BAND = 4  # a band's largest set is so many times its smallest
#: A block's value is common if this share of a task's sets has it, and then of all sets.
COMMON = 0.002
#: Sets, and bytes of hashes, that meet in one task; values of a task after which further sets with a value are dealt over SALTS.
CROWD, CROWD_BYTES, REPEATS, SALTS = 8192, 48 << 20, 64, 64
COUNTERS = 1 << 22
SEEN = 1 << 18  # sets that a task remembers to have dealt out
ROWS = 5_000  # texts or dealt rows that enter a worker at a time


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def key_of(name: str) -> int:
    return xxhash.xxh64_intdigest(name, 42)


COLUMNS = ["id", "h", "bytes", "node", "size", "sketch", "common", "n"]
BIT, BLOCK, VALUE = (key_of(x) for x in ("bit", "block", "value"))
BASE = key_of("base") | 1
LETTERS = np.array([key_of(f"byte {i}") for i in range(256)], np.uint64)
PART = 1 << 20  # bytes of a text that are hashed at a time, and a shingle more
_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the 0 .. n-1 and their inverses, modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        each = np.full((2, n), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
        each[:, 0] = 1
        _powers = np.cumprod(each, axis=1, dtype=np.uint64)
    return _powers


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """Hashes of the different shingles of a UTF-8 text, ascending: sums of the bytes' numbers times powers, from running sums."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    raw = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    many = max(1, len(words) - width + 1)
    starts, ends = np.concatenate([[0], gaps + 1])[:many], np.concatenate([gaps, [len(raw)]])[-many:]
    out, i = [], 0
    while i < many:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PART)))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = powers(high - low + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[raw[low:high]] * up[: high - low], dtype=np.uint64)])
        a, b = starts[i:j] - low, ends[i:j] - low
        out.append(mixed((sums[b] - sums[a]) * down[a], BASE))
        i = j
    return different(np.concatenate(out))


def different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def digest(own: np.ndarray) -> int:
    """A set's 64-bit name."""
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def width_of(size: int) -> int:
    """Words of 64 bits in the narrow sketch of a set: as many bits as shingles, or more, so that sets without much in common
    differ in more bits than those that link may."""
    return max(WORDS, 1 << max(0, (size - 1).bit_length() - 6))


def narrow(hashes: np.ndarray) -> np.ndarray:
    """The narrow sketch of a set of hashes: each flips one bit."""
    bits = 64 * width_of(len(hashes))
    flips = np.bincount((mixed(hashes, BIT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """The narrow sketches of some sets. The lower half of a sketch, flipped by its upper half, is the sketch of half the width:
    sets of sizes that may link are compared at the lesser of their widths, of which one is at most twice the other."""

    def __init__(self, sketches: list[np.ndarray]):
        self.width = np.array([len(x) for x in sketches], np.int64)
        self.at, self.rows = {}, {}
        for w in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            at = np.full(len(sketches), -1, np.int64)
            at[np.concatenate([own, wider])] = np.arange(len(own) + len(wider))
            folded = [sketches[i][:w] ^ sketches[i][w:] for i in wider.tolist()]
            self.at[w], self.rows[w] = at, np.stack([sketches[i] for i in own.tolist()] + folded)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sets a[i] and b[i] differ; their widths are equal or one is twice the other."""
        out, lesser = np.empty(len(a), np.int64), np.minimum(self.width[a], self.width[b])
        for w in np.unique(lesser).tolist():
            some = np.flatnonzero(lesser == w)
            for k in range(0, len(some), step := max(1, (1 << 21) // w)):
                part = some[k : k + step]
                out[part] = np.bitwise_count(self.rows[w][self.at[w][a[part]]] ^ self.rows[w][self.at[w][b[part]]]).sum(axis=1, dtype=np.int64)
        return out


def most_different(size: int, percent: int) -> int:
    """In how many shingles a set of that size and any that it links with differ at most."""
    return (100 - percent) * size // percent


def bands(size: int, percent: int) -> list[int]:
    """The smallest sizes of the bands in which a set of that size is dealt out; none if no other set can link with it."""
    if not most_different(size, percent):
        return []
    low = 1
    while low * BAND <= size:
        low *= BAND
    return [low, low * BAND] if 100 * size >= percent * low * BAND else [low]


def blocks(hashes: np.ndarray, low: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A band's blocks of a set that are not empty: numbers and keys (which hold band, number and value); and how many blocks there are."""
    many = max(16, 2 * most_different(BAND * low, percent))
    at = (mixed(hashes, BLOCK ^ low) % np.uint64(many)).astype(np.int64)
    value = np.zeros(many, np.uint64)
    np.bitwise_xor.at(value, at, mixed(hashes, VALUE))
    held = np.flatnonzero(np.bincount(at, minlength=many))
    return held, _keys(held, value[held], low), many


def _keys(at: np.ndarray, value: np.ndarray, low: int) -> np.ndarray:
    return mixed(value ^ mixed(at.astype(np.uint64), low), BLOCK)


def first_blocks(hashes: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The keys by which a set is dealt out; ``common`` is ascending."""
    out, wanted = [], most_different(len(hashes), percent) + 1
    for low in bands(len(hashes), percent):
        at, keys, many = blocks(hashes, low, percent)
        late = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys if len(common) else np.zeros(len(keys), bool)
        keys = np.concatenate([np.sort(keys[~late]), np.sort(keys[late])])[:wanted]
        if len(keys) < wanted:  # empty blocks come last, in the order of their keys as well
            empty = np.setdiff1d(np.arange(many), at)
            keys = np.concatenate([keys, np.sort(_keys(empty, np.zeros(len(empty), np.uint64), low))[: wanted - len(keys)]])
        out.append(keys)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def near(sizes: np.ndarray, i: int, some: np.ndarray, sketches: Sketches, percent: int) -> np.ndarray:
    """Those of ``some`` whose sizes and sketches do not rule out a link with ``i``, nearest first."""
    a, b = sizes[i], sizes[some]
    some = some[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
    far = sketches.differ(np.full(len(some), i), some)
    fit = far * (100 + percent) <= (a + sizes[some]) * (100 - percent)
    return some[fit][np.argsort(far[fit], kind="stable")]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def joined(sizes: np.ndarray, sketches: Sketches, percent: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """For each of some sets the first one that it hangs together with: by what the sketches cannot tell apart, or by links
    between whole ``sets``. Pairs that hang together already are not compared."""
    part = np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        after = np.arange(i + 1, len(sizes))
        some = near(sizes, i, after[part[after] != part[i]], sketches, percent)
        for j in some.tolist():
            if part[i] != part[j] and (sets is None or linked(sets[i], sets[j], percent)):
                low, high = sorted((part[i], part[j]))
                part[part == high] = low
    return part


SMALL = 24  # sets of a group whose pairs are compared all at once, with those of other groups


def small_groups(bounds: np.ndarray, sizes: np.ndarray, sketches: Sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one group, of those of 2 to SMALL sets, that sizes and sketches do not rule out; ``bounds`` are the groups' ends."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    many = np.diff(bounds)
    for m in range(2, SMALL + 1):
        begins = bounds[:-1][many == m]
        i, j = np.triu_indices(m, 1)
        for k in range(0, len(begins), max(1, 200_000 // len(i))):
            some = begins[k : k + max(1, 200_000 // len(i))][:, None]
            a, b = (some + i).ravel(), (some + j).ravel()
            fit = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
            a, b = a[fit], b[fit]
            far = sketches.differ(a, b)
            fit = far * (100 + percent) <= (sizes[a] + sizes[b]) * (100 - percent)
            left.append(a[fit])
            right.append(b[fit])
    return np.concatenate(left), np.concatenate(right)


def _per_group(percent: int, whole: bool):
    """Links (a, b) that join what hangs together among the rows of each ``task``, which come in order."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, sizes = (pdf[c].to_numpy(np.int64) for c in ("task", "node", "size"))
        sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]] if whole else None
        sketches = [narrow(x) for x in sets] if whole else [np.frombuffer(x, np.uint64) for x in pdf["sketch"]]
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        root = list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*(x.tolist() for x in small_groups(bounds, sizes, Sketches(sketches), percent)), strict=True):
            x, y = find(i), find(j)
            if x != y and (not whole or linked(sets[i], sets[j], percent)):
                root[max(x, y)] = min(x, y)
        tops = np.array([find(i) for i in range(len(nodes))])
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i > SMALL:
                tops[i:j] = i + joined(sizes[i:j], Sketches(sketches[i:j]), percent, sets[i:j] if whole else None)
        moved = np.flatnonzero(tops != np.arange(len(tops)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[tops[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        for pdf in batches:
            keys = pdf["task"].to_numpy(np.int64)
            if not len(keys):
                continue
            cut = int((keys == keys[-1]).argmax())
            if held and (cut or keys[0] != held[-1]["task"].iloc[-1]):
                yield links(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            elif cut:
                yield links(pdf.iloc[:cut])
            held.append(pdf.iloc[cut:])
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return run


def _tasks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (node, size) with a ``task`` for each group of a ``key``, or, where a group is crowded, for every two of its blocks."""
    fill = F.greatest(F.count("*") / CROWD, F.sum("size") * 8 / CROWD_BYTES)
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.when(fill <= 1, 1).otherwise(F.ceil(2 * fill)).cast("int").alias("blocks")).where("n > 1").drop("n")
    told = rows.join(groups, key).withColumn("block", F.pmod(F.xxhash64("node", key), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.when(i != F.col("block"), F.xxhash64(key, F.least(i, "block"), F.greatest(i, "block"))))
    tasks = F.when(F.col("blocks") > 1, F.array_compact(pairs)).otherwise(F.array(F.xxhash64(key)))
    return told.withColumn("task", F.explode(tasks)).drop("blocks", "block")


class Join:
    """Texts whose sets of different ``width``-word shingles link: 100 * |A and B| >= ``percent`` * |A or B|.

    A-Z are lower-cased and words split at ASCII white space; a text of fewer words is one
    shingle; null texts and texts without words have the empty set and link with nothing, not
    even with each other. Equal sets are one node from the start, so copies never meet in a
    task; no link between different sets is lost (``percent`` is 67 or more). Null ids keep their rows and are no component's id unless all its ids are
    null; repeated rows and ids count each for themselves; other columns are ignored; no rows
    give none. Shingles, sets and texts are told apart by 64-bit hashes. A text must fit into a task.

    A block's value that a share of COMMON of the sets has goes to the end of the order, by
    counts over all texts; the driver and the tasks hold these values, some 300,000 at
    most for texts of 500 words. Groups of over CROWD sets are cut into blocks, of which every two meet in a task.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80):
        if not 67 <= percent <= 100:
            raise ValueError("percent must be 67 to 100")
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        text = F.col(text_col).cast("binary")
        self.texts = docs.select(text.alias("text"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("bytes")).where("bytes > 0")
        self.rows = self._features(docs.select(F.col(id_col).alias("id"), text.alias("text")))
        # A row for each set that may link with another.
        alone = F.col("size") * (100 - percent) < percent
        nodes = self.rows.where(~alone).groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min(F.struct("h", "bytes")).alias("text"))
        self.nodes = materialize(nodes, "nodes")

    def _features(self, docs: DataFrame) -> DataFrame:
        """(id, h, bytes, node, size, sketch) for each row; and sets ``common``."""
        width, percent = self.width, self.percent

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, many, often = np.zeros(COUNTERS, np.uint32), 0, {}
            for pdf in batches:
                out = []
                for doc_id, data, h, size in zip(pdf["id"], pdf["text"], pdf["h"], pdf["bytes"], strict=True):
                    own = shingle_set(data, width)
                    node = np.uint64(digest(own)).view(np.int64) if len(own) else None
                    out.append((doc_id, h, size, node, len(own), narrow(own).tobytes(), None, None))
                    for low in bands(len(own), percent):
                        many += 1
                        keys = blocks(own, low, percent)[1]
                        at = (keys % np.uint64(COUNTERS)).astype(np.int64)
                        counts[at] += np.uint32(1)
                        for key in keys[counts[at] >= max(16, COMMON * many)].tolist():
                            often[key] = often.get(key, 15) + 1
                least = max(16, COMMON * many) / 2
                if len(often) > 1 << 16:
                    often = {k: n for k, n in often.items() if n >= least}
                yield pd.DataFrame(out, columns=COLUMNS, dtype=object)
            kept = [(None, None, None, None, None, None, np.uint64(k).view(np.int64), n) for k, n in often.items() if n >= COMMON * many / 2]
            yield pd.DataFrame([*kept, (None, None, None, None, None, None, None, many)], columns=COLUMNS, dtype=object)

        own = docs.select(F.col("id").cast("string").alias("id"), "text", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
        found = own.mapInPandas(find, "id string, h long, bytes int, node long, size int, sketch binary, common long, n long")
        found = materialize(found.withColumn("id", F.col("id").cast(docs.schema["id"].dataType)), "sets", TEXTS)
        many = found.where("size IS NULL AND common IS NULL").agg(F.sum("n")).first()[0] or 0
        often = found.where("common IS NOT NULL").groupBy("common").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON / 2 * many)
        self.common = np.sort(np.array([r.common for r in often.select("common").collect()], np.int64).view(np.uint64))
        return found.where("size IS NOT NULL").drop("common", "n")

    def _meetings(self) -> DataFrame:
        """(key, node): the sets that have a first block in common with another."""
        width, percent = self.width, self.percent
        common = self.spark.sparkContext.broadcast(self.common)

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, counts = set(), np.zeros(COUNTERS, np.uint16)
            for pdf in batches:
                keys, nodes, salts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
                for data in pdf["text"]:
                    own = shingle_set(data, width)
                    node = int(np.uint64(digest(own)).view(np.int64))
                    if node in seen:  # a copy
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    first = first_blocks(own, percent, common.value)
                    at = (first % np.uint64(COUNTERS)).astype(np.int64)
                    often = counts[at] >= REPEATS
                    counts[at[~often]] += np.uint16(1)
                    keys.append(first)
                    nodes.append(np.full(len(first), node))
                    salts.append(np.where(often, 1 + (node % SALTS), 0).astype(np.int32))
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "salt": np.concatenate(salts), "node": np.concatenate(nodes)})

        def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = np.empty((0, 3), np.int64)  # the last row, and whether it was in company
            company = False
            for pdf in batches:
                x = np.concatenate([last, np.column_stack([pdf[c].to_numpy(np.int64) for c in ("key", "salt", "node")])])
                x = x[np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])] if len(x) else x
                if not len(x):
                    continue
                same = (x[1:, :2] == x[:-1, :2]).all(axis=1)
                keep = np.concatenate([[company], same]) | np.concatenate([same, [False]]) | (x[:, 1] > 0)
                yield pd.DataFrame({"key": x[:-1, 0][keep[:-1]], "node": x[:-1, 2][keep[:-1]]})
                last, company = x[-1:], bool(keep[-1])
            if company:
                yield pd.DataFrame({"key": last[:, 0], "node": last[:, 2]})

        rows = self.texts.select("text").mapInPandas(dealt, "key long, salt int, node long")
        return materialize(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInPandas(shared, "key long, node long"), "meetings", ROWS).distinct()

    def _likely(self, meetings: DataFrame) -> DataFrame:
        """Links (a, b) that hold together what meets and cannot be told apart by narrow sketches."""
        sized = meetings.join(self.nodes.select("node", "size"), "node")
        dealt = _tasks(sized.select("key", "node", (F.greatest(F.lit(512.0), F.col("size")) / 16).alias("size")), "key").select("task", "node")
        rows = dealt.join(self.nodes.select("node", "size", "sketch"), "node").select("task", "node", "size", "sketch")
        return rows.repartition("task").sortWithinPartitions("task", "size", "node").mapInPandas(_per_group(self.percent, False), "a long, b long")

    def groups(self) -> DataFrame:
        """(node, root): the nodes that may be linked, by groups that no link leaves; nodes alone have no row."""
        meetings = materialize(self._meetings(), "meetings")
        ends = meetings.groupBy("node").agg(F.array_distinct(F.array(F.min("key"), F.max("key"))).alias("keys"))
        links = materialize(self._likely(ends.select(F.explode("keys").alias("key"), "node")), "likely")
        roots = connected_components(links)
        # Only values whose sets do not hang together yet can join more.
        told = meetings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        more = self._likely(meetings.join(apart, "key", "left_semi"))
        roots = connected_components(links.union(more))
        return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

    def links(self) -> DataFrame:
        """Links (a, b) between nodes that join all nodes that links join."""
        width = self.width
        member = materialize(self.groups().join(self.nodes.select("node", "size", "text"), "node"), "members")
        dealt = _tasks(member.select("node", "root", "size"), "root").groupBy("node").agg(F.collect_list("task").alias("tasks"))
        wanted = member.select("node", F.col("text.h").alias("h"), F.col("text.bytes").alias("bytes")).join(dealt, "node")
        sets = F.pandas_udf(lambda texts: pd.Series([shingle_set(x, width).tobytes() for x in texts]), "binary")
        texts = self.texts.dropDuplicates(["h", "bytes"]).join(wanted, ["h", "bytes"]).select("node", "tasks", sets("text").alias("hashes"))
        rows = texts.select(F.explode("tasks").alias("task"), "node", (F.octet_length("hashes") / 8).cast("int").alias("size"), "hashes")
        return rows.repartition("task").sortWithinPartitions("task", "size", "node").mapInPandas(_per_group(self.percent, True), "a long, b long")

    def components(self) -> DataFrame:
        """Every row: (id, size, component_id), the smallest id that links reach, its own included."""
        roots = connected_components(self.links(), batch=TEXTS)
        least = self.rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"))
        placed = materialize(least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "placed")
        found = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
        told = self.rows.join(found, "node", "left")
        return told.select("id", F.col("size").cast("long").alias("size"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


#: What ``Join(documents).components()`` returns, in DuckDB's SQL: all pairs with a shingle in common, and all that links reach.
SQL = r"""
    WITH RECURSIVE split AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    shingles AS MATERIALIZED (SELECT DISTINCT uid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM split),
    sets AS (SELECT uid, count(*) AS n FROM shingles GROUP BY uid),
    pairs AS (SELECT a.uid AS a, b.uid AS b, count(*) AS c FROM shingles a JOIN shingles b USING (shingle) WHERE a.uid <> b.uid GROUP BY a.uid, b.uid),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sets x ON x.uid = a JOIN sets y ON y.uid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach AS (SELECT uid, uid AS other FROM split UNION SELECT reach.uid, links.b FROM reach JOIN links ON reach.other = links.a)
    SELECT s.doc_id, coalesce(sets.n, 0) AS n_shingles, (SELECT min(o.doc_id) FROM reach JOIN split o ON o.uid = reach.other WHERE reach.uid = s.uid) AS component_id
    FROM split s LEFT JOIN sets ON sets.uid = s.uid"""
