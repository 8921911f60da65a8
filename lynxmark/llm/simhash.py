"""SimHash fingerprints and their links, found with BK-trees over shards of the fingerprints.

A shard holds the fingerprints that agree in six of their eight bytes, so it has at most
2**16 different ones however large the corpus is. Two fingerprints at Hamming distance 2
or less differ in at most two bytes and so meet in at least one of the 28 shards that each
belongs to. Each shard's tree is built and searched in the task that its rows are dealt to:
sending every tree to every executor would broadcast the corpus's fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lynxmark.llm.common import TEXTS, connected_components, fresh, materialize, with_uid

BYTES, KEPT = 8, 6
#: Of each kind of shard, the bits on which its fingerprints agree.
MASKS = [sum(0xFF << (8 * i) for i in kept) for kept in combinations(range(BYTES), KEPT)]
MAX_RADIUS = BYTES - KEPT


def shingle_hashes(data: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a UTF-8 text, as simhash() takes them."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(text, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(text)]
    return np.array([digest(text[i:j], 42) for i, j in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def simhash(data: bytes | None, width: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text.

    A-Z are lower-cased, words split at ASCII white space, ``width``-word shingles (repeats
    included) joined by one space and hashed with XXH64, seed 42. A shorter text is one
    shingle; a null text or one without words has fingerprint 0. A bit is 1 if it is set in
    over half of the hashes.
    """
    return majority(shingle_hashes(data, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without hashes."""
    if len(hashes) < 2:
        return int(hashes.sum())
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed bigint."""

    @F.pandas_udf(LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(x, width) for x in texts], np.uint64).view(np.int64))

    return fingerprint(text.cast("binary"))


class BKTree:
    """Burkhard-Keller tree over 64-bit integers: a child hangs on the edge of its Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values, self.children = values, [{} for _ in values]
        for i in range(1, len(values)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        at, x = 0, self.values[i]
        while (child := self.children[at].get(d := (x ^ self.values[at]).bit_count())) is not None:
            at = child
        self.children[at][d] = i

    def within(self, x: int, radius: int) -> list[int]:
        """Indexes of the values at most ``radius`` from ``x``; only edges within the radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (x ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, within the radius: all values descend the tree together, thinned out at every edge."""
        values = np.array(self.values, np.uint64)
        left, right, todo = [], [], [(0, np.arange(len(values)))] if self.values else []
        while todo:
            at, who = todo.pop()
            d = np.bitwise_count(values[who] ^ values[at])
            near = who[(d <= radius) & (who > at)]
            left.append(np.full(len(near), at))
            right.append(near)
            for edge, child in self.children[at].items():
                if len(some := who[(d >= edge - radius) & (d <= edge + radius)]):
                    todo.append((child, some))
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def shard_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one shard's links: each value points to the smallest of its component."""
    tree = BKTree(values.tolist())
    if len(values) <= 48:
        pairs = [(i, j) for i, x in enumerate(tree.values) for j in tree.within(x, radius) if i < j]
    else:
        pairs = zip(*(x.tolist() for x in tree.links(radius)), strict=True)
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    tops = np.array([find(i) for i in range(len(values))])
    moved = np.flatnonzero(tops != np.arange(len(values)))
    return values[moved], values[tops[moved]]


def _search(radius: int):
    masks = np.array(MASKS, np.uint64)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def solve(bounds: np.ndarray) -> pd.DataFrame:
            out = [shard_links(values[i:j], radius) for i, j in zip(bounds[:-1], bounds[1:], strict=True) if j - i > 1]
            a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
            return pd.DataFrame({"a": a, "b": b})

        for pdf in batches:
            kinds = np.concatenate([kinds, pdf["kind"].to_numpy(np.int64)])
            values = np.concatenate([values, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
            shared = values & masks[kinds]
            starts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (shared[1:] != shared[:-1])) + 1
            if len(starts):
                yield solve(np.concatenate([[0], starts]))
                kinds, values = kinds[starts[-1] :], values[starts[-1] :]
        if len(values) > 1:
            yield solve(np.array([0, len(values)]))

    return search


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the different bigint fingerprints in column ``fp``, within ``radius`` bits.

    Not all pairs are emitted, but every two fingerprints that a chain of links joins stay
    joined. Nulls have no links. ``radius`` is at most 2, which the shards prove complete.
    """
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must be 0 to {MAX_RADIUS}")
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    shards = fps.where("fp IS NOT NULL").select("fp", F.explode(F.array([F.struct(F.lit(i).cast("int").alias("kind"), F.lit(m).cast("bigint").alias("mask")) for i, m in enumerate(signed)])).alias("s"))
    key = F.col("fp").bitwiseAND(F.col("s.mask"))
    dealt = shards.select("fp", F.col("s.kind").alias("kind"), key.alias("shared")).repartition("kind", "shared").sortWithinPartitions("kind", "shared", "fp")
    return dealt.select("kind", "fp").mapInPandas(_search(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: (``id_col``, simhash bigint, component_id).

    component_id is the smallest id that links within ``radius`` bits reach, the row's own
    included. Null and wordless texts have fingerprint 0 and link like any other; null ids
    keep their rows and are no component's id unless all its ids are null; repeated rows and
    ids stay as they are; other columns are ignored, whatever their names; no rows give none.
    """
    own = docs.select(F.col(id_col).alias("id"), simhash_column(F.col(text_col), width).alias("fp"))
    own = materialize(own, "simhash", TEXTS)
    fps = own.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(fingerprint_links(fps.select("fp"), radius))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = placed.join(least, "root").select("fp", "component_id")
    return own.join(found, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("simhash"), "component_id")


#: Similar texts are sought in shards of texts that share a smallest shingle hash under one of so many orders: two
#: texts of likeness 0.8 share at least one of them in all but 0.2 ** ORDERS of the cases.
ORDERS, SKETCH, CROWD = 6, 128, 10_000
#: Bits in which fingerprints of sets of likeness 0.8 may differ. A bit differs with probability 0.1875 at most (a set of
#: four in one of five; 0.159 from 20 shingles on), so more do in 1.3e-5 of such pairs at most (5e-7 from 20 shingles on).
RADIUS = 26
#: Bytes of shingle hashes beyond which a group is crowded too.
CROWD_BYTES = 48 << 20
#: Words of a wide fingerprint, and the bits in which those of likeness 0.8 may differ: 48 are expected at most, with a standard
#: deviation of 6.2, so more do in one of three million pairs; of sets without much in common 128 differ.
WIDE, WIDE_RADIUS = 4, 79
#: A shard's sets have sizes of at most so many times its smallest, so that two of likeness 0.8 lie in one band or in neighbours.
BAND = 1.25
#: Texts of groups up to which their list (some 50 bytes each) is sent to every task; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pairs whose sketches show less than the wanted likeness by so much are not compared hash by hash. A sketch's error at
#: likeness 0.8 has a standard deviation of 0.035: the binomial chance to lose such a pair is below 1e-7.
MARGIN = 0.2
#: An order's key by rule: hashes of its number, so that no key is a simple multiple of another.
ORDER_KEYS = np.array([xxhash.xxh64_intdigest(f"order {i}", 42) for i in range(ORDERS)], np.uint64)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest of a set of hashes in each order; zeros for the empty set."""
    if not len(hashes):
        return np.zeros(ORDERS, np.uint64)
    out = np.empty(ORDERS, np.uint64)
    with np.errstate(over="ignore"):
        for i, key in enumerate(ORDER_KEYS):
            x = hashes ^ key
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out[i] = x.min()
    return out


def wide(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of 64 * WIDE bits: of each hash, and of others made from it, the bits that over half of them have."""
    out = np.empty(WIDE, np.uint64)
    for i in range(WIDE):
        with np.errstate(over="ignore"):
            x = (hashes ^ ORDER_KEYS[i]) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[i] = majority(x ^ (x >> np.uint64(32)))
    return out


def size_band(size: int) -> int:
    """Bands of sizes, each BAND times the one before."""
    return int(np.floor(np.log(max(size, 1)) / np.log(BAND) + 1e-9))


def _features(width: int):
    """Per text, of its different shingles: the fingerprint and the wide one, the smallest hash in each order, their number, its band."""

    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for data in texts:
            h = np.unique(shingle_hashes(data, width))
            out.append((np.uint64(majority(h)).view(np.int64), wide(h).tobytes(), smallest(h).view(np.int64), len(h), size_band(len(h))))
        return pd.DataFrame(out, columns=["fp", "wide", "least", "size", "band"])

    return F.pandas_udf(find, "fp long, wide binary, least array<long>, size long, band int")


def likely_in_shard(prints: np.ndarray, sizes: np.ndarray, similarity: float, radius: int = WIDE_RADIUS) -> tuple[np.ndarray, int]:
    """For each wide fingerprint (a row) the first one that it hangs together with, by sizes and distances, and how many pairs were
    visited. The tree starts from the middle of the shard; what hangs together already is not visited again."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(prints), bitorder="little").view(np.uint64)
    order = np.lexsort((sizes, np.bitwise_count(prints ^ middle).sum(axis=1)))
    own, sizes = prints[order], sizes[order]
    tree = BKTree([int.from_bytes(x.tobytes(), "little") for x in own])
    part, visited, todo = np.arange(len(own)), 0, [(0, np.arange(len(own)))]
    while todo:
        at, who = todo.pop()
        visited += int((who > at).sum())
        d = np.bitwise_count(own[who] ^ own[at]).sum(axis=1, dtype=np.int64)
        fits = np.minimum(sizes[who], sizes[at]) >= (similarity - 1e-9) * np.maximum(sizes[who], sizes[at])
        for j in np.unique(part[who[(d <= radius) & fits & (part[who] != part[at])]]).tolist():
            low, high = sorted((int(part[at]), j))
            part[part == high] = low
        for edge, child in tree.children[at].items():
            some = who[(d >= edge - radius) & (d <= edge + radius)]
            if len(some) > 1 and (part[some] != part[some[0]]).any():
                todo.append((child, some))
    top = np.empty(len(own), np.int64)
    top[order] = order[part]
    return top, visited


def _shingle_sets(width: int):
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(data, width)).tobytes() for data in texts])

    return F.pandas_udf(find, "binary")


FULL = np.uint64(1 << 32)  # stands behind the end of a sketch


def sketch_likeness(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated likeness of a sketch to each of many (rows of SKETCH values, FULL behind their ends): the common share of
    all hashes up to where both sketches are complete. Exact for smaller sets; two empty ones are alike."""
    last = lambda x: np.where(x[..., -1] < FULL, x[..., -1], FULL - np.uint64(1))
    upto = np.minimum(last(a), last(others))
    inside = others <= upto[:, None]
    at = np.minimum(np.searchsorted(a, others), SKETCH - 1)
    common = ((a[at] == others) & inside).sum(axis=1)
    union = np.searchsorted(a, upto, side="right") + inside.sum(axis=1) - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def set_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two ascending sets of hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def _similar_in_shard(nodes: np.ndarray, values: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join what is similar. The tree starts from the middle of the shard, where the text lies that most
    others are copies of: pairs that links have joined already are not compared."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(values), bitorder="little").view(np.uint64)[0]
    order = np.lexsort((nodes, values, np.bitwise_count(values ^ middle)))
    nodes, values, sets = nodes[order], values[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    sketches = np.full((len(sets), SKETCH), FULL, np.uint64)
    for i, x in enumerate(sets):
        own = np.unique(x[: 2 * SKETCH] >> np.uint64(32))[:SKETCH]
        sketches[i, : len(own)] = own
    tree, part, found = BKTree(values.tolist()), np.arange(len(nodes)), []
    todo = [(0, np.arange(len(nodes)))]
    while todo:
        at, who = todo.pop()
        d = np.bitwise_count(values[who] ^ values[at])
        fits = np.minimum(sizes[who], sizes[at]) >= (similarity - 1e-9) * np.maximum(sizes[who], sizes[at])
        near = who[(d <= radius) & (who > at) & (part[who] != part[at]) & fits]
        for i in range(0, len(near), 4096):
            some = near[i : i + 4096]
            for j in some[sketch_likeness(sketches[at], sketches[some]) >= similarity - MARGIN].tolist():
                if part[j] != part[at] and set_likeness(sets[at], sets[j]) >= similarity:
                    found.append((int(nodes[at]), int(nodes[j])))
                    part[part == part[j]] = part[at]
        for edge, child in tree.children[at].items():
            if len(some := who[(d >= edge - radius) & (d <= edge + radius)]):
                todo.append((child, some))
    return found


def _in_groups(columns, solve):
    """The links (a, b) that ``solve`` finds among the rows of each ``key``, which come in order; ``columns`` makes of a frame the
    sequences of which it gets a group's part."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(pdf: pd.DataFrame) -> pd.DataFrame:
            keys, given = pdf["key"].to_numpy(np.int64), columns(pdf)
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
            found = [x for i, j in zip(bounds[:-1], bounds[1:], strict=True) if j - i > 1 for x in solve(*(c[i:j] for c in given))]
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for pdf in batches:
            keys = pdf["key"].to_numpy(np.int64)
            if not len(keys):
                continue
            cut = int((keys == keys[-1]).argmax())
            if held and (cut or keys[0] != held[-1]["key"].iloc[-1]):
                yield links(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            elif cut:
                yield links(pdf.iloc[:cut])
            held.append(pdf.iloc[cut:])
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return search


def _similar(radius: int, similarity: float):
    def columns(pdf: pd.DataFrame) -> tuple:
        return pdf["node"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64), [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]

    return _in_groups(columns, lambda nodes, values, sets: _similar_in_shard(nodes, values, sets, radius, similarity))


def _likely(similarity: float):
    def columns(pdf: pd.DataFrame) -> tuple:
        return pdf["node"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(pdf), WIDE)

    def solve(nodes: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        if len(nodes) <= 48:  # mostly without any pair that is near: told at once
            far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
            if (far <= WIDE_RADIUS).sum() == len(nodes):
                return []
        top, _ = likely_in_shard(prints, sizes, similarity)
        moved = np.flatnonzero(top != np.arange(len(top)))
        return list(zip(nodes[moved].tolist(), nodes[top[moved]].tolist(), strict=True))

    return _in_groups(columns, solve)


def _dealt(rows: DataFrame, group: str, crowd: int) -> DataFrame:
    """``rows`` (node, size) of groups of two and more, with a ``key`` for each or, where a group is crowded, for every two of its
    blocks: a row goes to the tasks of its block and each other one; crowded groups have three blocks or more."""
    fill = F.greatest(F.count("*") / crowd, F.sum("size") * 8 / CROWD_BYTES)  # 1: as much as a task takes
    blocks = F.when(fill <= 1, 1).otherwise(F.ceil(2 * fill)).cast("int")
    groups = rows.groupBy(group).agg(F.count("*").alias("texts"), blocks.alias("blocks")).where("texts > 1").drop("texts")
    told = rows.join(groups, group).withColumn("block", F.pmod(F.xxhash64("node", group), "blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.when(i != F.col("block"), F.xxhash64(group, F.least(i, "block"), F.greatest(i, "block"))))
    keys = F.when(F.col("blocks") > 1, F.array_compact(pairs)).otherwise(F.array(F.xxhash64(group)))
    return told.withColumn("key", F.explode(keys)).select("key", "node")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``: that with the smallest id, null ids last.

    Repeated rows are copies like others; all columns stay as they are; no rows give none.
    """
    uid, group = fresh(docs, "uid"), fresh(docs, "grp")
    rows = similar_groups(docs, id_col, text_col, width, similarity, radius, uid, group)
    best = rows.groupBy(group).agg(F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(uid).alias("uid"))).alias("best")).select(F.col("best.uid").alias(uid))
    return rows.join(best, uid, "left_semi").select(*docs.columns)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS, uid: str = "uid", group: str = "grp") -> DataFrame:
    """``docs`` with a number for each row and the number of its group of similar texts, in the columns ``uid`` and ``group``.

    Texts are similar if the fingerprints of their different ``width``-word shingles are
    within ``radius`` bits (see RADIUS for how few pairs of likeness 0.8 are not) and
    ``similarity`` or more of these shingles are common, counted by 64-bit hashes; groups are
    what such links join. Fingerprints this far apart share no fixed bits, so they are sought in two
    steps. Shards, each with its BK-tree of wide fingerprints (WIDE), hold the texts that
    share a smallest shingle hash and lie in one band of sizes or the next; what hangs
    together there is a group, and only texts of a group are read again, once each, for all their hashes, which a
    second BK-tree sets beside each other. A shard of more than CROWD texts, or a group of so
    many or of CROWD_BYTES of hashes, is cut into blocks, and every two blocks meet in a task, so that
    every pair does. Null texts and texts without words are similar to each
    other alone. Repeated rows are copies like others; no rows give none.
    """
    found = fresh(docs, "found")
    rows = materialize(with_uid(docs, uid).withColumn(found, _features(width)(F.col(text_col).cast("binary"))), "similar", TEXTS)
    own = rows.select(F.col(uid).alias("_uid"), F.xxhash64(text_col).alias("hash"), f"{found}.*")
    # Copies of one text are one node, named after one of them.
    picked = [F.min_by(c, "_uid").alias(c) for c in ("wide", "least", "size", "band")]
    nodes = materialize(own.groupBy("hash", "fp").agg(F.min("_uid").alias("node"), *picked), "nodes")
    bands = F.array("band", F.col("band") + 1)
    sharded = nodes.select("node", "size", F.explode(bands).alias("band"), "least").select("node", "band", F.posexplode("least").alias("n", "value")).select("node", F.xxhash64("n", "value", "band").alias("shard"), F.lit(0).alias("size"))
    rowed = _dealt(sharded, "shard", CROWD).join(nodes.select("node", "size", "wide"), "node")
    likely = rowed.repartition("key").sortWithinPartitions("key", "size", "node").mapInPandas(_likely(similarity), "a long, b long")
    groups = connected_components(likely)
    member = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    member = materialize(member.join(nodes.select("node", "fp", "size"), "node"), "members")
    wanted = _dealt(member.select("node", "root", "size"), "root", CROWD).groupBy("node").agg(F.collect_list("key").alias("keys"))
    wanted = materialize(wanted.join(member.select("node", "fp"), "node"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # texts of no group are not shuffled, while the list is short
    texts = rows.select(F.col(uid).alias("node"), F.col(text_col).cast("binary").alias("text")).join(few, "node")
    sets = texts.select("node", "fp", "keys", _shingle_sets(width)("text").alias("hashes"))
    dealt = sets.select(F.explode("keys").alias("key"), "node", "fp", "hashes").repartition("key").sortWithinPartitions("key", "fp", "node")
    roots = connected_components(dealt.mapInPandas(_similar(radius, similarity), "a long, b long"), batch=TEXTS)
    placed = nodes.select("hash", "fp", "node").join(roots, "node", "left").select("hash", "fp", F.coalesce("root", "node").alias("root"))
    member = own.select("_uid", "hash", "fp").join(placed, ["hash", "fp"]).select(F.col("_uid").alias(uid), F.col("root").alias(group))
    return rows.drop(found).join(member, uid).select(*docs.columns, uid, group)
