"""Mixing sources to target weights, by drawing fixed-length blocks of tokens.

Each source's texts are laid end to end and cut into blocks of ``block`` words. The mix is
a sequence of slots, dealt over output shards. How many slots of a shard each source gets is
a multinomial draw, conditioned on the sources' totals: a tree over the shards splits the
totals again and again by hypergeometric draws that are seeded by the tree's node, so that
each shard finds its own counts and where they start without asking another. A source's
slots run through pseudorandom permutations of its block numbers, one permutation a pass;
then blocks are joined by (source, number). Nothing depends on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynxmark.llm.common import SPACE, WORD, materialize

WEIGHTS = (3.0, 1.0, 2.0)
ROUNDS = 4


def share(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Targets: ``total`` by weight, but none above ``most`` times its size; what is above goes to the rest by weight."""
    targets, open_, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if weights[i] > 0], float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        for i in full or open_:
            targets[i] = most * sizes[i] if full else left * weights[i] / whole
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``x``: a Feistel network that walks its cycle until it is back below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), [np.uint64(_key(key, r) | 1) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in reversed(keys) if inverse else keys:
            known = left if inverse else right
            mixed = (known + k) * k
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(32))) & low
            left, right = (right ^ mixed, left) if inverse else (right, left ^ mixed)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(x, np.uint64))
        while len(away := np.flatnonzero(out >= n)):
            out[away] = once(out[away])
    return out.astype(np.int64)


def _hyper(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw; beyond what numpy takes, its normal limit, kept inside the support."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    p, n = good / (good + bad), good + bad
    sd = (draws * p * (1 - p) * (n - draws) / max(1, n - 1)) ** 0.5
    return int(min(max(round(rng.normal(draws * p, sd)), draws - bad, 0), draws, good))


@dataclass(frozen=True)
class Plan:
    """What the driver knows of the sources: one entry each, nothing of single documents."""

    sizes: list[int]
    targets: list[float]
    slots: list[int]
    cut: list[int]  # words that each source's last slot leaves out
    block: int
    shard_slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-sum(self.slots) // self.shard_slots)

    def counts(self, shard: int) -> tuple[list[int], list[int]]:
        """Of each source, the slots before the shard and those in it."""
        before, have = [0] * len(self.slots), list(self.slots)
        lo, hi, room = 0, self.shards, sum(self.slots)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            first = (mid - lo) * self.shard_slots  # all but the last shard are full
            rng, rest, left, draws = np.random.default_rng(_key(self.seed, "shards", lo, hi)), room, [], first
            for n in have:
                rest -= n
                left.append(_hyper(rng, n, rest, draws))
                draws -= left[-1]
            if shard < mid:
                hi, have, room = mid, left, first
            else:
                before, have = [b + n for b, n in zip(before, left, strict=True)], [n - k for n, k in zip(have, left, strict=True)]
                lo, room = mid, room - first
        return before, have

    def draw(self, shard: int) -> pd.DataFrame:
        """The shard's slots, in output order: source number, block number, pass, words left out at the end."""
        before, here = self.counts(shard)
        out = []
        for s, (k, n) in enumerate(zip(before, here, strict=True)):
            blocks = -(-self.sizes[s] // self.block)
            at = np.arange(k, k + n)
            for turn in np.unique(at // blocks) if n else ():
                own = at[at // blocks == turn]
                out.append(pd.DataFrame({"src": s, "blk": permute(own - turn * blocks, blocks, _key(self.seed, s, int(turn))), "turn": turn, "cut": np.where(own == self.slots[s] - 1, self.cut[s], 0)}))
        slots = pd.concat(out) if out else pd.DataFrame({"src": [], "blk": [], "turn": [], "cut": []})
        slots = slots.iloc[np.random.default_rng(_key(self.seed, "order", shard)).permutation(len(slots))]
        return slots.assign(shard=shard, slot=np.arange(len(slots)))[["shard", "slot", "src", "blk", "turn", "cut"]]


def make_plan(sizes: list[int], weights: list[float], total: float, block: int, shard_slots: int, seed: int) -> Plan:
    """Slots such that each source's words come to its target, rounded; its last slot is cut to fit."""
    targets, slots, cuts = share(sizes, weights, total), [], []
    for s, (size, target) in enumerate(zip(sizes, targets, strict=True)):
        want, blocks = min(int(target + 0.5), 2 * size), -(-size // block)
        if not want:
            slots.append(0)
            cuts.append(0)
            continue
        turns, rest = divmod(want, size)
        missing = blocks * block - size  # words that the source's last block lacks
        if not rest:
            n, cut = turns * blocks, 0
        else:
            short = int(permute(np.array([blocks - 1]), blocks, _key(seed, s, turns), inverse=True)[0])
            n = -(-rest // block)
            if n > short:  # the short block is among them
                n = max(short + 1, -(-(rest + missing) // block))
            cut = n * block - (missing if n > short else 0) - rest
            n += turns * blocks
        slots.append(n)
        cuts.append(cut)
    return Plan(sizes, targets, slots, cuts, block, shard_slots, seed)


class Mix:
    """The mix of ``docs`` (columns ``id_col``, ``text_col``, ``source_col``; others are ignored).

    ``sources``: (source, size, source_size, target) by source number. ``pieces``: the parts of
    documents that slots take, (shard, slot, seq, src, turn, uid, from_word, n_words); ``documents``: one row
    per input row, (uid, id, source, size, source_size, target, taken). ``texts()``: the mixed
    slots' words.

    Sources go by code point, null last, as source numbers 0, 1, ...; they weigh
    ``weights``, repeated. Null texts and texts without words have size 0 and are never
    taken; null and empty sources are two sources; null and repeated ids and repeated rows
    are rows of their own (``uid`` numbers rows by source, bucket and id); no rows give an
    empty mix. At most ``max_sources`` sources are allowed: that list alone is held by the
    driver.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, times: float = 1.5, block: int = 256, shard_slots: int = 4096, seed: int = 7, max_sources: int = 100_000):
        self.spark, self.docs, self.cols, self.block = docs.sparkSession, docs, (id_col, text_col, source_col), block
        text = F.col(text_col)
        size = F.coalesce(F.size(F.split(F.regexp_replace(text, f"^{SPACE}", ""), SPACE, -1)) - F.when(text.rlike(r"[\x20\x09-\x0D]$"), 1).otherwise(0), F.lit(0)).cast("long")
        size = F.when(text.rlike(WORD), size).otherwise(F.lit(0)).cast("long")
        # What is wanted of the texts is written once, some tens of bytes a row; all plans below read that.
        own = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("text_hash")), "sizes")
        sums = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
        if len(sums) > max_sources:
            raise ValueError(f"over {max_sources} sources")
        sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.plan = make_plan([r["source_size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], times * sum(r["source_size"] for r in sums), block, shard_slots, seed)
        self.sources = self.spark.createDataFrame([(i, r["source"], r["source_size"], self.plan.targets[i]) for i, r in enumerate(sums)], "src int, source string, source_size long, target double")
        # A bucket, not a source, is what one task orders: as many as there are rows for.
        buckets = max(64, sum(r["n"] for r in sums) // 10_000)
        small = F.broadcast(self.sources) if len(sums) <= 10_000 else self.sources
        numbered = own.join(small, own["source"].eqNullSafe(small["source"])).select("src", F.pmod(F.xxhash64("id", "text_hash"), F.lit(buckets)).cast("int").alias("bucket"), "id", own["source"].alias("source"), "size", "text_hash", "source_size", "target")
        by_bucket = Window.partitionBy("src", "bucket").orderBy(F.col("id").asc_nulls_last(), "text_hash")
        starts = numbered.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("start", F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        placed = numbered.withColumn("pos", F.row_number().over(by_bucket)).withColumn("upto", F.sum("size").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        placed = placed.join(starts, ["src", "bucket"]).withColumn("begin", F.coalesce("start", F.lit(0)) + F.col("upto") - F.col("size"))
        self.placed = placed.select("src", F.struct("src", "bucket", "pos").alias("uid"), "id", "source", "size", "text_hash", "source_size", "target", "begin")

    def slots(self) -> DataFrame:
        """The drawn slots (shard, slot, src, blk, turn, cut), made shard by shard on the executors."""
        plan, parts = self.plan, max(1, min(self.plan.shards, 2000))

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard in pdf["id"]:
                    yield plan.draw(int(shard))

        return self.spark.range(0, plan.shards, 1, parts).mapInPandas(draw, "shard long, slot long, src int, blk long, turn int, cut int")

    def pieces(self) -> DataFrame:
        """Documents cut at the blocks' edges, joined to the slots that drew the block."""
        b, end = F.lit(self.block), F.col("begin") + F.col("size")
        cut = self.placed.where("size > 0").select("src", "uid", "begin", "size", "source_size", F.explode(F.sequence((F.col("begin") / b).cast("long"), ((end - 1) / b).cast("long"))).alias("blk"))
        lo, hi = F.greatest("begin", F.col("blk") * b), F.least(F.col("begin") + F.col("size"), (F.col("blk") + 1) * b)
        cut = cut.select("src", "blk", "uid", "source_size", (lo - F.col("begin")).alias("from_word"), (lo - F.col("blk") * b).alias("seq"), (hi - lo).alias("n_words"))
        # Slots are as many as the mix has blocks; Spark, which cannot know that, would take them for few and send them to every task.
        drawn = cut.join(self.slots().hint("merge"), ["src", "blk"])
        kept = F.least(b, F.col("source_size") - F.col("blk") * b) - F.col("cut")
        return drawn.withColumn("n_words", F.least("n_words", kept - F.col("seq"))).where("n_words > 0").select("shard", "slot", "seq", "src", "turn", "uid", "from_word", "n_words")

    def documents(self) -> DataFrame:
        taken = self.pieces().groupBy("uid").agg(F.sum("n_words").alias("words"))
        return self.placed.join(taken, "uid", "left").select("uid", "id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """The mix itself: (shard, slot, src, words array<string>), a block a row."""
        id_col, text_col, source_col = self.cols
        words = self.docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1)).alias("words")).distinct()
        rows = self.placed.select("uid", "id", "source", "text_hash")
        same = [rows[c].eqNullSafe(words[c]) for c in ("id", "source", "text_hash")]
        texts = rows.join(words, same).select("uid", "words")
        parts = self.pieces().join(texts, "uid").select("shard", "slot", "src", F.struct("seq", F.slice("words", (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")).alias("words")).alias("part"))
        joined = F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["words"]))
        return parts.groupBy("shard", "slot", "src").agg(joined.alias("words"))

    def mixed_documents(self) -> DataFrame:
        """The mix as rows of ``docs``, with all their columns: a row for each pass over a document, its text the words
        that the pass takes (the text itself where it takes all; else joined by one space).

        Of rows that agree in id, source and text, the other columns are those of one of them.
        """
        id_col, text_col, source_col = self.cols
        mark = "_mix"  # before the names of columns that are none of the documents'
        while any(c.lower().startswith(mark) for c in self.docs.columns):
            mark += "_"
        taken = self.pieces().groupBy("uid", "turn").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias(f"{mark}_parts"), F.sum("n_words").alias(f"{mark}_n"))
        places = self.placed.select("uid", F.col("id").alias(f"{mark}_id"), F.col("source").alias(f"{mark}_source"), F.col("text_hash").alias(f"{mark}_hash"), F.col("size").alias(f"{mark}_size"))
        taken = places.join(taken, "uid").withColumnRenamed("turn", f"{mark}_turn").drop("uid")
        rows = self.docs.withColumn(f"{mark}_h", F.xxhash64(text_col))
        # Repeated rows each have places of their own, so one of them is joined to all; without any, texts are shuffled once only.
        if self.placed.groupBy("id", "source", "text_hash").count().where("count > 1").limit(1).count():
            rows = rows.dropDuplicates([id_col, source_col, f"{mark}_h"])
        both = rows.join(taken, rows[id_col].eqNullSafe(taken[f"{mark}_id"]) & rows[source_col].eqNullSafe(taken[f"{mark}_source"]) & (rows[f"{mark}_h"] == taken[f"{mark}_hash"]))
        words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
        cut = F.flatten(F.transform(f"{mark}_parts", lambda p: F.slice(words, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int"))))
        text = F.when(F.col(f"{mark}_n") == F.col(f"{mark}_size"), F.col(text_col)).otherwise(F.array_join(cut, " "))
        return both.select(*[text.alias(c) if c == text_col else rows[c] for c in self.docs.columns])
