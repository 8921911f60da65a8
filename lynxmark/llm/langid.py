"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows of them; each
filter's largest answer in a window goes to a softmax over languages. A text's prediction
is the mean over all its windows, which cover it whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 12, 8
WIDEST = max(WIDTHS)
STEP = WINDOW - WIDEST + 1  # so many places in each window at which filters start: windows overlap by the rest
BATCH = 128
UNKNOWN = "und"
#: Letters of scripts, by their code points, from which texts of no learnt language are made.
SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Of the training rows each so-manieth is held out to see what scores known languages get, and so many are the least that tell.
HELD, ENOUGH = 10, 50
LEAST_STEPS = 400  # of training, however few the samples


def windows(data: bytes) -> np.ndarray:
    """The whole text as windows of bytes, zeros after its end."""
    n = max(1, -(-len(data) // STEP))
    padded = np.zeros(n * STEP + WIDEST - 1, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (STEP, 1))


@dataclass
class Network:
    """Weights of bounded size; ``labels`` are the languages it has learnt. One answer more stands for none of them: it is
    learnt from made texts in scripts that no learnt language uses. A text whose likeliest language has a probability below
    ``least`` is less sure than any text that was held out in training."""

    labels: list[str]
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDEST * DIMS x filters; rows beyond a filter's width stay zero
    bias: np.ndarray
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray
    least: float = 0.0

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        n, m = FILTERS * len(WIDTHS), len(labels) + 1
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(labels, draw(256, DIMS, scale=0.5), draw(WIDEST * DIMS, n, scale=0.25), np.zeros(n, np.float32), draw(n, m, scale=0.2), np.zeros(m, np.float32))
        net.filters *= cls.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        return np.repeat(np.stack([np.arange(WIDEST * DIMS) < w * DIMS for w in WIDTHS], 1), FILTERS, axis=1).astype(np.float32)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, filters)"""
        e = self.embed[x].reshape(len(x), WINDOW * DIMS)
        size = e.itemsize
        patches = np.lib.stride_tricks.as_strided(e, (len(x), STEP, WIDEST * DIMS), (e.strides[0], DIMS * size, size))
        return np.ascontiguousarray(patches).reshape(-1, WIDEST * DIMS) @ self.filters

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, labels and none of them)"""
        parts = []
        for i in range(0, len(x), BATCH):
            part = x[i : i + BATCH]
            pooled = np.maximum(self.convolve(part).reshape(len(part), STEP, -1).max(axis=1) + self.bias, 0)
            parts.append(softmax(pooled @ self.out + self.out_bias))
        return np.concatenate(parts)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 4e-3, batch: int = 64) -> None:
        """Adam on the cross entropy; through the pooling, only each filter's best place learns."""
        names = ("embed", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second, step, mask = {k: np.zeros_like(v) for k, v in first.items()}, 0, self.mask()
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own, target = x[order[i : i + batch]], y[order[i : i + batch]]
                n, rows = len(own), np.arange(len(own))
                conv = self.convolve(own).reshape(n, STEP, -1)
                best = conv.argmax(axis=1)
                pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(pooled, 0)
                wrong = softmax(hidden @ self.out + self.out_bias)
                wrong[rows, target] -= 1
                wrong /= n
                back = (wrong @ self.out.T) * (pooled > 0)
                grad = {"out": hidden.T @ wrong, "out_bias": wrong.sum(0), "bias": back.sum(0)}
                places = own[rows[:, None, None], best[:, :, None] + np.arange(WIDEST)]  # n x filters x WIDEST bytes
                patches = self.embed[places].reshape(n, -1, WIDEST * DIMS)
                grad["filters"] = np.einsum("nf,nfk->kf", back, patches) * mask
                spread = (back[:, :, None] * self.filters.T).reshape(n, -1, WIDEST, DIMS)
                grad["embed"] = np.zeros_like(self.embed)
                np.add.at(grad["embed"], places, spread)
                step += 1
                pace = rate * (1 - 0.9 * epoch / epochs)
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    setattr(self, k, (getattr(self, k) - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800, slices: int = 3, max_langs: int = 500, epochs: int = 8, seed: int = 11) -> Network:
    """Learn from rows where ``learn`` (a Column) is true and text, language and id are not null.

    The sample is bounded: of each language the ``per_lang`` different ids with the smallest
    hashes, of each id one row with ``slices`` windows from places that its hash picks
    (where an id has several rows, the one whose windows come first in order). Repeated
    rows and ids neither crowd out others nor count twice, and which rows are taken does not
    depend on the order of the input.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    mix = F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))
    keyed = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), mix.alias("mix"))
    ids = keyed.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).limit(max_langs + 1).collect()
    counts = {r["lang"]: max(1, r["n"]) for r in ids}
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    # Of a language with many ids only those with small hashes, four times as many as wanted, are ranked in one task.
    bounds = {lang: min(1.0, 4 * per_lang / n) for lang, n in counts.items()}
    low = [(F.col("lang") == lang) & (F.col("mix") < F.lit(int(share * ((1 << 63) - 1)))) if share < 1 else F.col("lang") == lang for lang, share in bounds.items()]
    few = keyed.where(reduce(or_, low, F.lit(False))).distinct()
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("mix", "id")))
    chosen = ranked.where(F.col("nth") <= per_lang).select("id", "lang")
    # at most per_lang * max_langs ids: small enough to send to every task
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    places = [F.pmod(F.xxhash64("id", F.lit(seed + i)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1 for i in range(slices)]
    cut = rows.select("lang", "id", F.struct(*[F.substring(F.col("text"), p, F.lit(WINDOW)).alias(f"s{i}") for i, p in enumerate(places)]).alias("cut"))
    sample = cut.groupBy("lang", "id").agg(F.min("cut").alias("cut")).orderBy("lang", "id").select("lang", "cut.*").collect()  # per_lang rows a language
    held = [parts for i, (_, *parts) in enumerate(sample) if i % HELD == HELD - 1]
    net = fit([(lang, s) for i, (lang, *parts) in enumerate(sample) if i % HELD != HELD - 1 or len(held) < ENOUGH for s in parts], epochs, seed)
    if len(held) >= ENOUGH and len(net.labels) > 1:
        sure = [verdicts(net.probabilities(np.concatenate([windows(s.encode().lower()) for s in parts])))[:-1].max() for parts in held]
        guess = 1 / len(net.labels)
        net.least = guess + float(min(sure) - guess) / 4  # nearer to a blind guess than to the least sure
    return net


def verdicts(p: np.ndarray) -> np.ndarray:
    """Of a text's windows: the mean probabilities of the languages, given that it is one of them, and that of none of them."""
    known = p[:, :-1] + 1e-9
    return np.append((known / known.sum(axis=1, keepdims=True)).mean(axis=0), p[:, -1].mean())


def strange(samples: list[tuple[str, str]], n: int, rng: np.random.Generator) -> list[str]:
    """``n`` texts of random words in scripts that make up less than a hundredth of the samples' letters."""
    seen = np.concatenate([np.frombuffer(text.lower().encode("utf-32-le"), "<u4") for _, text in samples])
    letters = max(1, int((seen > 64).sum()))
    unused = [(a, b) for a, b in SCRIPTS if ((seen >= a) & (seen <= b)).sum() < letters / 100]
    out = []
    for i in range(n if unused else 0):
        a, b = unused[i % len(unused)]
        words = ["".join(map(chr, rng.integers(a, b + 1, rng.integers(1, 9)))) for _ in range(rng.integers(1, 40))]
        out.append(" ".join(words))
    return out


def fit(samples: list[tuple[str, str]], epochs: int = 8, seed: int = 11) -> Network:
    """A network from (language, text) pairs, the first window of each; without samples it knows no language."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in samples})
    net = Network.fresh(labels, rng)
    if labels:
        others = strange(samples, -(-len(samples) // (2 * len(labels))), rng)
        x = np.concatenate([windows(text.encode().lower())[:1] for text in [t for _, t in samples] + others])
        y = [labels.index(lang) for lang, _ in samples] + [len(labels)] * len(others)
        net.fit(x, np.array(y), max(epochs, -(-64 * LEAST_STEPS // len(x))), rng)
    return net


RESULT = StructType([StructField("label", IntegerType()), StructField("score", DoubleType()), StructField("other", DoubleType())])


def predict(docs: DataFrame, net: Network, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: (lang, score, other).

    lang is a learnt language, score its mean probability over the text's windows, given that
    the text is in one of the learnt languages; other is the mean probability that it is in
    none (see ``is_known``). Null and empty texts, texts without a letter, and any text if no
    language was learnt, have lang ``und``, score 0 and other 1. Other columns, whatever their
    names, and repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(RESULT)
    def classify(texts: pd.Series) -> pd.DataFrame:
        model, labels, scores, others = sent.value, [], [], []
        waiting: list[np.ndarray] = []

        def flush() -> None:
            if not waiting:
                return
            p = model.probabilities(np.concatenate(waiting))
            known = p[:, :-1] + 1e-9
            p = np.column_stack([known / known.sum(axis=1, keepdims=True), p[:, -1]])
            begins = np.cumsum([0, *(len(w) for w in waiting[:-1])])
            mean = np.add.reduceat(p, begins, axis=0) / np.array([[len(w)] for w in waiting])
            labels.extend(mean[:, :-1].argmax(axis=1).tolist())
            scores.extend(np.minimum(mean[:, :-1].max(axis=1), 1).astype(float).tolist())
            others.extend(np.minimum(mean[:, -1], 1).astype(float).tolist())
            waiting.clear()

        held = 0
        for data in texts:
            waiting.append(windows(data.lower()) if data is not None else np.zeros((1, WINDOW), np.uint8))
            held += len(waiting[-1])
            if held >= BATCH:
                flush()
                held = 0
        flush()
        return pd.DataFrame({"label": labels, "score": scores, "other": others})

    if not net.labels:
        return docs.withColumn(out, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(1.0).alias("other")))
    text = F.col(text_col)
    judged = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    names = F.array(*map(F.lit, net.labels))
    found = classify(text.cast("binary"))
    return docs.withColumn(out, found).withColumn(out, F.struct(F.when(judged, F.get(names, F.col(out)["label"])).otherwise(UNKNOWN).alias("lang"), F.when(judged, F.col(out)["score"]).otherwise(0.0).alias("score"), F.when(judged, F.col(out)["other"]).otherwise(1.0).alias("other")))


def is_known(found: Column, net: Network) -> Column:
    """Is a text that predict() judged in one of the learnt languages? It is not, if a text in none of them is as likely
    or the likeliest language is nearly a guess."""
    return (found["lang"] != UNKNOWN) & (found["other"] < 0.5) & (found["score"] >= net.least)
