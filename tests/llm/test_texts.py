"""Language model, BPE, language ID, token counts, secrets and the pipeline, beside libraries and brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lynxmark.llm import brown, langid, queries, secret_scan
from lynxmark.llm.bpe import BPE, Codec
from lynxmark.llm.common import materialize
from lynxmark.llm.tokencount import Counter as TokenCounts
from lynxmark.llm.tokencount import TokenCounter

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c"), (1, "a b c"), (None, "a b zz"), (2, None), (3, ""), (4, " \t\n"), (5, "Ａ é\x85x 😀 <|endoftext|>"), (7, "word " * 30_000), (8, "x" * 70_000), (9, "12 34 !!")]


def docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "words", "pack", "learn", "held", "n", "label", "score", "kind", "start", "found", "both", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def given(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_lm_contract(spark):
    texts = given(spark)
    rows = queries.op4_brown_lm(spark, SF).collect()
    fold = {k: zlib.crc32(str(k).encode()) % 10 for k in texts}
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    counts = Counter(w for k, ws in tokens.items() if fold[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_lm_of_odd_rows(spark):
    rows = brown.fit_and_score(docs(spark), F.col("doc_id") != 5, F.col("doc_id") == 5).collect()
    assert len(rows) == len(ODD)
    by = {r.id: r for r in rows if r.id not in (1,)}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[2].score == by[4].score and by[7].n_tokens == 30_001
    assert by[5].held and by[5].n_known == 1 and not by[None].held and by[None].n_known == 3
    assert brown.fit_and_score(docs(spark, []), F.lit(True), F.lit(False)).count() == 0
    nothing = brown.fit_and_score(docs(spark), F.lit(False), F.lit(None).cast("boolean")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and not r.held and r.score <= 0 for r in nothing)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    kind = np.arange(40) % 4
    grid = np.zeros((41, 41))
    for _ in range(20_000):
        a = rng.integers(40)
        grid[a, rng.choice(np.flatnonzero(kind == (kind[a] + 1) % 4))] += 1
    grid[40, :40] += 5
    grid[:40, 40] += 5
    of = brown.exchange(grid, 5, {40: 0})
    assert of[40] == 0 and (of[:40] > 0).all() and len({(k, c) for k, c in zip(kind, of[:40], strict=True)}) == 4


def test_words_move_to_the_likeliest_class():
    rng = np.random.default_rng(5)
    c = rng.integers(1, 60, (brown.SIDES, brown.SIDES)).astype(float)
    words, codes, times, now = [], [], [], []
    for w in range(12):
        now.append(brown.REST if w % 3 else 1 + w)
        for code in sorted(rng.choice(2 * brown.SIDES, rng.integers(0, 9), replace=False).tolist()):
            words.append(w), codes.append(code), times.append(int(rng.choice([1, 2, 40])))
    for w, code, n in zip(words, codes, times, strict=True):  # a present member's counts are among its class's own
        if now[w] < brown.REST:
            c[(code, now[w]) if code < brown.SIDES else (now[w], code - brown.SIDES)] += n
    got = brown.Mover(c).best(np.array(words), np.array(codes), np.array(times), 12, np.array(now))
    for w in range(12):
        around = [(k, n) for x, k, n in zip(words, codes, times, strict=True) if x == w]
        gains = {k: _cellwise(c, around, k, now[w]) for k in range(1, brown.CLASSES)}
        assert gains[int(got[w])] == pytest.approx(max(gains.values()), abs=1e-6)


def _cellwise(c, around, k, now):
    """The gain of one class, cell by cell and with the class's own two sums, by plain arithmetic."""
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    change = (lambda x, n: f(x) - f(x - n)) if k == now else (lambda x, n: f(x + n) - f(x))
    total = sum(change(c[code, k] if code < brown.SIDES else c[k, code - brown.SIDES], n) for code, n in around)
    left, right = sum(n for code, n in around if code >= brown.SIDES), sum(n for code, n in around if code < brown.SIDES)
    return total - change(c[k].sum(), left) - change(c[:, k].sum(), right)


@pytest.mark.parametrize("small", [False, True])
def test_scores_follow_from_the_classes(spark, monkeypatch, small):
    """Every learnt word has a class, and scores are those of a plain model of these classes; with few seeds, frequent and
    common words each step has words to place."""
    if small:
        for name, n in (("SEEDS", 30), ("FREQUENT", 300), ("COMMON", 420), ("PACK_BYTES", 40_000), ("ROWS", 500)):
            monkeypatch.setattr(brown, name, n)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    packs = brown.packed(spark.read.parquet(f"{SF}/documents.parquet"), fold != 0, fold == 0)
    words = brown.cluster(packs)
    told = brown._told(packs, words)
    scored = {r.id: r for r in brown._score(told, brown._model(told, words)).collect()}
    table = {bytes(r.word): (r.n, r.cls) for r in words.collect()}
    texts = given(spark)
    tokens = {k: t.encode().lower().split() for k, t in texts.items()}
    learnt = [k for k in texts if zlib.crc32(str(k).encode()) % 10]
    assert {w: n for w, (n, _) in table.items()} == Counter(w for k in learnt for w in tokens[k])
    assert len({c for _, c in table.values()}) > 20 and all(0 < c < brown.CLASSES for _, c in table.values())
    groups = Counter((brown.ending(w), c) for w, (_, c) in table.items())
    kinds = Counter(c for _, c in table.values())

    def class_of(w):
        if w in table:
            return table[w][1]
        own = {c: n for (e, c), n in groups.items() if e == brown.ending(w)} or kinds
        return min(c for c, n in own.items() if n == max(own.values()))

    flows = {k: [0, *map(class_of, ws), 0] for k, ws in tokens.items()}
    own = lambda w: 1 if w is None else (65536 - 65536 // table[w][0]) / 65536
    taught, after, before, loose = Counter(), Counter(), Counter(), Counter()
    for k in learnt:
        ws = [None, *tokens[k], None]
        for a, b, x, y in zip(flows[k], flows[k][1:], ws, ws[1:]):
            before[a] += 1
            after[b] += 1
            taught[a, b] += min(own(x), own(y))
            loose[a] += 1 - min(own(x), own(y))
    kinds[0] = 1
    whole = sum(after.values())
    for k, ws in tokens.items():
        total = 0.0
        for a, b, w in zip(flows[k], flows[k][1:], [*ws, None]):
            prior = (after[b] + 1) / (whole + brown.CLASSES)
            total += math.log10((taught[a, b] + (loose[a] + brown.TRUST) * prior) / (before[a] + brown.TRUST))
            if w is not None:
                total += math.log10((table.get(w, (0, 0))[0] + brown.SMOOTH) / (after[b] + brown.SMOOTH * (kinds[b] + 1)))
        assert scored[k].score == pytest.approx(total, rel=1e-9)


def equally_frequent(n, seed=1):
    """Texts of 1,000 words, in which each of ``n`` words occurs twice."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(n)] * 2
    rng.shuffle(words)
    return [(i // 1000, " ".join(words[i : i + 1000])) for i in range(0, len(words), 1000)]


@pytest.mark.parametrize("n", [8_400, 80_000])
def test_equally_frequent_words_use_all_classes(spark, n):
    """However many words share the topmost count, as many as wanted of them are taken, told by a hash."""
    packs = brown.packed(spark.createDataFrame(equally_frequent(n), "doc_id long, text string"), F.lit(True), F.lit(False))
    words = brown.cluster(packs)
    assert words.count() == n and words.select("cls").distinct().count() > 40
    assert len(brown._top(words.select("word", "n"), 5_000)) == 5_000


def test_top_words(spark):
    rows = [(f"w{i}".encode(), 1 + i // 100) for i in range(5_000)] + [(b"x" * 300, 10**9), (b"y" * 256, 10**8)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (1, 2, 150, 4_999, 6_000):
        got = brown._top(counts, most)
        assert len(got) == min(most, 5_001) and next(iter(got)) == b"y" * 256
        assert list(got.values()) == sorted(got.values(), reverse=True)


def test_classes_do_not_go_by_packs_or_batches(spark, monkeypatch):
    """Words' rows meet in the same sums, however they are dealt: a frequent word in the sums of a task, others row by row."""
    for name, n in (("SEEDS", 30), ("FREQUENT", 200), ("COMMON", 300)):
        monkeypatch.setattr(brown, name, n)
    found = []
    for pack, rows in ((8 << 20, 10_000), (3_000, 3)):
        monkeypatch.setattr(brown, "PACK_BYTES", pack)
        monkeypatch.setattr(brown, "ROWS", rows)
        docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 9 = 0").coalesce(1)
        with brown.batches_of(spark, rows):
            found.append(sorted((bytes(r.word), r.n, r.cls) for r in brown.cluster(brown.packed(docs, F.lit(True), F.lit(False))).collect()))
    assert found[0] == found[1] and len(found[0]) > 1_000


def test_words_that_all_occur_once(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 5)
    rows = brown.fit_and_score(spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j")], "doc_id long, text string"), F.col("doc_id") == 1, F.lit(False)).collect()
    assert sorted((r.id, r.n_known, r.train_tokens) for r in rows) == [(1, 9, 9), (2, 1, 9)] and all(r.score < 0 for r in rows)


def test_class_model_is_a_distribution():
    """Of one history all words' and the unseen word's probabilities sum to 1."""
    classes = np.array([1, 2, 2, 5])
    counts = np.array([5.0, 3, 2, 1])
    totals, kinds = np.zeros(brown.CLASSES), np.zeros(brown.CLASSES)
    np.add.at(totals, classes, counts)
    np.add.at(kinds, classes, 1)
    totals[0], kinds[0] = 4, 1
    model = brown.ClassModel(np.log10(np.full((brown.CLASSES, brown.CLASSES), 1 / brown.CLASSES)), totals, kinds, 15, 5, 4)
    for c in range(brown.CLASSES):
        seen = counts[classes == c].tolist() + ([4] if c == 0 else [])
        assert sum(10.0 ** model.emission(np.array([*seen, 0.0]), np.full(len(seen) + 1, c))) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return BPE(f.read()), Tokenizer.from_file(path)


def test_bpe_contract(spark, bpe):
    texts, lib = given(spark), bpe[1]
    rows = queries.op6_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_bpe_of_odd_texts(bpe):
    own, lib = bpe
    rng = random.Random(1)
    parts = ["a", "B", "é", "é", "ß", "Σ", "ΑΣ ", "İ", " ", "\n", " ", "\x1c", "\x85", "​", "'s", "'LL", "1", "٣", "漢", "😀", "<|startoftext|>", "<|endoftext|>", "<|", "...", "!?", "̇", "ǅ", "ﬁ", "　", "각", "_", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids and own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False), repr(text)
    assert own.encode(None).tolist() == [] and own.decode(None) == "" and own.decode(np.array([320, 10**6])) == own.decode(np.array([320]))
    long = "ab" * 20_000
    assert own.encode(long).tolist() == lib.encode(long, add_special_tokens=False).ids


def test_codec_columns(spark, bpe):
    codec = Codec(spark, public_tokenizers.path("word_bpe_49k.json"))
    ids = docs(spark).select("doc_id", "text", codec.encode(F.col("text")).alias("own"))
    rows = ids.select("doc_id", "text", "own", codec.decode(F.col("own")).alias("back")).collect()
    assert len(rows) == len(ODD) and all(r.own == bpe[1].encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert all(r.back == bpe[1].decode(r.own, skip_special_tokens=False) for r in rows)
    assert docs(spark, []).select(codec.round_trip(F.col("text"))).count() == 0


def test_token_count_contract(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = given(spark)
    for r in queries.op9_token_counts(spark, SF).collect():
        n = len(lib.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)
    counter = TokenCounter(spark, public_tokenizers.path("piece_bpe_32k.model"), chunk=300, overlap=8)
    rows = docs(spark).select("doc_id", "text", counter.count(F.col("text")).alias("own")).collect()
    assert [r.own for r in rows] == [len(lib.encode(r.text or "")) for r in rows]
    assert docs(spark, []).select(counter.count(F.col("text"))).count() == 0


def test_splices_at_every_size():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        own = TokenCounts(f.read())
    rng = random.Random(3)
    parts = ["a", "é", "\n", " ", "字", "😀", "...", "  ", "<s>", "\x00", "▁", "word", " ", " ", " "]
    for _ in range(1500):
        own.chunk, own.overlap = rng.choice([10, 20, 50]), rng.choice([2, 5, 9])
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        assert own.spliced(text) == len(own.lib.encode(text)), repr(text)


def test_language_contract(spark):
    given_lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(given_lang) and {r.doc_id for r in held} == {k for k in given_lang if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r.lang_pred == given_lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    net = langid.fit([("x", "abc abd abe " * 9), ("y", "zzq zzr zzs " * 9)] * 8, epochs=30)
    rows = langid.predict(docs(spark), net, out="guess").collect()
    by = {r.doc_id: r.guess for r in rows}
    assert len(rows) == len(ODD) and all((by[k].lang, by[k].score) == ("und", 0.0) for k in (2, 3, 4, 9)) and by[7].lang in ("x", "y") and rows[0].label == "clash"
    twice = langid.predict(docs(spark, [(1, "zzq zzr " * 5000), (2, "abd abe")]), net, out="guess").collect()
    assert [r.guess.lang for r in twice] == ["y", "x"]
    assert langid.predict(docs(spark, []), net).count() == 0
    none = langid.train(docs(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none.labels == [] and {r.language.lang for r in langid.predict(docs(spark), none).collect()} == {"und"}
    one = langid.fit([("x", "abc")])
    got = langid.predict(docs(spark, [(1, "abc")]), one).first().language
    assert (got.lang, got.score) == ("x", 1.0) and got.other < 0.5
    assert {tuple(r.language) for r in langid.predict(docs(spark), none).collect()} == {("und", 0.0, 1.0)}


STRANGE = {
    "ru": "Сегодня хорошая погода, и люди большого города идут в парк.", "el": "Ο καιρός είναι καλός σήμερα και οι άνθρωποι περπατούν.", "ja": "今日は天気がいいので、みんなで公園を歩いています。",
    "ko": "오늘은 날씨가 좋아서 사람들이 공원을 걷고 있습니다.", "he": "מזג האוויר טוב היום ואנשים הולכים בפארק", "th": "วันนี้อากาศดีและผู้คนเดินเล่นในสวนสาธารณะ",
}


def test_texts_in_strange_scripts_are_not_known(spark):
    """Whatever the number of learnt languages; what those languages' documents hold, short and odd ones too, is known."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    for langs in (["de", "en", "es", "fr"], ["en", "fr"], ["es"]):
        known = base.where(F.col("lang").isin(langs))
        net = langid.train(known, F.lit(True))
        both = known.union(spark.createDataFrame([(-i - 1, t, k) for i, (k, t) in enumerate(STRANGE.items())], known.schema))
        told = langid.predict(both, net, out="f").withColumn("known", langid.is_known(F.col("f"), net))
        assert [r.lang for r in told.where("doc_id < 0 AND known").collect()] == []
        assert told.where("doc_id >= 0 AND NOT known AND f.lang != 'und'").count() == 0, langs


def test_repeated_ids_crowd_out_no_language(spark):
    many = spark.range(20_000).select((F.col("id") % 3).alias("doc_id"), F.lit("abc abd abe abc abd").alias("text"), F.lit("x").alias("lang"))
    few = spark.range(4000).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("zzq zzr "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 4 == 0, "y").otherwise("z").alias("lang"))
    for shift in range(4):
        both = many.union(few).withColumn("doc_id", F.col("doc_id") + 1000 * shift)
        assert langid.train(both, F.lit(True), per_lang=40, epochs=1).labels == ["x", "y", "z"]
    copies = spark.range(800).select(F.lit(7).alias("doc_id"), F.lit("one").alias("text"), F.lit("x").alias("lang")).union(few.where("doc_id < 60"))
    taught = []
    try:
        own, langid.fit = langid.fit, lambda samples, *_: taught.append(samples)
        langid.train(copies, F.lit(True), per_lang=20)
    finally:
        langid.fit = own
    assert sum(lang == "x" for lang, _ in taught[0]) == 3 and sum(lang == "y" for lang, _ in taught[0]) == 3 * 13 and sum(lang == "z" for lang, _ in taught[0]) == 3 * 20


def test_windows_cover_the_text():
    data = bytes(range(256)) * 5
    w = langid.windows(data)
    assert bytes(np.concatenate([w[:, : langid.STEP].ravel(), w[-1, langid.STEP :]]))[: len(data)] == data and len(langid.windows(b"")) == 1


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


@pytest.fixture(scope="module")
def secrets(spark):
    return secret_scan.SecretModel.train(secret_scan.samples(spark))


def test_secret_contract(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op10_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_secrets_in_odd_texts(spark, secrets):
    key = "Zq3xT7vB9mKw2RfLp8Ys"
    texts = [None, "", "PassWord : 'abc' token=abcdef secret=token:abcdef1234", "AKIA" + "X" * 15, "AKIA" + "X" * 16 + "é", "é" * 9 + " " + "ab12" * 6, f"see {key} 😀 {key}", "get_user_account_number_2024_total_count", "TOKEN=" + "a" * 5000, " ".join(["deadbeef" * 3, "é"] * 1500), "token==x" * 3]
    rows = secret_scan.find_secrets(docs(spark, list(enumerate(texts))), secrets).collect()
    for r in rows:
        assert [(s.start, s.kind, s.stop) for s in r.secrets if s.kind < 3] == base_spans(r.text or "")
        assert all(r.text[s.start : s.stop] == s.text for s in r.secrets) and r.start == "clash"
    assert [(s.kind, s.text) for s in rows[6].secrets] == [(3, key), (3, key)] and rows[7].secrets == []
    clean = secret_scan.find_secrets(docs(spark, [(1, f"a {key} b token=abcdef c"), (2, "nothing"), (3, None)]), secrets).select(secret_scan.redact(F.col("text"), F.col("secrets")).alias("t")).collect()
    assert [r.t for r in clean] == ["a [SECRET] b [SECRET] c", "nothing", None]
    assert secret_scan.find_secrets(docs(spark, []), secrets).count() == 0


def plain_redaction(text, spans):
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_many_spans_in_long_texts(spark, secrets):
    """Spans that overlap and touch, at and around the places where texts and arrays are cut."""
    rng = random.Random(4)
    parts = ["deadbeef" * 3, "0123456789abcdef01234567api_key=abcdef", "token: " + "AKIA" + "Q" * 16, "é😀 ", "word ", "Zq3xT7vB9mKw2RfLp8Ys", "\n", "x" * 300 + " ", "secret='" + "ab12" * 70 + "'"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 2, 3, 64, 65, 200, 700)]
    rows = secret_scan.find_secrets(docs(spark, list(enumerate(texts))), secrets).withColumn("clean", secret_scan.redact(F.col("text"), F.col("secrets"))).collect()
    for r in rows:
        spans = [(s.start, s.stop) for s in r.secrets]
        fixed = base_spans(r.text)
        assert [(s.start, s.kind, s.stop) for s in r.secrets if s.kind < 3] == fixed
        for s in r.secrets:
            assert r.text[s.start : s.stop] == s.text and (s.kind < 3 or not any(a < s.stop and s.start < b for a, _, b in fixed))
        assert r.clean == plain_redaction(r.text, spans)


def test_time_grows_with_the_text_alone(spark, secrets):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"{i:08x}" * 4 for i in range(n)))], "doc_id long, text string")
        found = secret_scan.find_secrets(df, secrets).select(F.size("secrets").alias("n"), F.length(secret_scan.redact(F.col("text"), F.col("secrets"))).alias("left"))
        begin = time.time()
        assert tuple(found.first()) == (n, 9 * n - 1)
        return time.time() - begin

    seconds(100)
    assert seconds(32_000) < 12 * max(seconds(8000), 0.2)  # 16 times as long if all pairs of spans met


NEVER_TAUGHT = "abbey acorn anvil apron bacon badge basil beach berry bison blaze bonus boots brick broom cabin camel candy canoe cargo cedar chalk cider cliff cocoa coral couch daisy denim diary dizzy eagle elbow ember fable ferry flute frost gauge ghost glove grape hazel honey igloo ivory jelly jewel juice kayak koala lemon lilac llama lunar mango maple melon moose noble novel oasis ocean olive onion otter panda peach pearl piano plaza poppy quilt raven river robin salad scarf shelf siren spoon squid storm sugar table tiger topaz trout tulip vapor velvet violin walnut whale zebra".split()


def test_markov_models_tell_unseen_samples_apart(spark, secrets):
    """Keys and names that training never saw, the names of words it never saw either."""
    assert not set(NEVER_TAUGHT) & set(secret_scan.WORDS)
    fresh = secret_scan.samples(spark, 12_000, NEVER_TAUGHT, 1_000_000, made=False).where(F.length("text") >= 20).select("random", secrets.score(F.col("text")).alias("s"))
    r = fresh.groupBy("random").agg(F.avg((F.col("s") >= secrets.threshold).cast("int")).alias("share")).collect()
    share = {x.random: x.share for x in r}
    assert share[True] > 0.97 and share[False] < 0.01
    plain = secret_scan.SecretModel.train(spark.createDataFrame([(None, True), ("x", None), ("ab", True), ("cd", False)], "text string, random boolean"))
    got = spark.createDataFrame([("ab",), ("cd",), ("a",), ("",)], "t string").select(plain.score(F.col("t"))).collect()
    assert got[0][0] > 0 > got[1][0] and got[2][0] == got[3][0] == 0


def test_native_operators_run_no_python(spark):
    for name in ("op5_document_fingerprints", "op10_secret_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages(spark):
    key = "ab12" * 8
    base = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    text = " ".join(f"the{i} and of to" for i in range(60))
    planted = [(9001, text, "en", "src0", 1), (9002, text + " more", None, "src1", 1), (9003, None, "en", "src0", 1), (9004, "123 456", "en", None, 1), (9005, f"here is the token={key} of the", "en", "src2", 1), (9006, "", "en", "src2", 1), (None, "the and of to in that is was for it with as", "en", None, None)]
    d = base.unionByName(spark.createDataFrame(planted, base.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        d = materialize(stage(spark, d, SF), name)
        seen[name] = d
        assert name == "bpe" or d.columns == COLUMNS
    ids = {n: {r.doc_id for r in x.select("doc_id").collect()} for n, x in seen.items()}
    assert not {9003, 9004, 9006} & ids["language_id"] and {9001, 9002, 9005, None} <= ids["language_id"] and seen["language_id"].where("lang IS NULL").count() == 0
    assert 9001 in ids["near_dedup"] and 9002 not in ids["near_dedup"] and seen["near_dedup"].count() == len(ids["near_dedup"])
    clean = seen["secret_scan"].where("doc_id = 9005").first()
    assert ids["secret_scan"] == ids["near_dedup"] and clean.text == "here is the [SECRET] of the" and clean.n_chars == len(clean.text)
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))).alias("n")).collect()}
    before, after = words(seen["secret_scan"]), words(seen["mix_sources"])
    assert sum(after.values()) == pytest.approx(1.5 * sum(before.values()), rel=0.01) and all(after[s] <= 2 * before[s] for s in after)
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = seen["mix_sources"].collect()
    assert Counter(tuple(own.encode(r.text, add_special_tokens=False).ids) for r in mixed) == Counter(tuple(r.ids) for r in seen["bpe"].collect())


def test_pipeline_beside_other_columns(spark):
    """Columns named like the stages' own, nulls in all of them, no n_chars; texts and decisions are those without."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = base.select("doc_id", "text", "lang", "source", *[F.when(F.col("doc_id") % 2 == 0, F.lit("own")).alias(c) for c in ("found", "Found_", "uid", "grp", "_mix_parts", "_mix_h", "language", "_secrets", "id", "hash", "words")])
    plain = base
    for name, stage in corpus_pipeline.STAGES:
        plain, odd = materialize(stage(spark, plain, SF), "plain"), materialize(stage(spark, odd, SF), "odd")
        if name != "bpe":
            assert odd.count() == odd.where("(doc_id % 2 = 0) = (found IS NOT NULL) AND (doc_id % 2 = 0) = (_mix_h IS NOT NULL)").count() > 0
        shared = [c for c in plain.columns if c in odd.columns]
        assert sorted(map(str, plain.select(*shared).collect())) == sorted(map(str, odd.select(*shared).collect())), name


def test_pipeline_of_nothing(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        d = materialize(stage(spark, d, SF), name)
        assert d.count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and [n for n, _ in corpus_pipeline.STAGES][-1] == "bpe"
