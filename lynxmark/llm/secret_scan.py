"""Secrets in texts: fixed patterns, and runs that a character Markov model holds for random. DataFrame functions only.

Two first-order Markov models over ASCII characters are counted from labelled samples: one
of random strings, one of ordinary identifiers. A run of key-like characters is a secret if
its log-likelihood ratio of random to ordinary is high enough.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark.llm.common import let, running

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy and whole, so their least lengths can stand in the pattern itself.
ACCESS, HEX, RUN = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
SIZE = 128
#: Code points of a text that are cut at once.
CHUNK = 256
#: Halvings that find a place among 2**30 spans.
STEPS = [1 << b for b in reversed(range(30))]
SPAN = "array<struct<start:int,kind:int,stop:int,text:string>>"

#: Words of ordinary identifiers, from which the built-in samples are put together; samples() takes any others.
WORDS = """account active admin amount async balance batch begin body border bucket build bytes call card category channel check city clean clock cluster color comment common connect constant context convert copy country current custom date default depth device disable document double driver empty encode entry event execute export factory feature file final flag footer frame future global group hash height history host import info input instance internal item join key language layer left level limit link load lock login main map master maximum memory message metric minimum module mutable name network node notify number offset operator order output package panel parse patch pattern person pixel player policy position prefix primary process profile property public queue range reader refresh register remote render report reset response return role route rule scale scope script second select sequence service setting share signal single sort space start static step store string submit summary system target template text time toggle total track tree type unit upload user utility value version visible warning width worker year""".split()


#: The rule by which samples() makes further words, such as may stand in any name: a beginning, a vowel, a close, an ending.
PARTS = [x.split(",") for x in ("b,bl,br,c,ch,cl,cr,d,dr,f,fl,fr,g,gl,gr,h,j,k,l,m,n,p,ph,pl,pr,qu,r,s,sc,sh,sk,sl,sm,sn,sp,st,str,sw,t,th,tr,tw,v,w,wh,y,z,", "a,e,i,o,u,ai,au,ea,ee,io,oa,oo,ou,ow,y", ",b,bb,c,ck,ct,d,dd,ft,g,gg,l,ld,ll,lt,m,mm,mp,n,nd,ng,nn,nt,p,pp,r,rd,rg,rk,rm,rn,rr,rt,s,sh,sk,sp,ss,st,t,th,tt,v,x,zz", ",a,al,e,el,en,er,et,ic,in,it,le,o,on,or,y")]


def _made_word(seed: Column) -> Column:
    return F.concat(*[F.element_at(F.array(*map(F.lit, part)), (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(len(part))) + 1).cast("int")) for i, part in enumerate(PARTS)])


def samples(spark: SparkSession, n: int = 20_000, words: list[str] | None = None, first: int = 0, made: bool = True) -> DataFrame:
    """Labelled samples (text, random boolean), made from hashes of row numbers from ``first`` on: keys in several alphabets, and names in several styles, of ``words`` and, if ``made``, of as many made by rule."""
    given = words or WORDS
    words = F.split(F.lit(" ".join(given)), " ")
    bits = [F.sha2(F.concat(F.lit(f"{i}:"), F.col("id").cast("string")), 256) for i in range(3)]
    raw = F.unhex(F.concat(*bits[:2]))
    b64 = F.substring(F.base64(raw), F.lit(1), (20 + F.col("id") % 44).cast("int"))
    plain = F.regexp_replace(b64, "[+/=]", "")
    key = F.element_at(F.array(b64, plain, F.upper(plain), F.lower(plain), F.translate(b64, "+/=", "-_"), F.substring(bits[0], F.lit(1), (24 + F.col("id") % 40).cast("int"))), (F.col("id") % 6 + 1).cast("int"))
    count = (2 + F.col("id") % 5).cast("int")
    listed_word = lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(given))) + 1).cast("int"))
    chosen = F.transform(F.sequence(F.lit(1), count), lambda i: F.when(F.lit(made) & (F.pmod(F.xxhash64(i, F.col("id")), F.lit(2)) == 0), _made_word(F.xxhash64(F.col("id"), i, F.lit(2)))).otherwise(listed_word(i)))
    number = F.when(F.xxhash64("id") % 3 == 0, (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4000))).cast("string")).otherwise(F.lit(""))
    joined = F.element_at(F.array(F.array_join(chosen, "_"), F.array_join(F.transform(chosen, F.initcap), ""), F.array_join(chosen, "-"), F.upper(F.array_join(chosen, "_")), F.array_join(chosen, "/"), F.array_join(chosen, "")), (F.col("id") % 6 + 1).cast("int"))
    ids = spark.range(first, first + n)
    return ids.select(key.alias("text"), F.lit(True).alias("random")).union(ids.select(F.concat(joined, number).alias("text"), F.lit(False).alias("random")))


class SecretModel:
    """Log-likelihood ratios of character pairs, random against ordinary: SIZE x SIZE numbers, whatever the samples' number."""

    def __init__(self, ratios: list[float], threshold: float = 12.0):
        self.ratios, self.threshold = ratios, threshold

    @classmethod
    def train(cls, labelled: DataFrame, text_col: str = "text", label_col: str = "random", smooth: float = 0.2, threshold: float = 12.0) -> SecretModel:
        """Counts neighbouring characters by label; null texts and labels teach nothing, characters beyond ASCII are one."""
        codes = F.transform(F.split(F.col(text_col), ""), lambda c: F.least(F.ascii(c), F.lit(SIZE - 1)))
        pairs = labelled.where(F.col(label_col).isNotNull() & (F.length(text_col) > 1)).select(F.col(label_col).alias("r"), codes.alias("c"))
        pairs = pairs.select("r", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * SIZE + F.get("c", i))).alias("pair"))
        counts = {True: [smooth] * SIZE * SIZE, False: [smooth] * SIZE * SIZE}
        for row in pairs.groupBy("r", "pair").count().collect():  # at most 2 x SIZE x SIZE rows
            counts[row["r"]][row["pair"]] += row["count"]
        whole = {r: [sum(c[a * SIZE : (a + 1) * SIZE]) for a in range(SIZE)] for r, c in counts.items()}
        logs = {r: [math.log(x / whole[r][i // SIZE]) for i, x in enumerate(c)] for r, c in counts.items()}
        return cls([round(a - b, 4) for a, b in zip(logs[True], logs[False], strict=True)], threshold)

    def score(self, text: Column) -> Column:
        """The log-likelihood ratio (double) of a string; 0 for one shorter than two characters."""
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        codes = F.transform(F.split(text, ""), lambda c: F.least(F.ascii(c), F.lit(SIZE - 1)))
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        step = lambda at, c: F.struct(c.alias("last"), (at["sum"] + F.when(at["last"] < 0, 0.0).otherwise(F.get(table, at["last"] * SIZE + c))).alias("sum"))
        return F.aggregate(codes, start, step)["sum"]


def _spans(text: Column, pattern: str, kind: int, least: int | None = None) -> Column:
    """Leftmost matches that do not overlap; with ``least``, those whose second group is that long."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)

    def place(matches: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), F.length)
        starts = running(F.zip_with(F.slice(between, 1, F.size(matches)), F.transform(matches, F.length), lambda gap, n: gap + n), lambda at, n: at + n)
        ends = F.zip_with(starts, between, lambda s, gap: s + gap)
        spans = F.zip_with(matches, F.slice(ends, 1, F.size(matches)), lambda m, at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("stop"), m.alias("text")))
        if least is not None:
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            long = F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= least, s))
            spans = F.filter(long, lambda s: s.isNotNull())
        return spans.cast(SPAN)

    return let(whole, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))


def find_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a column ``out``: array of (start, kind, stop, text) by start, then kind.

    Kinds number KINDS: three of fixed patterns, found as they stand, and "random": runs of
    20 or more key-like characters with a letter and a digit, outside the fixed ones, whose
    ratio reaches the model's threshold. Offsets are code points, ends exclusive. Null and
    empty texts have none; all other columns, whatever their names, and repeated rows stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.struct(_spans(text, ASSIGN, 0, 6).alias("assign"), _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"))

    def judged(found: Column) -> Column:
        kinds = [found["assign"], found["access"], found["hex"]]
        keylike = lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")
        free = lambda s: ~reduce(or_, (_touched(spans, s) for spans in kinds))
        more = F.filter(_spans(text, RUN, 3), lambda s: keylike(s) & free(s) & (model.score(s["text"]) >= model.threshold))
        return F.sort_array(F.concat(*kinds, more))

    return docs.withColumn(out, let(base, judged))


def _touched(spans: Column, s: Column) -> Column:
    """Does a span overlap one of ``spans``, which are in order and apart? Only the last one that starts before its end can."""
    before = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda at, n: F.when((at + n <= F.size(spans)) & (F.get(spans, at + n - 1)["start"] < s["stop"]), at + n).otherwise(at))
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(F.get(spans, before - 1)["stop"] > s["start"], F.lit(False)))


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones together, replaced by ``mark``; null stays null. Spans are in order.

    The text is cut into chunks once and each gap put together from its own chunks, so that time grows with the text and
    the number of spans, not with their product.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def between(parts: Column, low: Column, high: Column) -> Column:
        first = F.floor(low / CHUNK).cast("int")
        some = F.slice(parts, first + 1, F.floor((high - 1) / CHUNK).cast("int") - first + 1)
        return F.when(high > low, F.substring(F.array_join(some, ""), low - first * CHUNK + 1, high - low)).otherwise(F.lit(""))

    def cut(parts: Column) -> Column:
        reach = running(F.transform(secrets, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
        last = F.array_max(F.transform(secrets, lambda s: s["stop"]))
        gaps = F.filter(F.zip_with(secrets, reach, lambda s, r: F.when(s["start"] >= r, F.struct(r.alias("low"), s["start"].alias("high")))), lambda g: g.isNotNull())
        tail = F.array(F.struct(last.alias("low"), F.length(text).alias("high")))
        return F.array_join(F.transform(F.concat(gaps, tail), lambda g: between(parts, g["low"], g["high"])), mark)

    return F.when(F.size(secrets) > 0, let(chunks, cut)).otherwise(text)


def listed(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
