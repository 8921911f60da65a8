"""Repair of conversation structure: faults of turns, and the cheapest edits after which the roles follow a pattern.

Roles must read ``(s?(ua)+)?`` by their first letters. A fold over a conversation's turns
carries, for each of the pattern's four states, the cheapest way to get there: a struct of
its cost, the edits' letters and what they make, so that ``least`` picks the cheaper one and
of equals the one whose letters come first. All of it is higher-order functions of Spark SQL.

A conversation is cut into segments of at most 1,024 turns, which are folded for themselves,
from each state in which they may begin; then the segments are folded in their order. So a
conversation of any length is dealt over tasks like the rest. Equal turns of one conversation
and number are one row with a count from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxmark.llm.common import TEXTS, crc_of, let, materialize

#: Turns of a segment, as a power of two; segments that are folded at a time.
SEGMENT, FAN = 10, 64
#: What edits cost: another role, no such turn, a new turn, a turn that breaks off and stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The pattern's states: nothing yet, after s, after u, after a. It may end in the first and the last.
STATES = range(4)
FAR = 1 << 40  # the cost of a state that is out of reach
BLANKS = " \t\n\x0b\x0c\r"
NO_TEXT = hashlib.sha256(b"").hexdigest()


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` as a faulty export might bring them: by the checksum of ``conv:turn`` modulo 20 a turn is dropped (0), emptied
    (1), loses its end marks (2), comes twice (3) or is the user's (4). Nulls count as one space, in roles and texts for good.
    Other columns are left out."""
    fate = crc_of(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn))), 20)
    told = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), fate.alias("fate")).where("fate != 0")
    worse = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return told.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), worse.alias("text"), copies.alias("copy")).drop("copy")


def _way(cost: Column, audit: Column, path: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), path.alias("path"))


def _more(way: Column, cost, edit: str, made: str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(edit)), F.concat(way["path"], F.lit(edit + made)))


def _four(ways: list[Column]) -> Column:
    return F.struct(*(w.alias(f"s{i}") for i, w in enumerate(ways)))


def _of(four: Column) -> list[Column]:
    return [four[f"s{i}"] for i in STATES]


def _with_inserts(four: Column) -> Column:
    """New turns after what is there: a user's, an assistant's or both."""
    v = _of(four)
    user = let(F.least(v[2], _more(F.least(v[0], v[1], v[3]), INSERT, "I", "u")), lambda w: F.array(w, F.least(v[3], _more(w, INSERT, "I", "a"))))
    return let(user, lambda both: _four([v[0], v[1], both[0], both[1]]))


def _after(four: Column, turn: Column) -> Column:
    """The cheapest ways over one more turn, its copies and what is inserted behind it."""
    v, late = _of(four), F.when(turn["truncated"], TRUNCATED).otherwise(0)
    before_user = F.least(v[0], v[1], v[3])

    def kept(way: Column, initial: str) -> Column:
        return F.when(~turn["must_go"] & (turn["initial"] == initial), _more(way, late, "K", initial))

    def given(way: Column, initial: str) -> Column:
        return F.when(~turn["must_go"], _more(way, REROLE + late, "R", initial))

    gone = [_more(w, DELETE, "D", "-") for w in v]
    ways = [gone[0], F.least(gone[1], kept(v[0], "s")), F.least(gone[2], kept(before_user, "u"), given(before_user, "u")), F.least(gone[3], kept(v[2], "a"), given(v[2], "a"))]
    again = turn["copies"] - 1  # only the first of equal turns may stay; their letters are not in the path
    repeated = lambda w: _way(w["cost"] + DELETE * again, F.concat(w["audit"], F.repeat(F.lit("D"), again.cast("int"))), w["path"])
    return let(let(_four(ways), lambda x: _four([repeated(w) for w in _of(x)])), _with_inserts)


def _from_state(state: Column) -> Column:
    return _with_inserts(_four([_way(F.when(state == i, 0).otherwise(FAR), F.lit(""), F.lit("")) for i in STATES]))


def _folded(turns: Column, state: Column) -> Column:
    return F.aggregate(turns, _from_state(state), _after)


def _joined(four: Column, rows: Column) -> Column:
    """Ways up to a segment and then through it; ``rows``: for each state before it, the ways through."""
    v = _of(four)
    through = [[rows[i][f"s{j}"] for i in STATES] for j in STATES]
    both = lambda a, b: _way(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"]), F.concat(a["path"], b["path"]))
    return _four([F.least(*(both(v[i], through[j][i]) for i in STATES)) for j in STATES])


def _name(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


class Repair:
    """The faults and the cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text).

    A conversation's turns are ordered by turn (nulls first), role and text. Nulls in role
    and text count as one space; rows without conv_id are one conversation; equal rows are
    copies of each other, of which all but the first are duplicates. A turn has one fault:
    it is blank (nothing but ASCII white space), or a duplicate (role and text were there
    before in the conversation), or truncated (its last character that is no white space is
    not one of ``.!?``). Keeping a turn costs 0, giving it the user's or assistant's role 2,
    deleting it 3, which blank and duplicate turns must be, a new empty turn of either role 2,
    a truncated turn that stays 1 more. Role initials are the first characters; others than
    s, u and a cannot stay. Other columns are ignored, no rows give none.

    ``conversations``: conv_id, gaps (numbers missing between the least and the greatest turn),
    blank, duplicate, truncated, illegal (neighbours whose initials are not su, ua or au), cost
    and audit (the letters of Keep, Rerole, Delete, Insert in order; of equally cheap ones the
    first in ASCII). ``turns()``: the repaired turns. Equal texts are told by 128-bit digests.
    One conversation's audit, a letter a turn, must fit into a task.
    """

    def __init__(self, rows: DataFrame):
        self.id_type = rows.schema["conv_id"].dataType
        nothing = F.lit(" ")
        own = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), nothing).alias("who"), "turn", F.coalesce("role", nothing).alias("role"), F.coalesce("text", nothing).alias("text"))
        single = own.groupBy("who", "turn", "role", "text").agg(F.count("*").alias("copies"))
        keys = ["who", F.asc_nulls_first("turn"), "role", F.left("text", F.lit(64))]
        last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
        ordered = single.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").withColumn("last", last)
        self.rows = materialize(ordered.select("who", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "copies", F.left("role", F.lit(1)).alias("initial"), (F.col("last") == "").alias("blank"), (~F.col("last").isin(*".!?")).alias("open"), F.unhex(F.md5("text")).alias("digest")), "turns")
        self.flags = self._flags()
        segments = self._segments()
        self.starts = segments.select("who", "seg", "begin")
        self.conversations = self._conversations(segments)

    def _flags(self) -> DataFrame:
        """Every row with its faults; only a segment's firsts of equal turns are compared with those of other segments."""
        light = self.rows.select("who", "at", F.shiftright("at", SEGMENT).alias("seg"), "turn", "role", "copies", "initial", "blank", "open", "digest")
        same, place = Window.partitionBy("who", "seg", "role", "digest").orderBy("at"), Window.partitionBy("who", "seg").orderBy("at")
        seen = light.withColumn("again", F.row_number().over(same) > 1)
        anywhere = Window.partitionBy("who", "role", "digest", F.when(F.col("again"), F.col("at"))).orderBy("at")
        seen = seen.withColumn("again", F.col("again") | (F.row_number().over(anywhere) > 1))
        pair = F.concat(F.lag("initial").over(place), "initial")
        known = F.coalesce(F.lag("turn").over(place) == F.col("turn"), F.lit(False))
        flags = seen.select("who", "at", "seg", F.row_number().over(place).alias("nth"), "turn", "initial", "copies", "blank", "again", (F.col("open") & ~F.col("blank") & ~F.col("again")).alias("truncated"),
            (F.col("turn").isNotNull() & ~known).alias("new_turn"), (F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("long") + F.col("copies") - 1).alias("illegal"))
        return materialize(flags, "flags")

    def _segments(self) -> DataFrame:
        count = lambda c: F.sum(F.when(c, 1).otherwise(0))
        turn = F.struct("at", "initial", "copies", (F.col("blank") | F.col("again")).alias("must_go"), "truncated")
        sums = {
            "blank": F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)), "duplicate": F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1)),
            "truncated": count(F.col("truncated")), "illegal": F.sum("illegal"), "numbers": count(F.col("new_turn")), "low": F.min("turn"), "high": F.max("turn"), "size": F.count("*"),
            "head": F.min_by("initial", "at"), "tail": F.max_by("initial", "at"), "head_turn": F.min_by("turn", "at"), "tail_turn": F.max_by("turn", "at"), "turns": F.array_sort(F.collect_list(turn)),
        }
        own = self.flags.groupBy("who", "seg").agg(*(c.alias(k) for k, c in sums.items()))
        place = Window.partitionBy("who").orderBy("seg")
        pair = F.concat(F.lag("tail").over(place), "head")
        own = own.select("who", "seg", (F.row_number().over(place) - 1).cast("long").alias("nth"), F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"),
            "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("long")).alias("illegal"),
            (F.col("numbers") - F.coalesce(F.lag("tail_turn").over(place) == F.col("head_turn"), F.lit(False)).cast("long")).alias("numbers"), "low", "high", "turns")
        states = F.when(F.col("nth") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, STATES)))
        return materialize(own.withColumn("ways", F.transform(states, lambda s: _folded(F.col("turns"), s))).drop("turns"), "segments")

    def _conversations(self, segments: DataFrame) -> DataFrame:
        ways = segments.select("who", "nth", "ways")
        while (ways.agg(F.max("nth")).first()[0] or 0) > 0:
            parts = ways.groupBy("who", F.floor(F.col("nth") / FAN).alias("nth")).agg(F.array_sort(F.collect_list(F.struct("nth", "ways"))).alias("parts"))
            rest = F.expr("slice(parts, 2, greatest(size(parts) - 1, 0))")
            through = F.transform(F.col("parts")[0]["ways"], lambda four: F.aggregate(rest, four, lambda a, p: _joined(a, p["ways"])))
            ways = materialize(parts.select("who", "nth", through.alias("ways")), "ways")
        sums = segments.groupBy("who").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "numbers")), F.min("low").alias("low"), F.max("high").alias("high"))
        best = ways.select("who", F.least(F.col("ways")[0]["s0"], F.col("ways")[0]["s3"]).alias("best"))
        told = sums.join(best, "who").withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0)))
        return materialize(told.select(self._id(), "who", F.col("gaps").cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.path"), "repairs")

    def _id(self) -> Column:
        return F.when(F.col("who") != " ", F.substring("who", 2, 1 << 30).cast(self.id_type)).alias("conv_id")

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, who (its text form), place and part (which order them), edit (K, R or I), role, text."""
        letters = F.regexp_extract_all("path", F.lit("(?:I.)*[KRD].|(?:I.)+"), 0)
        pieces = self.conversations.select("who", F.posexplode(letters).alias("place", "piece"))
        places = self.flags.select("who", "seg", "at", "nth").join(self.starts, ["who", "seg"]).select("who", "at", (F.col("begin") + F.col("nth") - 1).cast("int").alias("place"))
        edited = pieces.join(places, ["who", "place"], "left").join(self.rows.select("who", "at", "role", "text"), ["who", "at"], "left")
        edit, initial = (F.regexp_extract("piece", "([KRD])(.)$", i) for i in (1, 2))
        turn = lambda e, role, text: F.struct(e.alias("edit"), role.alias("role"), text.alias("text"))
        new = F.transform(F.regexp_extract_all("piece", F.lit("I(.)"), 1), lambda r: turn(F.lit("I"), _name(r), F.lit("")))
        own = F.when(edit.isin("K", "R"), F.array(turn(edit, F.when(edit == "K", F.col("role")).otherwise(_name(initial)), F.col("text")))).otherwise(F.array().cast("array<struct<edit:string,role:string,text:string>>"))
        return edited.select(self._id(), "who", "place", F.posexplode(F.concat(new, own)).alias("part", "turn")).select("conv_id", "who", "place", "part", "turn.*")

    def digests(self) -> DataFrame:
        """Per conversation with a repaired turn, by its ``who``: the SHA-256 of its ``role:text`` lines. Lines are hashed as they
        come, so no task holds a conversation."""
        lines = self.turns().select("who", "place", "part", F.concat("role", F.lit(":"), "text").alias("line"))
        dealt = lines.repartition("who").sortWithinPartitions("who", "place", "part").select("who", F.col("line").cast("binary").alias("line"))
        return materialize(dealt.mapInPandas(_hashed, "who string, sha256 string"), "digests", TEXTS)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, digest = None, None
    for pdf in batches:
        out = []
        for who, line in zip(pdf["who"], pdf["line"], strict=True):
            if who == now:
                digest.update(b"\n")
            else:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = who, hashlib.sha256()
            digest.update(line)
        yield pd.DataFrame(out, columns=["who", "sha256"], dtype=object)
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["who", "sha256"])


def repaired(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` beside the repair of its ``damaged`` rows and the digest of what the repair makes.

    An id without damaged rows has zeros, no edits and the digest of no text; a null id counts as one."""
    repair = Repair(damaged)
    ids = conversations.select("conv_id").distinct().withColumn("who", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" ")))
    found = ids.join(repair.conversations.drop("conv_id"), "who", "left").join(repair.digests(), "who", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(NO_TEXT)).alias("repaired_sha256"))


def _sql() -> str:
    """What ``repaired(conversations, damage(conversations))`` returns, in DuckDB's SQL: turns one by one, a way is its cost in nine digits and its letters."""

    def more(way: str, cost: str, edit: str) -> str:
        return f"lpad(CAST(CAST(substr({way}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{edit}'"

    to_user = "least(f.s0, f.s1, f.s3)"
    late = "(CASE WHEN r.truncated THEN 1 ELSE 0 END)"
    kept = lambda way, initial: f"CASE WHEN NOT r.must_go AND r.initial = '{initial}' THEN {more(way, late, 'K')} END"
    given = lambda way: f"CASE WHEN NOT r.must_go THEN {more(way, '2 + ' + late, 'R')} END"
    gone = lambda i: more(f"f.s{i}", "3", "D")
    return f"""
        WITH RECURSIVE coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS fate FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE fate <> 0),
        ordered AS (SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER w AS n FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        told AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
        turns AS (SELECT *, blank OR again AS must_go, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM told),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
            count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS size FROM turns GROUP BY conv_id),
        f AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS s0, '500000000' AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM sums
            UNION ALL SELECT conv_id, n, s0, s1, s2, least(s3, {more("s2", "2", "I")}) FROM (
                SELECT conv_id, n, s0, s1, least(s2, {more("least(s0, s1, s3)", "2", "I")}) AS s2, s3 FROM (
                    SELECT f.conv_id, r.n, {gone(0)} AS s0, least({gone(1)}, {kept("f.s0", "s")}) AS s1, least({gone(2)}, {kept(to_user, "u")}, {given(to_user)}) AS s2, least({gone(3)}, {kept("f.s2", "a")}, {given("f.s2")}) AS s3
                    FROM f JOIN turns r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = f.n + 1) AS stepped) AS widened),
        best AS (SELECT conv_id, substr(least(s0, s3), 10) AS audit, CAST(substr(least(s0, s3), 1, 9) AS BIGINT) AS cost FROM f JOIN sums USING (conv_id) WHERE f.n = sums.size
            UNION ALL SELECT NULL, substr(least(s0, s3), 10), CAST(substr(least(s0, s3), 1, 9) AS BIGINT) FROM f, sums WHERE f.conv_id IS NULL AND sums.conv_id IS NULL AND f.n = sums.size),
        g AS (SELECT conv_id, audit, 0 AS j, CAST(0 AS BIGINT) AS n, '' AS last, '' AS made FROM best
            UNION ALL SELECT conv_id, audit, j, n, CASE edit WHEN 'D' THEN last WHEN 'K' THEN initial WHEN '' THEN last ELSE left(given, 1) END,
                made || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || given || ':' || text ELSE chr(10) || given || ':' END
            FROM (SELECT g.conv_id, g.audit, g.j + 1 AS j, g.n + CASE WHEN substr(g.audit, g.j + 1, 1) = 'I' THEN 0 ELSE 1 END AS n, g.last, g.made, substr(g.audit, g.j + 1, 1) AS edit, r.role, r.text, r.initial, CASE WHEN g.last = 'u' THEN 'assistant' ELSE 'user' END AS given
                FROM g LEFT JOIN turns r ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = g.n + 1 AND substr(g.audit, g.j + 1, 1) <> 'I' WHERE g.j < length(g.audit)) AS one),
        done AS (SELECT conv_id, cost, audit, sha256(substr(made, 2)) AS sha FROM g JOIN best USING (conv_id, audit) WHERE j = length(audit)
            UNION ALL SELECT NULL, cost, audit, sha256(substr(made, 2)) FROM g JOIN best USING (audit) WHERE j = length(audit) AND g.conv_id IS NULL AND best.conv_id IS NULL)
        SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums ON i.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN done ON i.conv_id IS NOT DISTINCT FROM done.conv_id"""


#: DuckDB's SQL for the repair of the table ``conversations`` after damage.
SQL = _sql()
