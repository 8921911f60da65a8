"""Conversation repair beside a search over all edits, with odd rows among them."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lynxmark.llm import conversations, queries
from tests.oracle import difference

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit) of the cheapest edits by a search from the end; rows of (role, must_go, truncated)."""
    into = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def rest(i, state, inserts):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, ""))
        else:
            role, must_go, late = rows[i]
            found.append((3, "D", i + 1, state, 0))
            if not must_go:
                if (state, role[:1]) in into:
                    found.append((late, "K", i + 1, into[state, role[:1]], 0))
                found += [(2 + late, "R", i + 1, into[state, x], 0) for x in "ua" if (state, x) in into]
        if inserts < 2:
            found += [(2, "I", i, into[state, x], inserts + 1) for x in "ua" if (state, x) in into]
        out = []
        for x in found:
            if len(x) == 2:
                out.append(x)
            elif (y := rest(*x[2:])) is not None:
                out.append((x[0] + y[0], x[1] + y[1]))
        return min(out) if out else None

    return rest(0, 0, 0)


def brute(rows):
    """What ``repaired`` says of one conversation's damaged rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2].encode()))
    seen, flags, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        flags.append((role, kind in ("blank", "duplicate"), int(kind == "truncated")))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest(tuple(flags))
    lines, last, todo = [], "", list(rows)
    for edit in audit:
        role = "assistant" if last == "u" else "user"
        _, own, text = todo.pop(0) if edit != "I" else (None, "", "")
        if edit != "D":
            lines.append((own if edit == "K" else role, text))
            last = lines[-1][0][:1]
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    return gaps, *counts.values(), illegal, cost, audit, lines


def some_rows(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Fine.", "Cut off", "What?", "", " \n", None, "End.\x85", "So!\t\n", "Fine. ", "long " * 3000 + "."]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, 7, None]), rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 9]), rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts)) for _ in range(n)]
    rows += [(8, i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(40)] + [(9, None, "user", "Same.")] * 12 + [(10, 3, "system", "Alone.")]
    return rows + rows[:5]


@pytest.mark.parametrize("segment, fan", [(10, 64), (1, 2)])
def test_repair_beside_brute_force(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = some_rows(90, segment)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("who", "at", "seg", "place", "copies", "path", "begin"):
        df = df.withColumn(c, F.lit("clash"))
    repair = conversations.Repair(df)
    made = {}
    for r in repair.turns().orderBy("place", "part").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    digests = {r.who: r.sha256 for r in repair.digests().collect()}
    got = {r.conv_id: r for r in repair.conversations.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        gaps, blank, duplicate, truncated, illegal, cost, audit, lines = brute([x for x in rows if x[0] == conv])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, blank, duplicate, truncated, illegal, cost, audit), conv
        assert made.get(conv, []) == lines
        if lines:
            assert digests[r.who] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user", "Is it. So!") for c in range(12) for t in (None, 1, 2)] + [(None, None, None, None)]
    import zlib

    expected = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fate == 0:
            continue
        row = (c, t, "user" if fate == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text))
        expected += [row] * (2 if fate == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = conversations.damage(df)
    key = lambda r: tuple((x is not None, x or 0) if i < 2 else x for i, x in enumerate(r))
    assert sorted(map(tuple, damaged.collect()), key=key) == sorted(expected, key=key)
    none = conversations.repaired(df, damaged.where("false")).collect()
    assert len(none) == 13 and all((r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", conversations.NO_TEXT) for r in none)
    assert conversations.repaired(df.where("false"), damaged.where("false")).count() == 0


def test_same_as_sql(spark, sf):
    assert difference(spark, sf, queries.op11_conversation_repair, queries.ORACLE_SQL["op11_conversation_repair"]) == ""
