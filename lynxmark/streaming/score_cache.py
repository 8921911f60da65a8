"""Scores that are remembered for a while: state a product with an end of life, in a stream.

A stream holds requests (``score`` is null) and fresh scores (it is not). A request is
answered from the state while that lives; else it is a miss, which starts a new life at once,
so that one request of many computes the score: misses are what has to be scored again, and
what that gives comes back as fresh scores. A timer at the end of its life removes the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

LIFE = 600  # seconds
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "product_id string, id long, at timestamp, score double, outcome string, lives_until timestamp"


def use_state_store(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which timers need: memory does not bound it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Cache(StatefulProcessor):
    """One product's state: the score (null until it is known) and until when it lives, in microseconds."""

    def __init__(self, life: int):
        self.life = life * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", StructType([StructField("score", DoubleType()), StructField("until", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.known.get()
        score, until = found if found else (None, None)
        given, out, timer = pd.concat(list(rows)), [], until
        # Of one moment fresh scores come first, then requests by id.
        given = given.assign(asks=given["score"].isna()).sort_values(["at", "asks", "id"], kind="stable")
        micros = given["at"].astype("int64") // (1000 if str(given["at"].dtype).startswith("datetime64[ns") else 1)
        for id_, at, now, fresh in zip(given["id"], given["at"], micros, given["score"], strict=True):
            now = int(now)
            if not pd.isna(fresh):
                score, until, outcome = float(fresh), now + self.life, "fresh"
            elif until is not None and until > now:
                outcome = "hit"
            else:
                score, until, outcome = None, now + self.life, "miss"
            out.append((key[0], id_, at, score, outcome, pd.Timestamp(until, unit="us")))
        if until != timer:
            if timer is not None:
                self.handle.deleteTimer(-(-timer // 1000))
            self.handle.registerTimer(-(-until // 1000))
        self.known.update((score, until))
        yield _answers(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        score, until = self.known.get()
        self.known.clear()
        yield _answers([(key[0], None, pd.Timestamp(until, unit="us"), score, "expired", pd.Timestamp(until, unit="us"))])

    def close(self) -> None:
        pass


def _answers(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["product_id", "id", "at", "score", "outcome", "lives_until"], dtype=object)
    return out.astype({"id": "Int64", "score": "float64", "at": "datetime64[us]", "lives_until": "datetime64[us]"})


def answers(events: DataFrame, life: int = LIFE, late: str = "0 seconds") -> DataFrame:
    """What becomes of a stream of (product_id, id, at, score): for each row its outcome (hit, miss or fresh), the score that is
    known and until when; and a row without id, ``expired``, when time has passed the end of a life.

    A state lives up to but not at its end. Time is that of the events: it passes as the
    latest ``at`` does, less what may be ``late``. Rows of one trigger are taken in the order of their times, so
    a trigger's rows of one product must fit into a task.
    """
    timed = events.select("product_id", "id", "at", "score").withWatermark("at", late)
    return timed.groupBy("product_id").transformWithStateInPandas(_Cache(life), ANSWER, "Append", "EventTime")
