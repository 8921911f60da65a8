"""Parquet tables in versions: whole or by partition, written once, by several writers, with the changes between versions."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has changed partitions that a write is based on."""


@dataclass(frozen=True)
class Version:
    """What a committed file says: a folder for each partition ("-": all of a table without any), how the table is cut, and
    of each writer the number of its last batch."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    layout: dict = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return "\n".join([json.dumps({"layout": self.layout, "ledger": self.ledger}), *(f"{k} {v}" for k, v in self.folders.items())])

    @staticmethod
    def parse(number: int, lines: list[str]) -> Version:
        head = json.loads(lines[0])
        return Version(number, dict(x.split(" ", 1) for x in lines[1:] if x), head["layout"], head["ledger"])


class VersionedTable:
    """A Parquet table of which each write is a new folder, ``v-<number>-<name>``, that counts from the moment that a list of
    folders appears in ``committed``: the highest number there is the table.

    A write that ends before that leaves the version before it in place, and no moment is
    without one. With ``by``, a table lies in ``parts`` partitions by that column's hash; how
    it is cut is kept with every version, and opening it in another way is an error. ``replace``
    writes those partitions alone that a batch touches; all others stay those of the version
    before. However large a partition is, it is written by as many tasks as it has data for.
    For that rows are shuffled once more before they are written; without ``gather`` every task
    writes the rows that it has, so nothing is moved, but in a file for each partition and task.

    Writers need not wait for each other: whoever commits second takes over the partitions that
    others have changed meanwhile, if they are none of its own, and else gets a ``Conflict``;
    ``update`` then computes the change again. A ``batch`` (writer, number) is written once: the
    ledger of batches is part of the version, and a number that it holds is not written again.

    Lists appear by a rename that does not replace (HDFS and what keeps its rules) or by a hard
    link (local files); stores without either do not hold off a second writer. ``prune``
    removes folders that no version in use names.
    """

    def __init__(self, spark: SparkSession, path: str, by: str | None = None, parts: int = 64, gather: bool = True):
        self.spark, self.path, self.by, self.parts, self.gather = spark, path.rstrip("/"), by, parts, gather
        self.layout = {"by": by, "parts": parts if by else None}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"
        self.current()

    # Versions

    def _committed(self) -> list[int]:
        folder = self._path(f"{self.path}/committed")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _load(self, number: int) -> Version:
        rows = self.spark.read.text(f"{self.path}/committed/{number:08d}", wholetext=True).collect()
        found = Version.parse(number, rows[0][0].split("\n"))
        if found.layout != self.layout:
            raise ValueError(f"{self.path} is cut by {found.layout}, not by {self.layout}")
        return found

    def current(self) -> Version:
        numbers = self._committed()
        return self._load(numbers[-1]) if numbers else Version(layout=self.layout)

    def version(self) -> int | None:
        return max(self._committed(), default=None)

    def done(self, writer: str) -> int | None:
        """The number of the writer's last batch in the table."""
        return self.current().ledger.get(writer)

    # Reading

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _touched(self, keys: DataFrame) -> set[str]:
        """The partitions where the values of ``keys``' first column lie: ``parts`` at most."""
        return {str(r[0]) for r in keys.select(self._part(keys.columns[0])).distinct().collect()}

    def _rows(self, version: Version, parts: set[str] | None = None) -> DataFrame:
        folders = version.folders if parts is None else {k: v for k, v in version.folders.items() if k in parts}
        empty = not folders
        df = self.spark.read.parquet(*[f"{self.path}/{x}" for x in (folders or version.folders).values()])
        return df.where("false") if empty else df

    def read(self, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The table (of a ``version``), or only the partitions where the values of ``keys``' first column lie."""
        found = self.current() if version is None else self._load(version)
        if not found.number:
            raise FileNotFoundError(self.path)
        return self._rows(found, self._touched(keys) if keys is not None and self.by else None)

    def changed_parts(self, old: int, new: int) -> set[str]:
        """The partitions of which two versions name different folders."""
        a, b = self._load(old).folders, self._load(new).folders
        return {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}

    def changes(self, old: int, new: int, keys: list[str], unchanged: bool = False) -> DataFrame:
        """The rows that differ between two versions, with ``change``: inserted, updated (as they are in the new one) or deleted
        (as they were). Only partitions whose folders differ are read; with ``unchanged`` all, for the rows that stay.

        ``keys`` name a row, nulls included; the table has one row a key."""
        parts = None if unchanged else self.changed_parts(old, new)
        before, after = self._rows(self._load(old), parts), self._rows(self._load(new), parts)
        names = after.columns
        a = before.select(F.struct(*[F.col(c) if c in before.columns else F.lit(None).cast(after.schema[c].dataType).alias(c) for c in names]).alias("a"))
        b = after.select(F.struct(*names).alias("b"))
        same_key = F.lit(True)
        for k in keys:
            same_key &= F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        both = a.join(b, same_key, "full_outer")
        kind = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("updated")
        told = both.select(F.coalesce("b", "a").alias("row"), kind.alias("change"))
        return (told if unchanged else told.where("change != 'unchanged'")).select("row.*", "change")

    # Writing

    def write(self, df: DataFrame, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """``df`` becomes the table; the version's number."""
        return self._commit(df, None, batch, base)

    def replace(self, df: DataFrame, keys: DataFrame, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
        """``df`` holds the rows of all partitions that ``keys`` touch, as ``read(keys, base)`` gave them; those alone are written."""
        return self._commit(df, self._touched(keys) if self.by else None, batch, base)

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, tries: int = 10) -> int:
        """``replace`` by what ``change`` makes of the rows that ``keys`` touch; made again where another writer has changed them."""
        touched = None
        for n in range(tries):
            base = self.current()
            if _held(base, batch):
                return base.number
            if not base.number:
                raise FileNotFoundError(self.path)
            if self.by and touched is None:
                touched = self._touched(keys)
            try:
                return self._commit(change(self._rows(base, touched)), touched, batch, base.number)
            except Conflict:
                if n == tries - 1:
                    raise
        raise ValueError("tries must be 1 or more")

    def _commit(self, df: DataFrame, touched: set[str] | None, batch: tuple[str, int] | None, base: int | None) -> int:
        start = self.current() if base is None else (self._load(base) if base else Version(layout=self.layout))
        if _held(start, batch):
            return start.number
        name = f"v-{start.number + 1:08d}-{uuid.uuid4().hex}"
        if self.by:
            cut = df.withColumn("_part", self._part(self.by))
            cut = cut.hint("rebalance", F.col("_part")) if self.gather else cut
            cut.write.partitionBy("_part").option("compression", "zstd").parquet(f"{self.path}/{name}")
            folders = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{name}"))]
            made = {f.removeprefix("_part="): f"{name}/{f}" for f in folders if f.startswith("_part=")}
            if not made:  # an empty folder keeps the columns
                df.limit(0).write.mode("overwrite").parquet(f"{self.path}/{name}")
                made = {"-": name} if touched is None else {}
        else:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            made = {"-": name}
        return self._publish(start, name, made, touched, batch)

    def _publish(self, base: Version, name: str, made: dict[str, str], touched: set[str] | None, batch: tuple[str, int] | None) -> int:
        while True:
            latest = self.current()
            if latest.number != base.number:
                if _held(latest, batch):
                    return latest.number
                others = {k for k in latest.folders.keys() | base.folders.keys() if latest.folders.get(k) != base.folders.get(k)}
                if touched is None or others & touched:
                    raise Conflict(f"version {base.number} of {self.path} has been followed by another writer's {latest.number}")
            kept = {} if touched is None else {k: v for k, v in latest.folders.items() if k not in touched and k != "-"}
            folders = kept | made or {"-": name}
            ledger = latest.ledger | ({batch[0]: batch[1]} if batch else {})
            if self._appears(Version(latest.number + 1, folders, self.layout, ledger), name):
                return latest.number + 1

    def _appears(self, version: Version, name: str) -> bool:
        """Whether the list has become that version; false if another writer's has."""
        draft, place = self._path(f"{self.path}/drafts/{name}"), self._path(f"{self.path}/committed/{version.number:08d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(version.text().encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        if not self._local:
            return not self._fs.exists(place) and self._fs.rename(draft, place)
        try:
            os.link(draft.toUri().getPath(), place.toUri().getPath())
        except FileExistsError:
            return False
        self._fs.delete(draft, False)
        return True

    def prune(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions and the folders that only those before named."""
        committed = self._committed()
        used = {v.split("/")[0] for n in committed[-keep:] for v in self._load(n).folders.values()}
        for n in committed[:-keep]:
            self._fs.delete(self._path(f"{self.path}/committed/{n:08d}"), False)
        last = committed[-1] if committed else 0
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name.startswith("v-") and name not in used and int(name.split("-")[1]) <= last:
                self._fs.delete(f.getPath(), True)


def _held(version: Version, batch: tuple[str, int] | None) -> bool:
    return batch is not None and version.ledger.get(batch[0], -1) >= batch[1]
