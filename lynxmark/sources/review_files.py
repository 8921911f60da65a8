"""Folders of review lines as a data source that lists only what a query asks for.

The layout is what ``sinks.write_ndjson`` leaves: ``dataset=<name>/asin=<number>/`` and files of any
depth below. Conditions on dataset and asin choose folders before any of them is listed, so a
query for a few products of a store of millions opens a few folders. Many small files make
up one task; a large file is cut at bytes, and a line belongs to the piece in which it begins.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "dataset string, asin string, path string, size long, modified timestamp, offset long, line string"
LEVELS = ("dataset", "asin")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of a task, what opening a file counts as, and lines that leave a task at a time.
TASK_BYTES, OPEN_BYTES, LINES = 128 << 20, 4 << 20, 5_000


@dataclass
class Piece:
    dataset: str
    asin: str
    path: str
    size: int
    modified: float
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(len(pieces))
        self.pieces = pieces


def local_path(path: str) -> str:
    """The path of a mounted folder, which driver and executors see alike."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"review_files reads mounted folders, not {url.scheme}: read_lines reads any store")
    return unquote(url.path) if url.scheme else path


def lines_of(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin from ``start`` up to before ``end``; line ends are left out."""
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the line that begins before; none of it, if one ends right there
        at = f.tell()
        while at < end and (line := f.readline()):
            yield at, line.rstrip(b"\r\n")
            at += len(line)


class ReviewFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.bytes = local_path(options["path"]), int(options.get("taskbytes", TASK_BYTES))
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            told = {str(f.value)} if isinstance(f, EqualTo) and f.value is not None else set(map(str, f.value)) if isinstance(f, In) else None
            if told is None or len(f.attribute) != 1 or f.attribute[0] not in LEVELS:
                yield f
            else:
                level = f.attribute[0]
                self.only[level] = self.only.get(level, told) & told

    def _folders(self, parent: str, level: str) -> list[tuple[str, str]]:
        """(value, folder) of a level: those that are asked for are looked up, not listed."""
        if level in self.only:
            named = [(v, f"{parent}/{level}={quote(v, safe='- _.()')}") for v in sorted(self.only[level])]
            return [(v, p) for v, p in named if os.path.isdir(p)]
        with os.scandir(parent) as found:
            return sorted((unquote(x.name.split("=", 1)[1]), x.path) for x in found if x.is_dir() and x.name.startswith(f"{level}="))

    def files(self) -> Iterator[Piece]:
        for dataset, folder in self._folders(self.root, LEVELS[0]):
            for asin, own in self._folders(folder, LEVELS[1]):
                for top, _, names in os.walk(own):
                    for name in sorted(names):
                        if name.lower().endswith((".ndjson", ".txt")) and not name.startswith((".", "_")):
                            told = os.stat(path := os.path.join(top, name))
                            yield Piece(dataset, asin, path, told.st_size, told.st_mtime, 0, told.st_size)

    def partitions(self) -> Sequence[InputPartition]:
        tasks, held, size = [], [], 0
        for f in self.files():
            for start in range(0, max(f.size, 1), self.bytes):
                piece = Piece(f.dataset, f.asin, f.path, f.size, f.modified, start, min(f.size, start + self.bytes))
                cost = min(piece.end - start + OPEN_BYTES, self.bytes)
                if held and size + cost > self.bytes:
                    tasks.append(Pieces(held))
                    held, size = [], 0
                held.append(piece)
                size += cost
        return [*tasks, Pieces(held)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.string())
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows: list[tuple] = []
        for p in partition.pieces:
            modified = datetime.datetime.fromtimestamp(p.modified, datetime.UTC)
            for offset, line in lines_of(p.path, p.start, p.end):
                rows.append((p.dataset, p.asin, p.path, p.size, modified, offset, line.decode("utf-8", "replace")))
                if len(rows) == LINES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class ReviewFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ReviewFilesReader:
        return ReviewFilesReader(self.options)


def read_review_files(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Lines (dataset, asin, path, size, modified, offset, line) below ``path``. The session lets conditions reach
    Python data sources from here on."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ReviewFiles)
    return spark.read.format("review_files").option("taskBytes", str(task_bytes)).load(path)
