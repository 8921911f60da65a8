"""The data source of review folders: what it lists, how it deals files, and what it reads."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from lynxmark.sources import review_files


@pytest.fixture
def store(tmp_path):
    for d in ("ad_hoc", "main"):
        for a in range(20):
            folder = tmp_path / f"dataset={d}" / f"asin=B{a:03d}" / "deep"
            folder.mkdir(parents=True)
            (folder / "x.ndjson").write_text("".join(f'{{"d":"{d}","a":{a},"i":{i}}}\n' for i in range(a)))
            (folder / "notes.md").write_text("no line\n")
    return tmp_path


def test_only_folders_that_are_asked_for_are_opened(store, monkeypatch):
    listed = []
    scandir, walk = os.scandir, os.walk
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(str(p)) or scandir(p))
    monkeypatch.setattr(os, "walk", lambda p: listed.append(str(p)) or walk(p))
    reader = review_files.ReviewFilesReader({"path": f"file://{store}"})
    left = list(reader.pushFilters([In(("asin",), ("B003", "B005", "B999")), EqualTo(("dataset",), "main"), GreaterThan(("size",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert sorted((f.dataset, f.asin) for f in reader.files()) == [("main", "B003"), ("main", "B005")]
    assert {p for p in listed if "asin=" in p and "deep" not in p} == {f"{store}/dataset=main/asin=B003", f"{store}/dataset=main/asin=B005"} and str(store) not in listed
    with pytest.raises(ValueError):
        review_files.ReviewFilesReader({"path": "hdfs://x/y"})


@pytest.mark.parametrize("size", [1, 7, 64, 10**9])
def test_pieces_of_a_file_make_up_the_file(tmp_path, size):
    path = tmp_path / "f"
    path.write_bytes(b"one\n\nthree is longer\r\n" + "é x\n".encode() + b"last")
    whole = list(review_files.lines_of(str(path), 0, os.path.getsize(path)))
    assert [x for _, x in whole] == [b"one", b"", b"three is longer", "é x".encode(), b"last"]
    parts = [x for i in range(0, os.path.getsize(path), size) for x in review_files.lines_of(str(path), i, min(os.path.getsize(path), i + size))]
    assert parts == whole


def test_small_files_share_tasks(spark, store, monkeypatch):
    reader = review_files.ReviewFilesReader({"path": str(store), "taskbytes": str(32 << 20)})
    tasks = reader.partitions()
    assert 1 < len(tasks) < 10 and sum(len(t.pieces) for t in tasks) == 40
    df = review_files.read_review_files(spark, str(store))
    assert df.count() == 2 * sum(range(20))
    some = df.where((F.col("asin") == "B004") & (F.col("size") > 1)).select("line", "offset")
    assert sorted(r.offset for r in some.collect())[:2] == [0, 0] and some.count() == 8
    assert df.where("asin = 'none'").count() == 0
