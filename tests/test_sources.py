from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from codeveritas.operators import training
from codeveritas.sources import archives, directories, feature_store, files, reports


def test_scan_files_filters_relative_to_root(spark, tmp_path):
    root = tmp_path / "build" / "corpus"
    for name, body in {
        "r1/main.py": b"x = 1\r\ny = 2",
        "r1/vendor/lib.py": b"z",
        "r1/big.py": b"a" * (500 * 1024 + 1),
        "r1/limit.py": b"a" * (500 * 1024),
        "r1/data.bin": b"0",
        "r2/App.JS": b"\xff1",
        "r2/empty.md": b"",
        "r2/a b+c.md": b"",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    kept = files.prepare(files.scan_files(spark, str(root)))
    rows = {r.file_path: r for r in kept.collect()}
    assert set(rows) == {"r1/main.py", "r1/limit.py", "r2/App.JS", "r2/empty.md",
                         "r2/a b+c.md"}
    assert rows["r1/main.py"].content == "x = 1\ny = 2"
    assert rows["r1/main.py"].scan_id == "r1"
    assert rows["r2/empty.md"].content == ""
    assert rows["r2/App.JS"].content == "\ufffd1"
    assert rows["r2/App.JS"].language == "javascript"


def test_scan_filters_reach_the_file_source(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x")
    plan = files.drop_oversize(files.scan_files_by_index(spark, str(tmp_path), "s"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,512000)" in text


def _tree(root, named):
    for name, body in named.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)


def test_listing_and_index_read_the_same_files(spark, tmp_path):
    named = {f"s{i % 3}/d{i % 4}/e/f{i}.py": b"x" * (i * 7) for i in range(40)}
    named |= {"top.md": b"", "s0/sp ace/%41+b.go": b"ab", "s1/\u00e9/\u4e2d.rs": b"\xff"}
    _tree(tmp_path, named)
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        rows = files.scan_files(spark, root).collect()
        assert {r.file_path: (bytes(r.content), r.size_bytes) for r in rows} == {k: (v, len(v)) for k, v in named.items()}
        assert len(rows) == len(named) and {r.scan_id for r in rows} == {"top.md", "s0", "s1", "s2"}
    indexed = files.scan_files_by_index(spark, str(tmp_path)).collect()
    plain = {(r.file_path, bytes(r.content)) for r in indexed}
    assert plain == set(named.items())


def test_skipped_directories_are_not_entered_nor_dropped_files_opened(spark, tmp_path):
    import os

    _tree(tmp_path, {"a/x.py": b"1", "a/vendor/y.py": b"2", "a/big.py": b"3" * 99, "a/z.bin": b"4", "a/axpy": b"5", "a/b/U.PY": b"6"})
    os.symlink(tmp_path / "a", tmp_path / "a" / "loop")
    listed = directories.list_tree(spark, str(tmp_path), skipped=["vendor"], extensions=[".py"], max_bytes=50)
    assert {(r.path, r["size"]) for r in listed.collect()} == {("a/x.py", 1), ("a/b/U.PY", 1)}
    kept = files.scan_files(spark, str(tmp_path), "s", supported_only=True, skip_vendor=True, max_bytes=50)
    assert {r.file_path for r in kept.collect()} == {"a/x.py", "a/b/U.PY"}
    # A file that goes between listing and reading is empty, and the rest is read.
    gone = directories.list_tree(spark, str(tmp_path), skipped=["vendor"])
    (tmp_path / "a" / "z.bin").unlink()
    read = {r.path: bytes(r.content) for r in directories.read_files(gone, str(tmp_path)).collect()}
    assert read["a/z.bin"] == b"" and read["a/x.py"] == b"1"


def test_empty_and_missing_roots(spark, tmp_path):
    assert files.scan_files(spark, str(tmp_path)).count() == 0
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [("a/b.py", "x\r\n\u00e9"), ("c.md", ""), ("d/e/f.js", None)]
    df = spark.createDataFrame(rows, "file_path string, content string")
    written = directories.write_files(df, str(tmp_path))
    assert {(r.path, r["size"]) for r in written.collect()} == {("a/b.py", 5), ("c.md", 0), ("d/e/f.js", 0)}
    assert {r.file_path: bytes(r.content).decode() for r in files.scan_files(spark, str(tmp_path)).collect()} == {
        k: v or "" for k, v in rows}
    with pytest.raises(Exception, match="leaves its root"):
        directories.write_files(spark.createDataFrame([("../x", "y")], "file_path string, content string"), str(tmp_path))


def test_notebooks(make_files):
    code = {"cell_type": "code", "source": ["a = 1\n", "b = 2"]}
    single = {"cell_type": "code", "source": "c = 3"}
    note = {"cell_type": "markdown", "source": "text"}
    missing = {"cell_type": "code"}
    odd = {"cell_type": "code", "source": 5}
    df = make_files(
        ("n1.ipynb", json.dumps({"cells": [note, code, single]})),
        ("n2.ipynb", "{broken"),
        ("n3.ipynb", "[1]"),
        ("n4.ipynb", json.dumps({"cells": [missing, odd, code]})),
        ("n5.ipynb", "{}"),
        ("n6.py", '{"cells": []}'),
    )
    got = {r.file_path: r.code for r in df.collect()}
    assert got == {
        "n1.ipynb": "a = 1\nb = 2\n\nc = 3",
        "n2.ipynb": "{broken",
        "n3.ipynb": "[1]",
        "n4.ipynb": "\n\na = 1\nb = 2",
        "n5.ipynb": "",
        "n6.py": '{"cells": []}',
    }


def _tar(mode):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as tar:
        for name, body in (("d/a.py", b"x"), ("../up.py", b"y"), ("/abs.py", b"z")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return buffer.getvalue()


def test_archives(spark):
    import bz2
    import gzip
    import lzma

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("m.py", "m")
        z.writestr("../e.py", "e")
    rows = [
        ("z", "a.zip", packed.getvalue()), ("t", "a.tar", _tar("w:")),
        ("tg", "a.tgz", _tar("w:gz")), ("tb", "a.tar.bz2", _tar("w:bz2")),
        ("tx", "a.tar.xz", _tar("w:xz")), ("g", "one.py.gz", gzip.compress(b"g")),
        ("b", "one.py.bz2", bz2.compress(b"b")), ("x", "one.py.xz", lzma.compress(b"x")),
        ("bad", "bad.zip", b"nope"),
    ]
    df = spark.createDataFrame(
        [(a, b, bytearray(c)) for a, b, c in rows], "scan_id string, file_path string, content binary"
    )
    got = {(r.scan_id, r.file_path) for r in archives.explode_archives(df).collect()}
    assert got == {
        ("z", "m.py"), ("t", "d/a.py"), ("tg", "d/a.py"), ("tb", "d/a.py"), ("tx", "d/a.py"),
        ("g", "one.py"), ("b", "one.py"), ("x", "one.py"),
    }
    dropped = {(r.scan_id, r.status): r.members for r in archives.blocked_members(df).collect()}
    assert dropped[("z", "blocked")] == 1 and dropped[("t", "blocked")] == 2
    assert dropped[("bad", "unreadable")] == 1


def test_classify_input(spark):
    names = ["a.tar.gz", "A.ZIP", "a.gz", "a.py", "a.R", "a.ipynb", "a.exe", "noext", "x.tar.bz2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.k for r in df.select(files.classify_input(F.col("n")).alias("k")).collect()]
    assert got == ["archive", "archive", "archive", "source", "source", "source", "rejected",
                   "rejected", "archive"]


def test_report_store(spark, tmp_path):
    import datetime as dt

    stamp = dt.datetime(2024, 1, 2, 3, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame(
        [("a", stamp, 50.0), ("b", stamp - dt.timedelta(hours=2), 60.0)],
        "scan_id string, generated_at timestamp, trust_score double",
    )
    path = str(tmp_path / "reports")
    reports.write_reports(df, path)
    found = reports.lookup_report(spark, path, "a", dt.date(2024, 1, 2))
    assert found.first().trust_score == 50.0
    assert "PartitionFilters: [isnotnull(generated_date" in (
        found._jdf.queryExecution().executedPlan().toString()
    )
    live = reports.expire_reports(df, "2024-01-02 03:30:00")
    assert [r.scan_id for r in live.collect()] == ["a"]


def _hashed(make_files, *texts):
    made = make_files(*[(f"f{k}.py", t) for k, t in enumerate(texts)])
    return files.content_hash(made)


def test_feature_cache_computes_only_new_content(spark, make_files, tmp_path):
    path = str(tmp_path / "cache")
    seen, plans = [], []

    def compute(rows):
        seen.append(sorted(r.code for r in rows.select("content_sha256", "code").distinct().collect()))
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.select("content_sha256", F.length("code").alias("n"))

    first, again = _hashed(make_files, "x", "x", "yy"), _hashed(make_files, "x", "zzz")
    assert feature_store.feature_cache(first, path, compute).count() == 2
    assert {r.n for r in feature_store.feature_cache(again, path, compute).collect()} == {1, 3}
    assert {r.n for r in feature_store.feature_cache(first, path, compute).collect()} == {1, 2}
    # The second run computes the changed file only, the third none; texts reach it without an exchange.
    assert seen == [["x", "yy"], ["zzz"]]
    assert all("Exchange" not in plan and "Join" not in plan for plan in plans)


def test_no_exchange_of_the_feature_cache_carries_text(spark, make_files, tmp_path):
    rows = _hashed(make_files, "x", "yy")
    store = feature_store.FeatureStore(spark, str(tmp_path))
    store.append(rows.select("content_sha256", F.length("code").alias("n")))
    for frame in (store.unseen(rows.select("content_sha256").distinct()), feature_store.bitmap_rows(rows)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "code" not in plan


def test_feature_store_with_full_bitmaps_and_many_segments(spark, make_files, tmp_path, monkeypatch):
    """Bitmaps of 128 bits fill up, segments are joined into one; results stay exact."""
    monkeypatch.setattr(feature_store, "BITS", 7)
    monkeypatch.setattr(feature_store, "MOST_SEGMENTS", 3)
    compute = lambda rows: rows.select("content_sha256", F.col("code").alias("kept"))
    held = set()
    for k in range(6):
        texts = [f"t{i}" for i in range(40 * k, 40 * k + 60)]
        held |= set(texts)
        got = feature_store.feature_cache(_hashed(make_files, *texts), str(tmp_path), compute).collect()
        assert sorted(r.kept for r in got) == sorted(texts)
        store = feature_store.FeatureStore(spark, str(tmp_path))
        assert sorted(r.kept for r in store.rows().collect()) == sorted(held)
        assert len(store.segments()) <= 3
    assert store.bitmap().selectExpr("bit_count(bit_or(bits))").count() == 1


def test_feature_cache_without_files(spark, make_files, tmp_path):
    none = _hashed(make_files, "x").limit(0)
    compute = lambda rows: rows.select("content_sha256", F.length("code").alias("n"))
    got = feature_store.feature_cache(none, str(tmp_path / "a"), compute)
    assert got.columns == ["content_sha256", "n"] and got.count() == 0


def test_samples_from_csv(spark, tmp_path):
    body = 'id,code,label,problem_id,extra\n1,"a = ""q""\nb",0,p1,z\n2,"  ",0,p1,z\n3,,0,p2,z\n'
    (tmp_path / "human.csv").write_text(body)
    (tmp_path / "ai.csv").write_text("code,label,problem_id\nc = 1,1,p3\n")
    df = training.load_samples(spark, str(tmp_path / "human.csv"), str(tmp_path / "ai.csv"))
    kept = training.drop_blank(df)
    assert df.count() == 4
    assert {(r.code, r.label, r.problem_id) for r in kept.collect()} == {
        ('a = "q"\nb', 0, "p1"), ("c = 1", 1, "p3"),
    }
