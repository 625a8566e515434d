"""Chunked CSV against a reader of the whole file, at every place a chunk may begin."""

from __future__ import annotations

import csv
import io
import random

import pytest

from codeveritas.operators import training
from codeveritas.sources import csv_chunks

TRICKY = (
    'code,label,problem_id\n"a\n""b"",\n\n c",1,p1\r\n"",0,p2\n,1,p3\n"x\r\ny",0,"p,4"\n\n"""",1,p5\n'
    'plain,0,p6\nshort,1\n"é\n""\n",0,p7\n"last",1,p8'
)


def whole(data: str) -> list[list]:
    rows = [r for r in csv.reader(io.StringIO(data, newline=""), quoting=csv.QUOTE_NOTNULL) if r]
    return [r + [None] * (len(rows[0]) - len(r)) for r in rows[1:]]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def in_chunks(data: bytes, n: int) -> list[list]:
    out = []
    for start in range(0, len(data), n):
        inside = data[:start].count(b'"') % 2 == 1
        for batch in csv_chunks._records(Bytes(data), start, n, inside, ["code", "label", "problem_id"]):
            out += [list(r.values()) for r in batch.to_pylist()]
    return out


@pytest.mark.parametrize("breaks", ["\n", "\r\n", "\r"])
def test_every_split_gives_the_same_records(breaks, monkeypatch):
    data = TRICKY.replace("\r\n", "\n").replace("\n", breaks)
    want = whole(data)
    assert len(want) == 9
    for step in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(csv_chunks, "STEP_BYTES", step)
        for n in range(1, len(data.encode()) + 2):
            assert in_chunks(data.encode(), n) == want, (step, n)


def test_random_files(monkeypatch):
    draw = random.Random(5)
    for _ in range(60):
        rows = [["".join(draw.choice('a"\n\r, é') for _ in range(draw.randint(0, 12))) for _ in range(3)] for _ in range(draw.randint(0, 12))]
        out = io.StringIO(newline="")
        writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=draw.choice(["\n", "\r\n"]))
        writer.writerows([["code", "label", "problem_id"], *rows])
        data = out.getvalue()
        monkeypatch.setattr(csv_chunks, "STEP_BYTES", draw.choice([1, 3, 16, 1 << 16]))
        monkeypatch.setattr(csv_chunks, "BATCH_BYTES", draw.choice([1, 20, 1 << 20]))
        for n in (1, 2, 3, 5, 11, 64, 10_000):
            assert in_chunks(data.encode(), n) == rows


def test_one_large_file_is_many_tasks_and_equals_the_whole_file_reader(spark, tmp_path):
    draw = random.Random(2)
    rows = [[f"def f{k}():\n    \"\"\"{'x' * draw.randint(0, 400)}\"\"\"\n\n", str(k % 2), f"p{k % 7}"] for k in range(2000)]
    path = tmp_path / "samples.csv"
    with path.open("w", newline="") as file:
        csv.writer(file).writerows([["problem_id", "label", "code", "more"], *[[p, v, c, ""] for c, v, p in rows]])
    chunked = csv_chunks.read_csv(spark, str(path), ["code", "label", "problem_id"], chunk_bytes=10_000)
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, rows))
    used = chunked.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).filter(bool).count()
    assert used > 4
    spark_rows = spark.read.csv(str(path), header=True, multiLine=True, quote='"', escape='"').select("code", "label", "problem_id")
    assert sorted(map(tuple, spark_rows.collect())) == sorted(map(tuple, chunked.collect()))
    loaded = training.load_samples(spark, str(path), str(path))
    assert loaded.count() == 4000 and loaded.where("label = 1").count() == 2000


def test_fields_longer_than_a_chunk_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,label,problem_id\n"' + "x\n" * 300_000 + '",1,p\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("code,label,problem_id\n")
    (tmp_path / "_SUCCESS").write_text("no data")
    rows = csv_chunks.read_csv(spark, str(tmp_path), ["code", "label", "missing"], chunk_bytes=50_000).collect()
    assert [(len(r.code), r.label, r.missing) for r in rows] == [(600_000, "1", None)]


def test_records_leave_in_batches_of_few_rows():
    data = b"code,label\n" + b"".join(b'"a ""%d""\nb",1\n\n' % k for k in range(3 * csv_chunks.BATCH_ROWS + 7))
    batches = list(csv_chunks._records(Bytes(data), 0, len(data), False, ["code", "label"]))
    assert [b.num_rows for b in batches] == [*[csv_chunks.BATCH_ROWS] * 3, 7]
    got = [r["code"] for b in batches for r in b.to_pylist()]
    assert got == [f'a "{k}"\nb' for k in range(len(got))]
