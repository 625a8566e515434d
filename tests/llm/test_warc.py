from __future__ import annotations

import base64
import hashlib

import pytest

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import warc

PAGES = "page_id long, url string, html string, header string, sha256 string"


def rows():
    out = [(k, f"http://h/{k}", f"<p>{k % 7} é\r\n\r\nx</p>", "c", "c") for k in range(40)]
    return out + [(100, None, None, None, None), (101, "u\r\nX: y", "", None, None), (102, "u", "alone", None, None), (None, "n", "<p>1 é\r\n\r\nx</p>", None, None)]


def brute(pages):
    last = {}
    for i, _, h, *_ in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = {}
    for i, _, h, *_ in pages:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        own = last[h or ""] == i
        out[i] = (len(b), digest, "response" if own else "revisit", None if own else last[h or ""])
    return out


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), PAGES).repartition(4)
    archive = warc.write_archive(pages)
    got = {r.key: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(archive).collect()}
    assert got == brute(rows())
    assert archive.payloads.count() == len({h or "" for _, _, h, *_ in rows()})
    payload = {r.key: bytes(r.payload) for r in warc.read_archive(archive).collect()}
    assert payload == {i: (h or "").encode() for i, _, h, *_ in rows()}
    warc.export_warc(archive, str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    seen = []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        seen.append((fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], hashlib.sha1(raw[:n]).digest()))
        assert raw[n : n + 4] == b"\r\n\r\n"
        raw = raw[n + 4 :]
    assert len(seen) == len(got)
    assert all(base64.b32encode(x).decode() == d for k, d, x in seen if k == "response")


def test_every_row_is_a_record(spark):
    """Rows that share key and payload keep their addresses, and rows equal in all columns their number."""
    pages = spark.createDataFrame(
        [(1, "http://a/x", "same"), (1, "http://a/y", "same"), (2, "http://a/z", "same"), (2, "http://a/z", "same"), (3, "u", "other"), (None, "v", "same")],
        "page_id long, url string, html string").repartition(3)
    rows = warc.read_archive(warc.write_archive(pages)).collect()
    address = lambda r: bytes(r.header).decode().split("WARC-Target-URI: ")[1].split("\r\n")[0]
    assert sorted((r.key or 0, address(r)) for r in rows) == [
        (0, "v"), (1, "http://a/x"), (1, "http://a/y"), (2, "http://a/z"), (2, "http://a/z"), (3, "u")]
    assert len({r.record_id for r in rows}) == 6
    assert sorted((r.key or 0, r.record_type, r.refers_to) for r in rows if r.key != 3) == [
        (0, "revisit", 2), (1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2)]
    named = {r.record_id: r for r in rows}
    for r in rows:
        if r.record_type == "revisit":
            refers = bytes(r.header).decode().split("WARC-Refers-To: <urn:uuid:")[1].split(">")[0]
            assert named[refers].record_type == "response" and named[refers].payload == r.payload


def test_least_bytes_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long text"), (4, "d", "long text"), (4, "d", "long text")], "page_id long, url string, html string")
    got = sorted((r.key, r.record_type) for r in warc.read_archive(warc.write_archive(pages, least_bytes=5)).collect())
    assert got == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "revisit")]
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_damage_is_found(spark):
    pages = spark.createDataFrame([(1, "a", "xy")], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    archive.payloads = archive.payloads.withColumn("payload", archive.payloads.payload.substr(1, 1).cast("binary"))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(archive).collect()
