import base64
import hashlib
import pathlib

import pytest
import zstandard
from pyspark.sql import functions as F

from quillmark.llm import warc
from quillmark.llm.common import materialize


def rows(n, size=1500):
    return [{"page_id": i, "url": f"http://e.org/{i}", "payload": (f"<p>{i}</p>" + "body text " * (size // 10)).encode(), "record_type": "response", "refers_to": None} for i in range(n)]


def records(n):
    out = []
    for row in rows(n):
        row |= {"payload_bytes": len(row["payload"]), "payload_digest": hashlib.sha1(row["payload"]).hexdigest()}
        out.append(warc.record_bytes(row))
    return out


@pytest.mark.parametrize("n", [1, 40])
def test_round_trip_with_and_without_a_trained_dictionary(n):
    content = warc.archive_bytes(records(n))
    words, at = warc.load_dictionary(memoryview(content))
    assert (words is not None) == (n >= 16)
    got = list(warc.read_archive(content))
    assert [r["page_id"] for r in got] == list(range(n)) and [r["payload"] for r in got] == [r["payload"] for r in rows(n)]


def test_a_plain_dictionary_is_loaded():
    content = warc.archive_bytes(records(40))
    words, at = warc.load_dictionary(memoryview(content))
    plain = words.as_bytes()
    other = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(plain).to_bytes(4, "little") + plain + content[at:]
    assert len(list(warc.read_archive(other))) == 40


def test_frames_end_where_zstandard_says():
    for options in ({"write_checksum": True}, {"write_checksum": False}, {"write_content_size": False}):
        frame = zstandard.ZstdCompressor(**options).compress(b"abc" * 100_000)
        assert warc.frame_end(memoryview(frame + b"more"), 0) == len(frame)


@pytest.mark.parametrize("change", ["cut", "start", "length", "digest", "type", "dictionary"])
def test_damage_is_found(change):
    record = records(1)[0]
    if change == "length":
        record = record.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    elif change == "digest":
        record = record.replace(b"body text", b"body tent", 1)
    elif change == "type":
        record = record.replace(b"WARC-Type: response", b"WARC-Type: unheard-of", 1)
    content = warc.archive_bytes([record])
    if change == "cut":
        content = content[:-3]
    elif change == "start":
        content = content[8:]
    elif change == "dictionary":
        content = warc.DICTIONARY_FRAME.to_bytes(4, "little") + (4).to_bytes(4, "little") + b"abcd" + content[8:]
    with pytest.raises(warc.InvalidArchive):
        list(warc.read_archive(content))


def test_tables(spark, tmp_path):
    long, other = "é" * 800, "z" * 1200
    pages = [(1, "u1", long), (2, "u2", long), (9, None, long), (3, "u3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u\r\n6", ""), (None, "n", long), (7, "big", "q" * 3_000_000), (8, "a", other), (8, "b", other)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    archives = materialize(warc.write_archives(warc.plan_records(table)), "archives")
    got = sorted(warc.read_archives(archives).collect(), key=lambda r: (r.page_id is None, r.page_id, r.url or ""))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
        (7, "response", None), (8, "response", None), (8, "response", None), (9, "response", None), (None, "revisit", 9),
    ]
    for r in got:
        text = next((h or "") for i, u, h in pages if i == r.page_id and (u or "").replace("\r\n", "%0D%0A") == (r.url or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else r.payload.decode() == text
    assert warc.read_archives(warc.write_archives(warc.plan_records(table.limit(0)))).count() == 0
    warc.save_archives(archives, (tmp_path / "files").as_uri())
    warc.save_archives(archives, (tmp_path / "files").as_uri())
    files = spark.read.format("binaryFile").load(str(pathlib.Path(tmp_path, "files", "*.warc.zst")))
    assert warc.read_archives(files).where(F.col("page_id") == 7).count() == 1 and files.count() == archives.count()


def frame(kind, block, *fields):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", "WARC-Date: 2024-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers():
    """Other kinds of records are passed over or shown; heads without a length and digests in base32 are read."""
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    same = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    content = warc.archive_bytes([frame("warcinfo", b"software: x"), frame("request", b"GET / HTTP/1.1\r\n\r\n"), frame("response", page, f"WARC-Payload-Digest: sha1:{digest}", "WARC-Target-URI: http://a"), frame("revisit", b"HTTP/1.1 200 OK\r\n\r\n", same, "WARC-Refers-To: <urn:x>")])
    got = list(warc.read_archive(content))
    assert [(r["record_type"], r["payload"], r["payload_bytes"]) for r in got] == [("response", b"hello", 5), ("revisit", None, 0)] and got[0]["payload_digest"] == hashlib.sha1(b"hello").hexdigest()
    assert [r["record_type"] for r in warc.read_archive(content, others=True)] == ["warcinfo", "request", "response", "revisit"]
    wrong = frame("response", page, f"WARC-Payload-Digest: sha1:{digest[:-1]}A")
    with pytest.raises(warc.InvalidArchive):
        list(warc.read_archive(warc.archive_bytes([wrong])))


def test_bad_records_are_rows_if_asked_for(spark):
    good = records(3)
    broken = warc.archive_bytes([good[0], good[1].replace(b"body text", b"body tent", 1), good[2]])
    cut = warc.archive_bytes(good)[:-7]
    archives = spark.createDataFrame([("a", broken), ("b", cut), ("c", b"none")][:2], "archive string, content binary")
    rows = warc.read_archives(archives, errors=True).collect()
    assert {(r.archive, r.record, r.page_id, r.error is None) for r in rows} == {("a", 0, 0, True), ("a", 1, None, False), ("a", 2, 2, True), ("b", 0, 0, True), ("b", 1, 1, True), ("b", 2, None, False)}
    with pytest.raises(Exception, match="digest differs"):
        warc.read_archives(archives).collect()


def test_revisits_name_their_response(spark):
    pages = spark.createDataFrame([(1, "http://one", "p" * 2000), (2, "http://two", "p" * 2000)], "page_id long, url string, html string")
    plan = warc.plan_records(pages)
    (content,) = [r.content for r in warc.write_archives(plan.coalesce(1)).collect()]
    ids = {r["page_id"]: r["record_id"] for r in warc.read_archive(content)}
    words, at = warc.load_dictionary(memoryview(content))
    raw = b""
    while at < len(content):
        end = warc.frame_end(memoryview(content), at)
        raw += zstandard.ZstdDecompressor().decompress(content[at:end])
        at = end
    assert f"WARC-Refers-To: {ids[2]}\r\n".encode() in raw and b"WARC-Refers-To-Target-URI: http://two\r\n" in raw
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
