"""Archives: exact round trips, verification, revisits."""

import base64
import gzip
import hashlib
import io

import pytest

from corvane.llm import common, warc

LONG = "<p>" + "é" * 80 + "</p>"
PAGES = [(1, "http://a", LONG), (2, "http://b", LONG), (3, "u", "short"), (4, "u", "short"), (5, None, None), (6, "x\r\ny", ""), (None, "n", LONG), (7, "big", "z" * 300_000), (1, "http://a", LONG)]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_round_trip(spark, size):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages, archive_bytes=size)
    rows = warc.read_archives(archives).collect()
    assert len(rows) == len(PAGES)
    assert len({r["record_id"] for r in rows}) == len(PAGES)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    html = {p: (h or "").encode() for p, _, h in PAGES}
    for r in rows:
        full = html[r["page_id"]]
        assert r["payload_bytes"] == len(full)
        assert r["payload_digest"] == hashlib.sha256(full).hexdigest()
        assert r["payload"] == (full if r["record_type"] == "response" else b"")


def test_files(spark, tmp_path):
    data = b"".join(warc.record(i, "u", b"x" * 200 * i, "response", None, hashlib.sha256(b"x" * 200 * i).hexdigest()) for i in range(4))
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert sorted(r["payload_bytes"] for r in warc.read_warc_files(spark, str(tmp_path)).collect()) == [0, 200, 400, 600]


def member(kind, block, *head, http=b""):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *head, f"Content-Length: {len(http + block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + http + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<p>hello</p>" * 9
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    ok, chunked = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n"
    parts = [
        member("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:uuid:1>"),
        member("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a", "WARC-Record-ID: <urn:uuid:2>"),
        member("response", body, "warc-target-uri: http://a", f"WARC-Payload-Digest: sha1:{sha1}", "X-Folded: a\r\n  b", http=ok),
        member("response", b"20;x=1\r\n" + body[:32] + b"\r\n" + f"{len(body) - 32:x}".encode() + b"\r\n" + body[32:] + b"\r\n0\r\n\r\n", f"WARC-Payload-Digest: sha1:{sha1}", http=chunked),
        member("response", body, "WARC-Payload-Digest: other:1", http=b""),
        member("revisit", b"", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:3>", http=ok),
    ]
    (tmp_path / "a b.warc.gz").write_bytes(b"".join(parts))
    rows = warc.read_warc_files(spark, str(tmp_path)).collect()
    assert [r["record_type"] for r in rows] == ["warcinfo", "request", "response", "response", "response", "revisit"]
    assert [bytes(r["payload"]) for r in rows[2:5]] == [body] * 3
    assert {r["payload_digest"] for r in rows[2:5]} == {hashlib.sha256(body).hexdigest()}
    assert (rows[5]["payload_digest"], rows[5]["refers_to"], rows[0]["record_id"], rows[2]["url"]) == (f"sha1:{sha1}", None, "<urn:uuid:1>", "http://a")
    wrong = member("response", body + b"x", f"WARC-Payload-Digest: sha1:{sha1}", http=ok)
    short = member("response", b"20\r\nabc", http=chunked)
    for raw in (wrong, short, gzip.compress(b"WARC/1.0\r\n\r\nx"), gzip.compress(b"none")):
        with pytest.raises(warc.WarcError):
            warc.parse(next(warc.members(raw)))


def test_saved_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = common.cut(warc.write_archives(pages, archive_bytes=2000))
    saved = warc.save_archives(archives, str(tmp_path / "out")).collect()
    assert sum(r["records"] for r in saved) == len(PAGES)
    assert sorted(str(p) for p in (tmp_path / "out").iterdir()) == sorted({r["path"] for r in saved})
    key = lambda rows: sorted((str(r["page_id"]), r["payload_digest"], r["record_type"]) for r in rows)
    assert key(warc.read_warc_files(spark, str(tmp_path / "out"), with_payload=False).collect()) == key(warc.read_archives(archives).collect())
    with pytest.raises(ValueError, match="mounted"):
        warc.save_archives(archives, "s3://x/y")


def test_members_from_a_handle(monkeypatch):
    good = b"".join(warc.record(i, "u", b"x" * i, "response", None, hashlib.sha256(b"x" * i).hexdigest()) for i in range(30))
    for size in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", size)
        assert [len(warc.parse(m)[2]) for m in warc.members(io.BytesIO(good))] == list(range(30))


def test_damage_is_found():
    good = warc.record(1, "u", b"hello", "response", None, hashlib.sha256(b"hello").hexdigest())
    assert warc.parse(next(warc.members(good)))[2] == b"hello"
    with pytest.raises(warc.WarcError, match="ends inside"):
        list(warc.members(good[:-9]))
    with pytest.raises(warc.WarcError):
        list(warc.members(good + b"junk"))
    bad = warc.record(1, "u", b"hello", "response", None, "0" * 64)
    with pytest.raises(warc.WarcError, match="payload digest"):
        warc.parse(next(warc.members(bad)))
    raw = next(warc.members(good)).replace(b"hello", b"jello")
    with pytest.raises(warc.WarcError, match="block digest"):
        warc.parse(raw)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).collect() == []
