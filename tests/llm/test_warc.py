import base64
import gzip
import hashlib
import io
import os

import pytest

from quarryline.llm import warc as W

SCHEMA = "page_id long, url string, html string, refers_to string, digest string"
ROWS = [(3, "http://a/é ü", "same"), (1, None, "same"), (2, "x\r\ny", None), (9, "u", ""), (5, "u", "same"), (7, "http://b", "<p>" + "ab" * 200_000), (8, "u", "漢字\r\n\r\nWARC/1.1"), (None, "n", "same"), (None, "n", "alone"), (1, "again", "same")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "r", "d") for r in rows], SCHEMA)


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize("chunk", [1, 1000, 1 << 20])
def test_round_trip(spark, chunk):
    rows = ROWS if chunk > 1 else [r for r in ROWS if r[0] != 7]
    got = sorted(map(tuple, W.round_trip(pages(spark, rows), chunk_bytes=chunk).collect()), key=str)
    want = []
    for i, _, t in rows:
        ids = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        first = min(ids) if ids else None
        want.append((i, len((t or "").encode()), digest(t), "response" if first is None or i == first else "revisit", None if first is None or i == first else first))
    assert got == sorted(want, key=str)


def test_small_payloads_never_revisit(spark):
    got = W.round_trip(pages(spark), least_bytes=5).collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 5)


def test_empty_table(spark):
    assert W.round_trip(pages(spark, [])).count() == 0


def test_chunks_hold_the_payload(spark, tmp_path):
    folder = str(tmp_path / "w")
    files = W.write(pages(spark), folder)
    rows = W.read(spark, files, folder, 4096).collect()
    big = sorted((r for r in rows if r["page"] == "7"), key=lambda r: r["chunk_no"])
    assert b"".join(r["data"] for r in big).decode() == ROWS[5][2] and max(len(r["data"]) for r in big) == 4096
    assert [r["last"] for r in big] == [False] * (len(big) - 1) + [True]
    for r in big[:3]:
        assert r["sha1"] == digest(ROWS[5][2][: r["offset"] + len(r["data"])])
    raw = b"".join(gzip.decompress((tmp_path / "w" / n).read_bytes()) for n in sorted(os.listdir(folder)))
    assert raw.count(b"WARC/1.1\r\n") >= len(ROWS) and b"identical-payload-digest" in raw


def test_damage_is_an_error():
    out = io.BytesIO()
    W._write_record(out, "1", "u", b"payload" * 100, None, "d")
    raw = gzip.decompress(out.getvalue())
    assert list(W.read_records(io.BytesIO(gzip.compress(raw)), 64))[-1]["last"]
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(gzip.compress(raw[:-50])), 64))
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(gzip.compress(b"HTTP" + raw)), 64))


def test_query_equals_sql(spark, sf, duck, same):
    same(W.query(spark, sf), duck.sql(W.ORACLE))


def test_records_of_other_writers():
    def record(version, kind, block, *more):
        head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", f"Content-Length: {len(block)}", *more]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    data = b"".join([
        record("WARC/1.0", "warcinfo", b"software: any\r\n\r\n", "Content-Type: application/warc-fields"),
        record("WARC/1.0", "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("WARC/1.0", "response", http + b"body\r\n\r\nmore", "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha256:00"),
        record("WARC/1.1", "response", b"no head at all", "Content-Type: application/http"),
        record("WARC/1.1", "metadata", b""),
        record("WARC/1.1", "revisit", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:ABC"),
    ])
    for chunk in (3, 1000):
        got = list(W.read_records(io.BytesIO(data), chunk))
        whole, at = [], b""
        for r in got:
            at += r["data"]
            if r["last"]:
                whole.append((r["record_type"], at, r["stated_digest"], r["read_bytes"]))
                assert r["sha1"] == base64.b32encode(hashlib.sha1(at).digest()).decode()
                at = b""
        assert whole == [("warcinfo", b"software: any\r\n\r\n", None, 17), ("request", b"", None, 0), ("response", b"body\r\n\r\nmore", None, 12), ("response", b"no head at all", None, 14), ("metadata", b"", None, 0), ("revisit", b"", "ABC", 0)]
