"""WARC archives written from page tables and read back as a chunked record table.

Reading streams each archive: a payload becomes rows of (record, chunk number) with at most chunk_bytes
bytes each, and the SHA-1 is carried from chunk to chunk, so no record is ever whole in memory. Writing
compresses each record as a gzip member of its own and streams the payload through in pieces as well.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CHUNK = 1 << 20
#: Revisits up to which their ids are broadcast to the writers; beyond, pages are joined by a shuffle.
BROADCAST_REVISITS = 200_000


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page with a smaller id has; payloads under
    least_bytes never revisit. Only digests are shuffled, and groups are reduced before they meet."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    marks = C.stored(pages.filter(F.octet_length(payload) >= least_bytes).select(F.col(id_col).alias("page_id"), F.sha1(F.encode(payload, "UTF-8")).alias("digest")), "digests")
    groups = C.stored(marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")), "digest-groups")
    shared = groups.filter(F.col("n") > 1)
    found = C.lookup(marks, shared, "digest", "n")
    return found.filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page/{page}'.encode()).hexdigest())}>"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into folder, one .warc.gz per task; a stored table (file, records).

    A null payload is empty; a null url is about:blank; of rows with equal ids and equal payloads all are
    responses if the id is the smallest. Null ids revisit the smallest id that isn't null, if any. A
    retried task replaces its file in one step. Other columns aren't carried."""
    spark = pages.sparkSession
    spec = dict(pages.dtypes)[id_col]
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    again = C.stored(revisits(pages, id_col, payload_col, least_bytes), "revisits").withColumnRenamed("page_id", "_again").withColumnRenamed("digest", "_digest")
    if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    # An id may come twice with different payloads, so the digest is part of the key; only marked pages meet a row.
    own = F.sha1(F.encode(F.coalesce("payload", F.lit("")), "UTF-8"))
    plain = plain.join(again, (own == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_again")), "left").select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        fs, root = C.as_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():07d}.warc.gz"
        draft = f"{root}/_{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(draft) as out:
            for batch in (b for whole in batches for b in C.cut(whole, 8 << 20)):
                for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    _write_record(out, page, url, (payload or "").encode("utf-8", "surrogatepass"), refers, date)
                    n += 1
        if n:
            fs.move(draft, f"{root}/{name}")
            yield C.pa_batch(file=[name], records=[n])
        else:
            fs.delete_file(draft)

    return C.stored(plain.mapInArrow(C.lean(run), "file string, records long"), f"archives-{spec}")


def _write_record(out, page: str | None, url: str | None, payload: bytes, refers: str | None, date: str) -> None:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = b32(hashlib.sha1(payload).digest())
    body = payload if refers is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-ID: {quote(page)}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers)}", f"X-Refers-To-Page-ID: {quote(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    out.write(z.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + http))
    for at in range(0, len(body), CHUNK):
        out.write(z.compress(body[at : at + CHUNK]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


class _Members:
    """Bytes of a multi-member gzip file, read forward with a bounded buffer."""

    def __init__(self, f, block: int = 1 << 18):
        self.f, self.block, self.z, self.have, self.left = f, block, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.left, self.z = self.z.unused_data or self.left, zlib.decompressobj(31)
            raw = self.left or self.f.read(self.block)
            if not raw:
                return False
            self.left = b""
            out = self.z.decompress(raw, self.block)
            if self.z.eof:
                self.left = self.z.unused_data
            else:
                self.left = self.z.unconsumed_tail
            if out:
                self.have += out
                return True

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self._more():
            pass
        out, self.have = self.have[:n], self.have[n:]
        return out

    def skip_http(self, left: int) -> int:
        """Go past the HTTP head at the start of a block of `left` bytes; the bytes it takes, 0 if there is none."""
        head = self.take(min(left, 1 << 20))
        at = head.find(b"\r\n\r\n") + 4
        at = at if at > 3 and head[:5] == b"HTTP/" or at > 3 and b" HTTP/" in head[: head.find(b"\r\n")] else 0
        self.have = head[at:] + self.have
        return at

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        while (at := self.have.find(mark)) < 0:
            if len(self.have) > most:
                raise ValueError("header too long")
            if not self._more():
                if self.have.strip():
                    raise ValueError("truncated record")
                return None
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out


def read_records(f, chunk_bytes: int) -> Iterator[dict]:
    """The chunks of every record of an open archive (WARC/1.0 or 1.1), in order. The payload of a block of type
    application/http begins behind its HTTP head; any other block is payload whole. What a record's headers
    don't state is null; digests other than SHA-1 count as not stated."""
    from urllib.parse import unquote

    src = _Members(f)
    while (head := src.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        h = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        left = int(h["content-length"])
        if h.get("content-type", "").lower().startswith("application/http"):
            left -= src.skip_http(left)
        stated = h.get("warc-payload-digest", "")
        common = {
            "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "page": unquote(h["x-page-id"]) if "x-page-id" in h else None,
            "refers_to": unquote(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, "url": h.get("warc-target-uri"),
            "stated_digest": stated.partition(":")[2] if stated.lower().startswith("sha1:") else None, "stated_bytes": int(h["x-payload-length"]) if "x-payload-length" in h else None,
        }
        sha, n, chunk = hashlib.sha1(), 0, 0
        while True:
            data = src.take(min(chunk_bytes, left))
            if len(data) < min(chunk_bytes, left):
                raise ValueError("truncated record")
            sha.update(data)
            left -= len(data)
            yield common | {"chunk_no": chunk, "offset": n, "data": data, "sha1": b32(sha.digest()), "read_bytes": n + len(data), "last": left == 0}
            n += len(data)
            chunk += 1
            if not left:
                break
        if src.take(4) != b"\r\n\r\n":
            raise ValueError("record without an end")


_CHUNKS = "file string, record_id string, record_type string, page string, refers_to string, url string, stated_digest string, stated_bytes long, chunk_no long, offset long, data binary, sha1 string, read_bytes long, last boolean"


def read(spark: SparkSession, files: DataFrame, folder: str, chunk_bytes: int = CHUNK, data: bool = True) -> DataFrame:
    """The record table: a row per chunk with its number, offset, bytes (null unless `data`), and the SHA-1
    and size of the payload up to and with it; `last` marks a record's final chunk. A payload written here that
    doesn't match its stated digest, or a truncated record, is an error; others, whose digests may be of another
    encoding, can be told by stated_digest. An empty payload is one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.as_fs(folder)
        names = [x.strip().split(" ")[0] for x in _CHUNKS.split(",")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    held, size = [], 0
                    for c in read_records(f, chunk_bytes):
                        if c["last"] and c["record_type"] == "response" and c["stated_bytes"] is not None and (c["sha1"], c["read_bytes"]) != (c["stated_digest"], c["stated_bytes"]):
                            raise ValueError(f"{name}: {c['record_id']} doesn't match its digest")
                        if not data:
                            c["data"] = None
                        held.append(c | {"file": name})
                        size += len(c["data"] or b"") + 200
                        if size > C.STEP_BYTES:
                            yield _chunk_batch(held, names)
                            held, size = [], 0
                    if held:
                        yield _chunk_batch(held, names)

    return files.select("file").repartition(C.partitions(spark), "file").mapInArrow(run, _CHUNKS)


def _chunk_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "last": pa.bool_(), **dict.fromkeys(("stated_bytes", "chunk_no", "offset", "read_bytes"), pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, read back from the
    archives written; both figures are of the full payload, for a revisit as its header states them."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    folder = folder or C.scratch(spark, "warc")
    chunks = read(spark, write(pages, folder, id_col, url_col, payload_col, least_bytes), folder, chunk_bytes, data=False)
    own = F.col("record_type") == "response"
    return chunks.filter("last").select(F.col("page").cast(kind).alias("page_id"), F.when(own, F.col("read_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"), F.when(own, F.col("sha1")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(C.table(spark, sf_dir, "pages"))


ORACLE = """
WITH d AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
