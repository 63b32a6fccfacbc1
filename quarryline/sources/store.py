"""Immutable revisions of an index: segments as Parquet, a manifest per revision, an atomic pointer."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

SCHEMA = 2


@dataclass
class FileEntry:
    content_hash: str
    chunk_count: int
    segment_id: str
    bytes: int = 0
    covered_chunks: int = 0


@dataclass
class SegmentRef:
    id: str
    checksum: str
    chunks: int = 0
    vectors: int = 0


@dataclass
class Manifest:
    revision: str
    previous: str | None = None
    schema_version: int = SCHEMA
    files: dict[str, FileEntry] = field(default_factory=dict)
    segments: list[SegmentRef] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    vector_count: int = 0
    embedding_profile: str = ""
    created_at: float = 0.0

    def problems(self) -> list[str]:
        """What is structurally wrong; empty if nothing is."""
        known = {s.id for s in self.segments}
        out = [f"unknown schema {self.schema_version}"] if self.schema_version != SCHEMA else []
        out += ["revision without a name"] if not self.revision else []
        out += ["a segment is listed twice"] if len(known) != len(self.segments) else []
        out += [f"{p}: segment {e.segment_id} is not listed" for p, e in self.files.items() if e.segment_id not in known]
        out += [f"{p}: live and a tombstone" for p in self.tombstones if p in self.files]
        return out

    @property
    def garbage(self) -> float:
        total = sum(s.chunks for s in self.segments)
        dead = total - sum(e.chunk_count for e in self.files.values())
        return dead / total if total and dead > 0 else 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, data: str) -> "Manifest":
        """A manifest of either schema: version 1 has one segment, named as its revision."""
        d = json.loads(data)
        version = d.get("schema_version", 1)
        if version == 1:
            files = {p: FileEntry(e["content_hash"], e["chunk_count"], d["revision"], e.get("bytes", 0), e.get("covered_chunks", 0)) for p, e in d.get("files", {}).items()}
            seg = SegmentRef(d["revision"], d.get("checksum", ""), sum(e.chunk_count for e in files.values()), d.get("vector_count", 0))
            return cls(d["revision"], d.get("previous"), SCHEMA, files, [seg], [], d.get("vector_count", 0), d.get("embedding_profile", ""), d.get("created_at", 0.0))
        if version != SCHEMA:
            raise ValueError(f"unknown manifest schema {version}")
        d["files"] = {p: FileEntry(**e) for p, e in d["files"].items()}
        d["segments"] = [SegmentRef(**s) for s in d["segments"]]
        return cls(**d)


def write_atomic(path: str, data: str) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def folder_checksum(path: str) -> str:
    """Of a segment: names, sizes and digests of its data files."""
    h = hashlib.sha256()
    for base, _, names in sorted(os.walk(path)):
        for n in sorted(names):
            if not n.startswith((".", "_")):
                with open(os.path.join(base, n), "rb") as f:
                    h.update(f"{os.path.relpath(os.path.join(base, n), path)}\0{hashlib.file_digest(f, 'sha256').hexdigest()}\0".encode())
    return h.hexdigest()


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Store:
    """revisions/<rev>.json, segments/<id>/, staging/, CURRENT."""

    def __init__(self, root: str, keep: int = 2):
        self.root, self.keep = root, keep
        for d in ("revisions", "segments", "staging"):
            os.makedirs(os.path.join(root, d), exist_ok=True)

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def stage(self) -> tuple[str, str]:
        """(segment id, folder to write it to)."""
        sid = uuid.uuid4().hex[:16]
        return sid, self.path("staging", sid)

    def add_segment(self, sid: str) -> SegmentRef:
        os.replace(self.path("staging", sid), self.path("segments", sid))
        return SegmentRef(sid, folder_checksum(self.path("segments", sid)))

    def publish(self, m: Manifest) -> Manifest:
        """Manifest first, then the pointer: a reader sees the old revision or the new one."""
        if m.problems():
            raise ValueError("; ".join(m.problems()))
        m.created_at = m.created_at or time.time()
        write_atomic(self.path("revisions", f"{m.revision}.json"), m.to_json())
        write_atomic(self.path("CURRENT"), m.revision)
        return m

    def load(self, revision: str) -> Manifest:
        with open(self.path("revisions", f"{revision}.json"), encoding="utf-8") as f:
            return Manifest.from_json(f.read())

    def verify(self, m: Manifest) -> bool:
        return not m.problems() and all(os.path.isdir(self.path("segments", s.id)) and folder_checksum(self.path("segments", s.id)) == s.checksum for s in m.segments)

    def current(self) -> str | None:
        try:
            with open(self.path("CURRENT"), encoding="utf-8") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def usable(self, depth: int = 16) -> Manifest | None:
        """The newest revision that is whole, from the pointer back along the chain."""
        rev, seen = self.current(), set()
        while rev and rev not in seen and len(seen) < depth:
            seen.add(rev)
            try:
                m = self.load(rev)
            except (OSError, ValueError, KeyError, TypeError):
                return None
            if self.verify(m):
                return m
            rev = m.previous
        return None

    def collect(self) -> list[str]:
        """Remove revisions but the newest `keep` of the chain, then segments that none of those names, and
        what was staged but never published. Returns the segments removed."""
        kept, rev = [], self.current()
        while rev and len(kept) < self.keep and rev not in kept:
            kept.append(rev)
            try:
                rev = self.load(rev).previous
            except (OSError, ValueError):
                break
        for name in os.listdir(self.path("revisions")):
            if name.removesuffix(".json") not in kept:
                os.remove(self.path("revisions", name))
        named = {s.id for r in kept for s in self.load(r).segments}
        gone = [s for s in os.listdir(self.path("segments")) if s not in named]
        for s in gone:
            shutil.rmtree(self.path("segments", s), ignore_errors=True)
        for s in os.listdir(self.path("staging")):
            shutil.rmtree(self.path("staging", s), ignore_errors=True)
        return sorted(gone)


class Lock:
    """A lock file with a heartbeat; one whose heart stopped may be taken over."""

    def __init__(self, path: str, stale: float = 60.0, beat: float = 10.0):
        self.path, self.stale, self.beat, self.token = path, stale, beat, uuid.uuid4().hex
        self._stop = threading.Event()

    def acquire(self) -> bool:
        data = json.dumps({"token": self.token, "pid": os.getpid()})
        for _ in range(2):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                with os.fdopen(fd, "w") as f:
                    f.write(data)
                threading.Thread(target=self._heart, daemon=True).start()
                return True
            except FileExistsError:
                try:
                    if time.time() - os.stat(self.path).st_mtime <= self.stale:
                        return False
                    os.replace(self.path, aside := f"{self.path}.{self.token}")
                    os.remove(aside)
                except FileNotFoundError:
                    pass
        return False

    def held(self) -> bool:
        try:
            with open(self.path) as f:
                return json.load(f)["token"] == self.token
        except (OSError, ValueError, KeyError):
            return False

    def _heart(self) -> None:
        while not self._stop.wait(self.beat):
            if self.held():
                os.utime(self.path)

    def release(self) -> None:
        self._stop.set()
        if self.held():
            os.remove(self.path)


class Journal:
    """Vectors paid for but not published: Parquet appended by batch, and the keys that were rejected."""

    def __init__(self, spark, root: str, dim: int):
        self.spark, self.root, self.dim = spark, root, dim

    def _read(self, name: str, schema: str):
        path = os.path.join(self.root, name)
        return self.spark.read.schema(schema).parquet(path) if os.path.isdir(path) else self.spark.createDataFrame([], schema)

    def entries(self):
        return self._read("vectors", "embed_key string, v array<float>, ord long").dropDuplicates(["embed_key"])

    def rejected(self):
        return self._read("rejected", "embed_key string").distinct()

    def append(self, df) -> None:
        from pyspark.sql import functions as F

        bad = F.raise_error(F.lit("journal dimension differs")).cast("array<float>")
        new = df.join(self.entries().select("embed_key"), "embed_key", "left_anti")
        new.select("embed_key", F.when(F.size("v") == self.dim, F.col("v")).otherwise(bad).alias("v"), F.lit(time.time_ns()).alias("ord")).write.mode("append").parquet(os.path.join(self.root, "vectors"))

    def reject(self, keys) -> None:
        keys.select("embed_key").write.mode("append").parquet(os.path.join(self.root, "rejected"))

    def compact(self, published) -> None:
        """Drop what a revision has published; the rest is written anew and swapped in."""
        path, draft = os.path.join(self.root, "vectors"), os.path.join(self.root, f"vectors-{uuid.uuid4().hex}")
        self.entries().join(published.select("embed_key"), "embed_key", "left_anti").write.parquet(draft)
        shutil.rmtree(path, ignore_errors=True)
        os.replace(draft, path)
