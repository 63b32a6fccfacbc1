"""Directory scans: the listing is walked by rules, contents are read by the cluster."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from . import ignore as IG

MOST_BYTES, MOST_TEXT_BYTES = 1 << 20, 4 << 20


@dataclass
class Listing:
    root: str
    files: list[tuple[str, int, float]] = field(default_factory=list)
    denied: int = 0
    vanished: int = 0


def resolve_root(path: str) -> str:
    root = os.path.realpath(os.path.expanduser(path))
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {path}")
    return root


def list_files(path: str, include_file: str = IG.INCLUDE_FILE, progress=None) -> Listing:
    """(relative path, size, mtime) of the regular files that the rules leave, sorted. Version-control folders
    and secrets never come in, whatever a rule says. What may not be read is counted, what vanishes
    meanwhile is passed over, and any other failure is one of the scan."""
    out = Listing(resolve_root(path))

    def rules_at(rel: str) -> list[IG.Rule]:
        def read(name: str) -> str | None:
            try:
                with open(os.path.join(out.root, rel, name), encoding="utf-8", errors="replace") as f:
                    return f.read()
            except (FileNotFoundError, NotADirectoryError, PermissionError, IsADirectoryError):
                return None

        return IG.rules_of_dir(read, rel, include_file)

    def walk(rel: str, rules: list[IG.Rule]) -> None:
        try:
            entries = sorted(os.scandir(os.path.join(out.root, rel)), key=lambda e: e.name)
        except PermissionError:
            out.denied += 1
            return
        except FileNotFoundError:
            out.vanished += 1
            return
        for e in entries:
            sub = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in text.VCS_DIRS and IG.enter_dir(rules, sub):
                    walk(sub, rules + rules_at(sub))
            elif e.is_file(follow_symlinks=False) and not secret(sub) and not IG.ignored(rules, sub, False):
                try:
                    st = e.stat()
                except FileNotFoundError:
                    out.vanished += 1
                    continue
                out.files.append((sub, st.st_size, st.st_mtime))
                if progress and len(out.files) % 500 == 0:
                    progress(len(out.files))

    walk("", IG.default_rules() + rules_at(""))
    out.files.sort()
    return out


def secret(rel: str) -> bool:
    name = rel.rpartition("/")[2].strip().lower()
    return name.startswith(".env") or name in text.SECRET_NAMES or (("." in name) and name.rpartition(".")[2] in text.SECRET_EXTENSIONS)


def gate(data: bytes) -> str:
    """ok, empty, oversize, binary or blank. Text may be MOST_TEXT_BYTES long; what isn't text is binary."""
    if not data:
        return "empty"
    if len(data) > MOST_TEXT_BYTES:
        return "oversize"
    if b"\x00" in data:
        return "binary"
    try:
        return "ok" if data.decode("utf-8").strip() else "blank"
    except UnicodeDecodeError:
        return "binary"


def read_files(spark: SparkSession, listing: Listing, cache: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """(path, size, mtime, gate, content, blob) of listed files. Contents are read by tasks, not by the driver.

    cache: (path, size, mtime, blob) of a previous scan; a file of the same size and time that isn't
    fresher than two seconds keeps its identity and its content isn't read (null)."""
    root = listing.root
    rows = spark.createDataFrame(listing.files or [], "path string, size long, mtime double")
    if cache is not None:
        old = cache.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("blob").alias("_b"))
        same = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_t")) & (F.lit(now if now is not None else 4e9) - F.col("mtime") > 2)
        rows = rows.join(old, "path", "left").select("path", "size", "mtime", F.when(same, F.col("_b")).alias("known"))
    else:
        rows = rows.withColumn("known", F.lit(None).cast("string"))

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                states, contents = [], []
                for rel, known in zip(part.column("path").to_pylist(), part.column("known").to_pylist()):
                    content, state = None, "cached"
                    if known is None:
                        try:
                            with open(os.path.join(root, rel), "rb") as f:
                                data = f.read(MOST_TEXT_BYTES + 1)
                            state = gate(data)
                            content = data.decode("utf-8") if state == "ok" else None
                        except FileNotFoundError:
                            state = "vanished"
                        except PermissionError:
                            state = "denied"
                    states.append(state)
                    contents.append(content)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(states), pa.array(contents, pa.string())], names=[*part.schema.names, "gate", "content"])

    n = max(1, min(len(listing.files) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    out = rows.repartition(n, "path").mapInArrow(read, "path string, size long, mtime double, known string, gate string, content string")
    return out.withColumn("blob", F.coalesce("known", ids.blob_name(F.col("path"), F.col("content")))).drop("known")


def scan(spark: SparkSession, path: str, cache: DataFrame | None = None, now: float | None = None) -> DataFrame:
    return read_files(spark, list_files(path), cache, now).filter(F.col("gate").isin("ok", "cached"))
