"""Content-addressed identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"
PROFILE = ("line-decl", "8")
TEMPLATE = "a2p-v1"


def sha256_hex(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def nul_joined(*parts: Column) -> Column:
    return F.concat_ws(NUL, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_hash(content: Column) -> Column:
    return F.substring(sha256_hex(content), 1, 32)


def chunk_id(path: Column, hash_: Column, start: Column, end: Column, profile: tuple[str, str] = PROFILE) -> Column:
    return F.substring(sha256_hex(nul_joined(F.lit("@".join(profile)), path, hash_, F.concat(start.cast("string"), F.lit("-"), end.cast("string")))), 1, 32)


def embed_key(path: Column, symbol: Column, language: Column, hash_: Column, template: str = TEMPLATE) -> Column:
    return sha256_hex(nul_joined(F.lit(template), path, symbol, language, hash_))


def blob_name(path: Column, content: Column) -> Column:
    return sha256_hex(nul_joined(F.octet_length(path), path, content))


def embedding_profile(provider: str, base_url: str, model: str, dim: int, dtype: str = "float32", template: str = TEMPLATE) -> str:
    import hashlib

    return hashlib.sha256(NUL.join([provider, base_url, model, str(dim), dtype, template]).encode()).hexdigest()[:12]


def workspace_key(path: str, kind: str, os_name: str) -> str:
    import hashlib
    import re

    base = re.sub("[^A-Za-z0-9_-]", "_", path.rstrip("/").rpartition("/")[2])[:32] or "ws"
    return f"{base}-{hashlib.sha256(NUL.join([path, kind, os_name]).encode()).hexdigest()[:12]}"


def fingerprint(options: dict) -> str:
    """A hash of the options that decide what an index holds; key order has no bearing."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
