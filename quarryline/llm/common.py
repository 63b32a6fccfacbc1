"""Shared pieces of the training-data operators: tables in the shared folder, vectorised
word scanning over Arrow buffers, prefix-scan numbering and skew-safe lookups."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of letters, digits and anything beyond ASCII.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Text bytes that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: The same where many arrays of numbers per byte of text are made.
SMALL_STEP = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tables that cut lineage ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where a session
    names none (tests) a folder of this machine is made, set in the session and removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: a lost executor costs no
    recomputation beyond this table, and Python stages run once."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a stored() table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_stored_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- Python workers' memory -----------------------------------------------------------------


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(fn: Callable) -> Callable:
    """fn over batches (a generator) or over a group, with trim() when a task or group is done."""
    import inspect
    from functools import wraps

    if inspect.isgeneratorfunction(fn):

        @wraps(fn)
        def run(batches):
            try:
                yield from fn(batches)
            finally:
                trim()
    else:

        @wraps(fn)
        def run(key, group):
            try:
                return fn(key, group)
            finally:
                trim()

    return run


# --- Arrow helpers -------------------------------------------------------------------------


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, most: int = STEP_BYTES) -> DataFrame:
    """mapInArrow over batches cut to about `most` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(lean(run), schema)


def cut(batch: pa.RecordBatch, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            sizes += np.diff(_offsets(col))
    if not sizes.sum() > most:
        if batch.num_rows:
            yield batch
        return
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32) if col.buffers()[1] else np.zeros(1, np.int32)
    return raw[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    off = _offsets(col)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
    data = data[off[0] : off[-1]] if len(off) else data
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a string column, found in its byte buffer.

    start, end: byte places; of: the words of text i are of[i]:of[i + 1]; hash: 64-bit hashes of
    their bytes (letters A-Z lowered first if lower)."""

    def __init__(self, col: pa.Array, lower: bool = False, hashes: bool = True, gaps: np.ndarray = _WS):
        data, self.off = text_buffer(col)
        if lower and len(data):
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        word = ~gaps[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.off] = True
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[:1] = False
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[:-1] = word[1:]
        after[-1:] = False
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.of = np.searchsorted(self.start, self.off)
        if hashes:
            self.hash = span_hash(data, self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, (SMALL_STEP if n <= SMALL_STEP + 4096 else STEP_BYTES) + 4096), base, dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        _POWERS[base] = have if n <= 4 * STEP_BYTES else _POWERS.get(base, have[: STEP_BYTES + 4096])
    return have[:n]


_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PI, _QI = pow(_P, -1, 1 << 64), pow(_Q, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans by one prefix sum."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_P, n), dtype=_U, out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_PI, n + 1)[start])


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes (runs across texts are the caller's to drop)."""
    if len(words) < n:
        return np.zeros(0, dtype=_U)
    sums = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * _powers(_Q, len(words)), dtype=_U, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _powers(_QI, len(words) + 1)[: len(words) - n + 1])


def pa_batch(**columns) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


# --- numbering without a global sort into one task -----------------------------------------


def numbered(df: DataFrame, groups: list[str], label: str, local: str = "_local", part: str = "_part") -> DataFrame:
    """df as a stored table with _part, the task that made a row, and _local, the row's place from 0
    among that task's rows of its group. Rows aren't moved; the places of a group over all tasks
    follow from the counts by prefix_offsets()."""
    spec = T.StructType([*df.schema.fields, T.StructField(part, T.LongType()), T.StructField(local, T.LongType())])
    names = df.columns
    idx = [names.index(g) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in idx)))
            place = np.empty(len(keys), dtype=np.int64)
            for i, k in enumerate(keys):
                place[i] = n = seen.get(k, 0)
                seen[k] = n + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), pid, np.int64)), pa.array(place)], names=[*names, part, local])

    return stored(df.mapInArrow(run, spec), label)


def prefix_offsets(numbered_df: DataFrame, groups: list[str], part: str = "_part") -> DataFrame:
    """(groups, _part, _base, _count): the rows of the group in the tasks before, and in this one. The
    window runs over one row per task and group, never over the rows themselves."""
    from pyspark.sql import Window

    counts = numbered_df.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_count"))
    w = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_base", F.coalesce(F.sum("_count").over(w), F.lit(0)))


# --- skew-safe lookup ----------------------------------------------------------------------

#: A key is hot when it has over 1/HOT of the rows; there are less than HOT such keys, a proven bound.
HOT = 256


def lookup(rows: DataFrame, found: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined with found, which has one row per key and in `weight` the number of rows that carry it.

    Keys that hold over 1/HOT of all rows (fewer than HOT keys whatever the data) are broadcast, so
    that their rows stay where they are; all others go through a shuffled join whose largest key is
    bounded by that share. A null key meets the null key."""
    total = found.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    least = max(1, total // HOT)
    hot = found.filter(F.col(weight) > least)
    cold = found.filter(F.col(weight) <= least)
    keys = [r[0] for r in hot.select(key).collect()]  # fewer than HOT
    if not keys:
        return _null_safe(rows, found, key, how)
    named = [k for k in keys if k is not None]
    is_hot = F.col(key).isin(named) if named else F.lit(False)
    is_hot = F.coalesce(is_hot, F.lit(False)) | (F.col(key).isNull() if len(named) < len(keys) else F.lit(False))
    return _null_safe(rows.filter(is_hot), F.broadcast(hot), key, how).unionByName(_null_safe(rows.filter(~is_hot), cold, key, how))


def _null_safe(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    name = fresh("__key", a, b)
    right = b.withColumnRenamed(key, name)
    return a.join(right, F.col(key).eqNullSafe(F.col(name)), how).drop(name)


def fresh(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores behind it as it takes for none of the tables to have it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches_of(it: Iterator, n: int) -> Iterator[list]:
    it = iter(it)
    while part := list(itertools.islice(it, n)):
        yield part


def as_fs(uri: str):
    """(pyarrow file system, path) of a shared folder: file:, hdfs:, s3: or gs:."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.join("/", uri[5:].lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


#: Rows up to which a list of ids (and what hangs on them) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows. df should be a stored table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is among the (stored) ids; a null id is only removed by a null."""
    name = fresh("__gone", docs)
    gone = if_small(ids.select(F.col(id_col).alias(name)))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
