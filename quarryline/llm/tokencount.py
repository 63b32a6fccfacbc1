"""Token counts of documents in flat, unindexed token files.

A file is nothing but little-endian token ids, an end-of-document id after each document. Blocks of
fixed size are searched for that id on their own; what a block can't know, how many documents ended
before it and where the last one did, is a running count and a running maximum over one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import EOD, FastBpe, vocabulary

BLOCK_TOKENS = 1 << 20
_DTYPE = {2: "<u2", 4: "<u4"}


def width_of(vocab: str, end_id: int = EOD) -> int:
    """Bytes of an id in flat files: 2 if the largest id of the vocabulary (a line per token) and end_id fit, else 4."""
    with open(vocab, "rb") as f:
        most = max((int(line.split()[1]) for line in f if line.strip()), default=0)
    return 2 if max(most, end_id) < 1 << 16 else 4


def write_flat(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = EOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as flat files of ids, one per task, into folder; a stored table (file, ordinal, doc_id) of what
    came where. Ids have 2 bytes where all of the vocabulary's fit, else 4 (width_of). The marker's own string in a text is ordinary text, so end_id stands
    only at ends. A retried task writes the same file again and replaces it in one step."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = vocab or vocabulary()
    dtype = _DTYPE[width_of(path, end_id)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = C.as_fs(folder)
        name, bpe, at = f"part-{task.partitionId():07d}.bin", FastBpe.at(path, False), 0
        fs.create_dir(root, recursive=True)
        draft = f"{root}/_{name}.{task.taskAttemptId()}"
        tail = np.array([end_id], dtype).tobytes()
        with fs.open_output_stream(draft) as out:
            for batch in (b for whole in batches for b in C.cut(whole, 4 << 20)):
                for text in batch.column(1).to_pylist():
                    out.write(bpe.encode(text).astype(dtype).tobytes() + tail)
                yield C.pa_batch(file=pa.array([name] * batch.num_rows), ordinal=np.arange(at, at + batch.num_rows), doc_id=batch.column(0))
                at += batch.num_rows
        fs.move(draft, f"{root}/{name}")

    return C.stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(C.lean(run), f"file string, ordinal long, doc_id {kind}"), "flat-order")


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the .bin files of a folder."""
    from pyarrow import fs as pfs

    fs, root = C.as_fs(folder)
    found = [i for i in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True)) if i.is_file and i.path.endswith(".bin")]
    return spark.createDataFrame([(i.base_name, i.size) for i in found], "file string, bytes long")


def scan(files: DataFrame, folder: str, end_id: int = EOD, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended), a row per document: its number and first token in the file,
    and its tokens without the separator. Tokens after a file's last separator are a document with
    ended = false. Empty files have none; a file that isn't a whole number of ids is an error."""
    spark = files.sparkSession
    dtype = _DTYPE[width]
    step = block_tokens * width
    blocks = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step).cast("long"))).alias("block"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.as_fs(folder)
        for batch in batches:
            for name, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes aren't whole ids")
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(min(step, size - block * step)), dtype=dtype)
                at = np.flatnonzero(ids == end_id) + block * block_tokens
                n = len(at)
                yield C.pa_batch(file=pa.array([name] * n, pa.string()), block=np.full(n, block, np.int64), place=np.arange(n, dtype=np.int64), pos=at, prev=pa.array(np.r_[0, at[:-1]][:n], mask=np.arange(n) == 0) if n else pa.array([], pa.int64()))

    spread = blocks.repartition(C.partitions(spark), "file", "block")
    seps = C.stored(spread.mapInArrow(C.lean(find), "file string, block long, place long, pos long, prev long"), "separators")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = seps.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    carry = per_block.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("since"))
    docs = seps.join(carry, ["file", "block"])
    docs = docs.select("file", (F.col("before") + F.col("place")).alias("ordinal"), (F.coalesce("prev", "since") + 1).alias("start"), F.col("pos").alias("end"), F.lit(True).alias("ended"))
    last = per_block.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    rest = files.join(last, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), F.floor(F.col("bytes") / width).alias("end"), F.lit(False).alias("ended")).filter(F.col("start") < F.col("end"))
    return docs.unionByName(rest).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def count_tokens(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens), a row per input row: docs written flat and counted from the
    files alone. Null and empty texts have 0 tokens; repeated rows and null ids are rows of their own."""
    spark = docs.sparkSession
    folder = C.scratch(spark, "flat")
    order = write_flat(docs, folder, vocab, EOD, id_col, text_col)
    width = width_of(vocab or vocabulary())
    found = C.stored(scan(flat_files(spark, folder), folder, EOD, width, block_tokens), "token-counts")
    fs, root = C.as_fs(folder)
    if order.limit(1).count():
        fs.delete_dir(root)
    return order.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"))
