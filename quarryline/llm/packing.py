"""Harmonic packing of token sequences.

Documents are sorted into reciprocal-capacity classes: class k holds lengths over capacity / (k + 1) and up to
capacity / k, and a bin of the class takes exactly k of them, so a document's bin follows from its number
within its class. Every worker fills the bins of all its classes on its own, with a document count that is
fixed by the class, and numbers its own bins; one count per worker, summed up over the workers before it,
makes the numbers global. Documents over the capacity fill whole bins first.

What bins leave open is bounded by the volume of the worker's unfinished bins: beyond that the next document
goes to an open rest instead of its class, whole into the smallest that takes it, and cut only where none
does. What long documents leave over, which is cut already, goes there first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C
from .tokens import FastBpe, vocabulary

#: The last class; shorter documents belong to it too.
CLASSES = 32


class Packer:
    """One worker's bins. A piece is (owner, tokens of the document, start, length); placed pieces gather in
    `out` as (piece, bin, offset)."""

    def __init__(self, capacity: int = 2048, grain: int = 8, classes: int = CLASSES):
        self.capacity, self.grain, self.classes = capacity, grain, min(classes, capacity)
        self.bins: dict[int, list[tuple]] = {}
        self.rests: list[tuple[int, int, int]] = []  # (tokens left, bin, tokens there), in order
        self.held = self.open = 0  # tokens in unfinished bins, and those left open in finished ones
        self.n_bins = 0
        self.out: list[tuple] = []

    def add(self, owner, tokens: bytes) -> None:
        n, at = len(tokens) // 4, 0
        while n - at >= self.capacity:
            self.out.append(((owner, tokens, at, self.capacity), self.n_bins, 0))
            self.n_bins += 1
            at += self.capacity
        if at < n:
            self._place((owner, tokens, at, n - at), at > 0)

    def _place(self, piece: tuple, loose: bool) -> None:
        while True:
            n = piece[3]
            i = bisect_left(self.rests, (n,))
            more = loose or self.open > self.held
            if i < len(self.rests) and (more or n * self.classes < self.capacity or self.rests[i][0] - n <= 2 * self.grain):
                return self._fill(i, piece)
            if not (more and self.rests):
                return self._to_class(piece)
            owner, tokens, at, n = piece
            part = self.rests[-1][0]
            self._fill(len(self.rests) - 1, (owner, tokens, at, part))
            piece = (owner, tokens, at + part, n - part)

    def _fill(self, i: int, piece: tuple) -> None:
        left, number, at = self.rests.pop(i)
        self.out.append((piece, number, at))
        self.open -= left
        self._leave(left - piece[3], number, at + piece[3])

    def _leave(self, left: int, number: int, at: int) -> None:
        if left >= self.grain:
            insort(self.rests, (left, number, at))
            self.open += left

    def _to_class(self, piece: tuple) -> None:
        k = min(self.capacity // piece[3], self.classes)
        mates = self.bins.setdefault(k, [])
        mates.append(piece)
        self.held += piece[3]
        if len(mates) == k:
            at = 0
            for p in self.bins.pop(k):
                self.out.append((p, self.n_bins, at))
                at += p[3]
            self.held -= at
            self._leave(self.capacity - at, self.n_bins, at)
            self.n_bins += 1

    def finish(self) -> None:
        """Pieces of unfinished bins go to open rests, and then to bins that they fill one after the other."""
        last = sorted((p for b in self.bins.values() for p in b), key=lambda p: -p[3])
        self.bins, self.held = {}, 0
        whole = []
        for p in last:
            i = bisect_left(self.rests, (p[3],))
            if i < len(self.rests):
                self._fill(i, p)
            else:
                whole.append(p)
        for p in whole:
            if not self.rests or self.rests[-1][0] < min(p[3], self.capacity // 8):
                self.n_bins += 1
                self._leave(self.capacity, self.n_bins - 1, 0)
            self._place(p, True)
            for k in list(self.bins):  # what no rest took begins a bin
                for q in self.bins.pop(k):
                    self.held -= q[3]
                    self.out.append((q, self.n_bins, 0))
                    self._leave(self.capacity - q[3], self.n_bins, q[3])
                    self.n_bins += 1


def pieces(docs: DataFrame, capacity: int = 2048, grain: int = 8, vocab: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A stored table (doc_id, start, length, ids_crc32, doc_tokens, bin, offset, _part[, ids]), bins numbered from 0
    in each task."""
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    path = vocab or vocabulary()
    tail = np.array([end_id], dtype="<u4").tobytes()

    def rows(placed: list[tuple], pid: int) -> pa.RecordBatch:
        made = np.array([(at, n, zlib.crc32(tokens[4 * at : 4 * (at + n)]), len(tokens) // 4, number, off, pid) for (_, tokens, at, n), number, off in placed], dtype=np.int64).reshape(-1, 7).T
        named = dict(zip(("start", "length", "ids_crc32", "doc_tokens", "bin", "offset", "_part"), made))
        extra = {"ids": pa.array([np.frombuffer(tokens[4 * at : 4 * (at + n)], "<u4").astype(np.int32) for (_, tokens, at, n), _, _ in placed], pa.list_(pa.int32()))} if ids else {}
        return C.pa_batch(doc_id=pa.array([p[0] for p, _, _ in placed], arrow), **named, **extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, pid, packer = FastBpe.at(path, True), TaskContext.get().partitionId(), Packer(capacity, grain)
        for batch in (b for whole in batches for b in C.cut(whole, 4 << 20)):
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(owner, bpe.encode_bytes(text) + tail)
            yield rows(packer.out, pid)
            packer.out = []
        packer.finish()
        yield rows(packer.out, pid)

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long, _part long" + ", ids array<int>" * ids
    return C.stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(C.lean(run), schema), "pieces")


def pack(docs: DataFrame, capacity: int = 2048, grain: int = 8, vocab: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    Every token, the end id of each document included, lies in exactly one piece; a null or empty text is its end
    id alone. Rests under `grain` tokens stay open. Repeated rows and ids, or null ids, are packed like any
    others. Other columns aren't carried. An empty table gives no piece."""
    if capacity < 1 or not 0 < grain <= capacity:
        raise ValueError("capacity must be positive and grain within it")
    made = pieces(docs, capacity, grain, vocab, end_id, id_col, text_col, ids)
    # The window runs over one row per task.
    counts = made.groupBy("_part").agg((F.max("bin") + 1).alias("n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = C.stored(counts.select(F.col("_part"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before")), "bins-before")
    placed = made.join(C.if_small(base), "_part")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("bin")).alias("sequence_id"), "offset", *["ids"] * ids)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
