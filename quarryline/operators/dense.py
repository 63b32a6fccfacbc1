"""Exact dense retrieval by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lexical import top_k
from .scoring import half_up

#: Queries and vectors of one product of matrices; queries of one pass, which come to the driver and to every task.
QUERY_BLOCK, VECTOR_BLOCK, PASS = 256, 4096, 65_536
#: Rows that may be near, kept before they are cut.
HELD = 1 << 20


def live_vectors(segments: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Of (id, seg_ord, v): the newest vector of each id, of live ids only."""
    newest = segments.groupBy("id").agg(F.max_by("v", "seg_ord").alias("v"))
    return newest.join(live.select("id"), "id", "left_semi") if live is not None else newest


def search(queries: DataFrame, vectors: DataFrame, k: int = 60, where: Column | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest of (id, v) for each query (qid, qv), ties by id.

    A filter acts before the ranking and changes no score. Each task multiplies its vectors with the queries, a
    block by a block, sums again in double precision what may be among the best, and keeps k rows per query, so that
    only those are shuffled; for more than QUERY_BLOCK queries vectors are first spread evenly over the cores. Unusable query vectors are an error; vectors that aren't usable or
    have another dimension are never found."""
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "qid string, id string, score double, rank int")
    base = (vectors.filter(where) if where is not None else vectors).select("id", "v")
    n, out = queries.count(), None
    if n > QUERY_BLOCK:
        base = base.repartition(base.sparkSession.sparkContext.defaultParallelism, "id")
    unit = base.select("id", V.normalize(F.col("v")).alias("v")).filter(F.col("v").isNotNull())
    ready = queries.select("qid", F.when(V.usable(F.col("qv")), V.normalize(F.col("qv"))).otherwise(F.raise_error(F.lit("query vector must be finite and not zero"))).alias("qv"))
    passes = max(1, -(-n // PASS))
    for p in range(passes):
        part = ready.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p) if passes > 1 else ready
        one = _best_of_tasks(part, unit, k)
        out = one if out is None else out.unionByName(one)
    return top_k(out, k)


def _matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each dimension."""
    sizes = np.asarray(pc.list_value_length(vectors))
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return {int(sizes[0]): (np.arange(len(sizes)), flat.reshape(len(sizes), -1))}
    return {int(d): (np.flatnonzero(sizes == d), flat[np.repeat(sizes == d, sizes)].reshape(-1, d)) for d in np.unique(sizes)}


def _best_of_tasks(queries: DataFrame, unit: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): for each query (qid, qv) the k nearest of each task's unit vectors (id, v), ties by id."""
    asked = queries.toArrow().combine_chunks()
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(unit.dtypes)['id']}, score double"
    if not asked.num_rows:
        return unit.sparkSession.createDataFrame([], schema)
    qids = asked.column("qid").combine_chunks()
    shipped = unit.sparkSession.sparkContext.broadcast((qids, _matrices(asked.column("qv").combine_chunks())))
    query_block, vector_block = QUERY_BLOCK, VECTOR_BLOCK

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked = shipped.value
        mine: dict[int, list] = {}
        for batch in batches:
            for d, (rows, m) in _matrices(batch.column(1)).items():
                if d in asked:
                    mine.setdefault(d, []).append((batch.column(0).take(pa.array(rows)), m.copy()))
        for d, parts in mine.items():
            ids = pa.concat_arrays([i for i, _ in parts])
            v = np.concatenate([m for _, m in parts])
            parts.clear()
            order = pc.sort_indices(ids).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows, m = asked[d]
            for a in range(0, len(rows), query_block):
                q = m[a : a + query_block]
                at, row, score = _nearest(q, v, place, k, vector_block)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(rows[a + at])), ids.take(pa.array(row)), pa.array(score)], names=["qid", "id", "score"])

    return unit.mapInArrow(nearest, schema)


def _nearest(q: np.ndarray, v: np.ndarray, place: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest rows of v for each of q, by rounded score, then place.

    Products in single precision tell which rows may be among them; those alone are summed in double precision."""
    # Four times what such a product of unit vectors can be off, and the rounding.
    slack = q.shape[1] * 2.4e-7 + 1e-8
    bound = np.full(len(q), -np.inf)
    at, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    qt = q.astype(np.float64).T.copy()

    def tightened() -> tuple[np.ndarray, ...]:
        i, j, near = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((-near, i))
        i, j, near = i[o], j[o], near[o]
        kth = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
        bound[i[kth]] = np.maximum(bound[i[kth]], near[kth] - slack)
        keep = near >= bound[i]
        return i[keep], j[keep], near[keep]

    def summed(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal at, row, score
        for c in range(0, len(i), 1 << 17):
            x, y = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
            some, y_of = np.unique(y, return_inverse=True)
            vt = v[some].T.astype(np.float64)
            s = np.zeros(len(x))
            for a, b in zip(qt, vt):  # from left to right, as the sum is defined
                s += a[x] * b[y_of]
            at, row, score = np.r_[at, x], np.r_[row, y], np.r_[score, half_up(s)]
            o = np.lexsort((place[row], -score, at))
            at, row, score = at[o], row[o], score[o]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            last = np.flatnonzero(rank == k - 1)
            bound[at[last]] = np.maximum(bound[at[last]], score[last] - slack)
            at, row, score = at[rank < k], row[rank < k], score[rank < k]

    for b in range(0, len(v), block):
        near = q @ v[b : b + block].T
        if not b and near.shape[1] > k:
            bound = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k].astype(np.float64) - slack
        # The bound in single precision, rounded down.
        i, j = np.nonzero(near >= np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None])
        held.append((i, j + b, near[i, j]))
        n += len(i)
        if n > HELD:
            held = [tightened()]
            if (n := len(held[0][0])) > HELD // 2:  # many that are as near as the k-th
                summed(*held[0][:2])
                held, n = [], 0
    if held:
        summed(*tightened()[:2])
    return at, row, score


def check_rows(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: rows, distinct ids, rows of a wrong dimension, rows that aren't usable, and whether all is well."""
    one = vectors.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.count_if(F.size("v") != dim).alias("wrong_dim"), F.count_if(~V.usable(F.col("v"))).alias("unusable"))
    return one.withColumn("valid", (F.col("n_rows") == F.col("n_ids")) & (F.col("wrong_dim") == 0) & (F.col("unusable") == 0))


def within_envelope(vectors: DataFrame, most: int = 400_000) -> bool:
    """Whether at most `most` vectors are there; counts no further than that."""
    return vectors.limit(most + 1).count() <= most
