"""BM25 of a table of queries where the chunks lie: each task scores its own chunks for all queries and sends
the best alone, so that no (query, term, chunk) is ever a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks and clauses that one score matrix holds; best rows kept before they are cut to k; clauses of one pass.
ROWS, CLAUSES, HELD, PASS = 2048, 512, 500_000, 1_000_000


def half_up(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """x rounded, halves away from zero."""
    y = x * 10.0**digits
    return np.copysign(np.floor(np.abs(y) + 0.5), y) / 10.0**digits + 0.0


def row_terms(col: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf) of the terms in lists of words, by code and row, and the rows' numbers of words."""
    n = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
    code = pc.fill_null(pc.index_in(pc.list_flatten(col), value_set=terms), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(code >= 0)
    key, tf = np.unique(code[hit].astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)[hit], return_counts=True)
    return key % max(len(n), 1), key // max(len(n), 1), tf, n


def term_counts(words: DataFrame, col: str) -> DataFrame:
    """(term, df, cf) of a column of word lists, one row per document, added up in its task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = pc.list_flatten(lists).dictionary_encode()
            if not len(flat):
                continue
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            code, rows = flat.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
            docs = np.unique(code.astype(np.int64) * len(n) + rows) // len(n)
            size = len(flat.dictionary)
            yield pa.RecordBatch.from_arrays([flat.dictionary, pa.array(np.bincount(docs, minlength=size)), pa.array(np.bincount(code, minlength=size))], names=["term", "df", "cf"])

    return words.select(col).mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def best(clauses: DataFrame, chunks: DataFrame, words: dict[str, Column], k: int, where: Column | None, formula) -> DataFrame:
    """(qid, id, score): for each query the k best chunks of each task, by rounded score, ties by id.

    clauses: (qid, clause, field, term, boost, need); words: the word lists of each field. formula(tf, dl, df, n, avgdl)
    is a clause term's score on arrays. Statistics are those of all chunks, `where` acts before the ranking. ids must
    be of one row each. Clauses come to the driver, at most about PASS at a time."""
    clauses = clauses.filter(F.col("qid").isNotNull() & F.col("term").isNotNull())
    n = clauses.count()
    out = None
    for p in range(max(1, -(-n // PASS))):
        part = clauses.filter(F.pmod(F.hash("qid"), F.lit(-(-n // PASS))) == p) if n > PASS else clauses
        one = _pass(part, chunks, words, k, where, formula)
        out = one if out is None else out.unionByName(one)
    return out


def _pass(clauses: DataFrame, chunks: DataFrame, words: dict[str, Column], k: int, where: Column | None, formula) -> DataFrame:
    spark = chunks.sparkSession
    asked = clauses.select("qid", "clause", "field", "term", F.col("boost").cast("double").alias("boost"), F.col("need").cast("long").alias("need")).toArrow().combine_chunks()
    kinds = {**dict(clauses.dtypes), **dict(chunks.dtypes)}
    schema = f"qid {kinds['qid']}, id {kinds['id']}, score double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema)
    asked = asked.sort_by([("qid", "ascending"), ("clause", "ascending"), ("field", "ascending"), ("term", "ascending")])
    col = {c: asked.column(c).combine_chunks() for c in asked.column_names}

    def numbered(*names: str) -> np.ndarray:
        new = np.zeros(asked.num_rows, bool)
        for c in names:
            new[1:] |= np.asarray(pc.not_equal(col[c][1:], col[c][:-1]))
        return np.cumsum(new)

    clause, query = numbered("qid", "clause"), numbered("qid")
    again = np.r_[False, np.diff(numbered("qid", "clause", "field", "term")) == 0]
    first = np.flatnonzero(np.r_[True, np.diff(clause) > 0])
    need = np.maximum.reduceat(col["need"].to_numpy(), first)
    query_of = query[first]  # of each clause
    qids = col["qid"].take(pa.array(np.flatnonzero(np.r_[True, np.diff(query) > 0])))
    fields = [f for f in words if pc.any(pc.equal(col["field"], f)).as_py()]
    terms, lists = {}, {}
    for f in fields:
        rows = np.flatnonzero(np.asarray(pc.equal(col["field"], f)))
        own = col["term"].take(pa.array(rows))
        terms[f] = pc.unique(own)
        code = pc.index_in(own, value_set=terms[f]).to_numpy()
        o = np.argsort(code, kind="stable")
        # Of each term: its clauses in order, with boost and whether it counts as a further term.
        lists[f] = (np.searchsorted(code[o], np.arange(len(terms[f]) + 1)), clause[rows][o], col["boost"].to_numpy()[rows][o], ~again[rows][o])
    # Blocks of whole queries.
    edges, at = [0], np.searchsorted(query_of, np.arange(len(qids) + 1))
    while edges[-1] < len(qids):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(at, at[edges[-1]] + CLAUSES, side="right")) - 1))
    shipped = spark.sparkContext.broadcast((terms, lists, need, query_of, qids, edges, at))
    read = chunks.select("id", (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)).alias("_in"), *[F.coalesce(words[f], F.array().cast("array<string>")).alias(f) for f in fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shipped.value[0]
        df, total, n = {f: np.zeros(len(terms[f]), np.int64) for f in fields}, dict.fromkeys(fields, 0), 0
        for batch in batches:
            n += batch.num_rows
            for i, f in enumerate(fields):
                _, code, _, size = row_terms(batch.column(i), terms[f])
                df[f] += np.bincount(code, minlength=len(terms[f]))
                total[f] += int(size.sum())
        for i, f in enumerate(fields):
            code = np.r_[-2, -1, np.flatnonzero(df[f])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i)), pa.array(code), pa.array(np.r_[n, total[f], df[f][code[2:]]])], names=["field", "code", "n"])

    counts = read.select(*fields).mapInArrow(count, "field long, code long, n long").groupBy("field", "code").agg(F.sum("n").alias("n")).toArrow()
    stats = {}
    for i, f in enumerate(fields):
        of = counts.filter(pc.equal(counts["field"], i))
        code, amount = of["code"].to_numpy(), of["n"].to_numpy()
        df = np.zeros(len(terms[f]), np.int64)
        df[code[code >= 0]] = amount[code >= 0]
        n, total = (int(amount[code == c].sum()) for c in (-2, -1))
        stats[f] = (df, n, total / n if n else 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, lists, need, query_of, qids, edges, at = shipped.value
        least, parts, held = np.zeros(len(qids)), [], 0

        def cut() -> pa.Table:
            t = pa.concat_tables(parts).combine_chunks()
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
            q = t["q"].to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = np.flatnonzero(place == k - 1)
            least[q[last]] = t["score"].to_numpy()[last]
            return t.filter(pa.array(place < k))

        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                inside = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False))
                if not len(inside):
                    continue
                batch = batch.take(pa.array(inside))
                found = {}
                for i, f in enumerate(fields):
                    row, code, tf, size = row_terms(batch.column(i + 2), terms[f])
                    df, n, avg = stats[f]
                    here = np.flatnonzero(np.r_[True, np.diff(code) > 0]) if len(code) else np.zeros(0, int)
                    found[f] = (row, formula(tf, size[row], df[code], n, avg), code[here], here, np.r_[here[1:], len(code)])
                for a, b in zip(edges[:-1], edges[1:]):
                    lo, hi = at[a], at[b]
                    matrix = np.zeros((hi - lo, batch.num_rows))
                    needs = need[lo:hi]
                    seen = np.zeros(matrix.shape, np.int32) if needs.any() else None
                    for f in fields:
                        start, its, boost, more = lists[f]
                        row, w, codes, begin, end = found[f]
                        for c, x, y in zip(codes.tolist(), begin.tolist(), end.tolist()):
                            i, j = start[c] + np.searchsorted(its[start[c] : start[c + 1]], (lo, hi))
                            if i == j:
                                continue
                            np.add.at(matrix, (its[i:j, None] - lo, row[None, x:y]), boost[i:j, None] * w[None, x:y]) if not more[i:j].all() else _add(matrix, its[i:j] - lo, row[x:y], boost[i:j, None] * w[None, x:y])
                            if seen is not None:
                                m = more[i:j]
                                _add(seen, its[i:j][m] - lo, row[x:y], 1)
                    if seen is not None:
                        matrix[(needs[:, None] > 0) & (seen != needs[:, None])] = 0
                    total = np.add.reduceat(matrix, at[a:b] - lo, axis=0) if hi - lo > b - a else matrix
                    q, c = np.nonzero((total > 0) & (total >= least[a:b, None] - 1e-9))
                    if not len(q):
                        continue
                    got = half_up(total[q, c])
                    fit = got >= least[a:b][q]
                    parts.append(pa.table({"q": q[fit] + a, "id": batch.column(0).take(pa.array(c[fit])), "score": got[fit]}))
                    held += int(fit.sum())
                    if held > HELD + 2 * k * len(qids):
                        parts = [cut()]
                        held = parts[0].num_rows
        if parts:
            for x in cut().to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([qids.take(x.column(0)), x.column(1), x.column(2)], names=["qid", "id", "score"])

    return read.mapInArrow(score, schema)


def _add(matrix: np.ndarray, i: np.ndarray, j: np.ndarray, x) -> None:
    """matrix[i, j] += x for places that differ."""
    matrix[np.ix_(i, j)] += x
