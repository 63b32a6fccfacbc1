"""Toxicity scores from the nearest labelled examples.

Documents and examples are TF-IDF vectors over all features of the examples; the nearest examples by exact
cosine come from an inverted index. Short posting lists are read whole; long ones lie in blocks of examples
with their largest weights, so that blocks which can't reach the k-th best similarity so far are never
opened. The neighbours vote with weights that grow as the distance shrinks, and a monotone curve fitted on
the examples' own left-out votes turns votes into probabilities.

The examples are a bounded sample of the labelled rows (`max_examples`, by a hash of the id). Features are
words and word beginnings, all that the sample has. A weight is (1 + ln tf) * idf * relevance: document
frequencies are of all documents, and relevance, learned on the sample, tells how unevenly the labels fall on
the documents that have a feature, towards either label; no feature has none of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
MAX_EXAMPLES, NEIGHBOURS = 12_000, 25
#: Relevance of a feature whose documents have labels like all others; the G2 up to which that may be chance, and
#: what it takes beyond that for half of the rest.
LEAST_RELEVANCE, CHANCE_G2, HALF_G2 = 0.05, 4.0, 16.0
#: Bytes of a word's beginnings that are features of their own.
BEGINNINGS = (5, 6, 7)
#: Vectors of a block; a list is long, and read by blocks, if over 1 / LONG of all vectors are on it.
_BLOCK, _LONG = 64, 16
#: Queries that are searched together.
_TOGETHER = 256
#: Texts whose results a worker remembers for their copies; others are searched again.
_KNOWN = 40_000


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and beginning, and the number of words per text; A-Z are lowered."""
    w = C.Words(col, lower=True, gaps=C.NOT_ALNUM)
    owner = w.text_of_word()
    owners, hashes = [owner], [w.hash]
    size = w.end - w.start
    for n in BEGINNINGS:
        longer = np.flatnonzero(size > n)
        owners.append(owner[longer])
        hashes.append(C.mix(C.span_hash(w.data, w.start[longer], w.start[longer] + n) + _U(n)))
    return np.concatenate(owners), np.concatenate(hashes), np.diff(w.of)


@dataclass
class Lookup:
    """Places of known hashes, by a table of where the hashes that begin with the same bits are."""

    terms: np.ndarray
    first: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.terms = np.sort(np.asarray(self.terms, dtype=_U))
        bits = max(8, min(22, len(self.terms).bit_length() + 1))
        self.shift = _U(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.terms >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are known, in order; their places)."""
        head = (hashes >> self.shift).view(np.int64)
        place, end = self.first[head], self.first[head + 1]
        found = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(place < end)
        place, end = place[at], end[at]
        while len(at):
            same = self.terms[place] == hashes[at]
            found[at[same]] = place[same]
            place += 1
            more = ~same & (place < end)
            at, place, end = at[more], place[more], end[more]
        at = np.flatnonzero(found >= 0)
        return at, found[at]

    def counts(self, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the known hashes, ordered by text and term."""
        at, place = self.places(hashes)
        bits = len(self.terms).bit_length()
        pair, tf = np.unique((owner[at] << bits) + place, return_counts=True)
        return pair >> bits, pair & ((1 << bits) - 1), tf


_POSTING = np.dtype([("place", "<i4"), ("weight", "<f4")])


class BlockMaxIndex:
    """Exact cosine top-k over weighted unit vectors, given as entries (vector, term, weight).

    Vectors that share their heaviest long-listed terms lie together in blocks of _BLOCK. Of the terms with long
    lists a block holds a dense piece and the largest weight of each; a query first opens the blocks of
    the highest bounds, and its k-th best similarity then tells which of the others could still matter. All
    other lists are short and added up whole before."""

    def __init__(self, vector: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n, self.blocks = n, max(1, -(-n // _BLOCK))
        size = np.bincount(term, minlength=n_terms)
        long_terms = np.flatnonzero(size > max(n // _LONG, _BLOCK // 4))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[long_terms] = np.arange(len(long_terms), dtype=np.int32)
        is_long = self.column[term] >= 0
        lead = [np.full(n, -1, np.int64) for _ in range(2)]
        o = np.flatnonzero(is_long)
        o = o[np.lexsort((term[o], -weight[o], vector[o]))]
        rank = np.arange(len(o)) - np.searchsorted(vector[o], vector[o])
        for i, x in enumerate(lead):
            x[vector[o[rank == i]]] = self.column[term[o[rank == i]]]
        self.order = np.lexsort((np.arange(n), lead[1], lead[0]))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.dense = np.zeros((self.blocks, len(long_terms), _BLOCK), np.float32)
        at = place[vector[is_long]]
        self.dense[at // _BLOCK, self.column[term[is_long]], at % _BLOCK] = weight[is_long]
        self.peak = self.dense.max(axis=2, initial=0.0)
        o = np.flatnonzero(~is_long)
        o = o[np.argsort(term[o].astype(np.int64) * n + place[vector[o]])]
        self.start = np.searchsorted(term[o], np.arange(n_terms + 1))
        posted = np.empty(len(o), _POSTING)
        posted["place"], posted["weight"] = place[vector[o]], weight[o]
        self.posted = posted.view("<i8")  # both halves in one read, the place in the lower one
        self.full = np.arange(self.blocks * _BLOCK) < n

    def search(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, opened: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, similarity), the k most similar vectors of every query in order, ties to the lower
        place of the index; vectors without any shared term aren't found. The queries are entries ordered by query."""
        if not self.n or not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        width = self.blocks * _BLOCK
        col = self.column[term]
        o = np.flatnonzero(col < 0)
        who, size_of = owner[o], self.start[term[o] + 1] - self.start[term[o]]
        short = np.zeros((n, width), np.float32)
        cut = np.searchsorted(who, np.arange(n + 1)).tolist()
        ends = np.r_[0, np.cumsum(size_of)]
        begin = self.start[term[o]] - ends[:-1]
        count, light = np.arange(np.diff(ends[cut]).max()), weight[o].astype(np.float32)
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):  # one query's entries stay in the cache
            if ends[b] > ends[a]:
                size = size_of[a:b]
                at = np.repeat(begin[a:b] + ends[a], size)
                at += count[: len(at)]
                got = self.posted.take(at, mode="clip")
                each = np.repeat(light[a:b], size)
                each *= got.view(_POSTING)["weight"]
                np.add.at(short[i], got & 0xFFFFFFFF, each)
        short = short.reshape(n, self.blocks, _BLOCK)
        q = np.zeros((n, self.dense.shape[1]), np.float32)
        q[owner[col >= 0], col[col >= 0]] = weight[col >= 0]
        bound = q @ self.peak.T + short.max(axis=2)
        score = np.full((n, self.blocks, _BLOCK), -1.0, np.float32)

        def open_blocks(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(axis=0)):
                some = np.flatnonzero(need[:, b])
                score[some, b] = short[some, b] + q[some] @ self.dense[b]

        opened = min(max(opened, -(-k // _BLOCK) + 1), self.blocks)
        top = np.argpartition(-bound, opened - 1, axis=1)[:, :opened]
        first = np.zeros((n, self.blocks), bool)
        np.put_along_axis(first, top, True, axis=1)
        open_blocks(first)
        score.reshape(n, width)[:, ~self.full] = -1.0
        seen = score[np.arange(n)[:, None], top].reshape(n, -1)
        last = max(0, seen.shape[1] - k)
        # The k-th best so far is a bound for the k-th best of all, which the rest is sorted from.
        least = np.maximum(np.partition(seen, last, axis=1)[:, last], 1e-9)
        open_blocks(~first & (bound + 1e-5 >= least[:, None]))
        flat = score.reshape(n, width)
        flat[:, ~self.full] = -1.0
        who, where = np.nonzero(flat >= least[:, None])
        s = flat[who, where]
        order = np.lexsort((where, -s, who))
        who, where, s = who[order], where[order], s[order]
        good = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[good], self.order[where[good]], s[good]


_READY: dict[str, "Model"] = {}


@dataclass
class Model:
    """The distinct vectors of the examples; `toxic` of the `total` examples with a vector are labelled 1, ids
    names one of them."""

    terms: np.ndarray  # sorted hashes
    scale: np.ndarray  # idf * relevance
    folder: str  # the examples' features, a table in the shared folder that workers read themselves
    classes: dict[bytes, int]  # vector of each digest
    toxic: np.ndarray
    total: np.ndarray
    ids: list
    prior: float
    k: int
    curve_x: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    curve_y: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def start(self) -> "Model":
        """This model with its index, kept by the Python worker for its next tasks."""
        ready = _READY.get(self.token)
        if ready is None:
            _READY.clear()
            self.lookup = Lookup(self.terms)
            self.index = BlockMaxIndex(*self.entries(), len(self.ids), len(self.terms))
            self.known: dict[int, dict[bytes, tuple]] = {}
            _READY[self.token] = ready = self
        ready.curve_x, ready.curve_y = self.curve_x, self.curve_y
        return ready

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, term, weight) of the distinct vectors."""
        import pyarrow.parquet as pq

        fs, root = C.as_fs(self.folder)
        owner, term, tf, seen = [], [], [], set()
        for info in fs.get_file_info(pa.fs.FileSelector(root)):
            if not info.path.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(256, columns=["digest", "hashes", "tf"]):
                    for digest, h, n in zip(*(c.to_pylist() for c in batch.columns)):
                        if (i := self.classes.get(digest)) is not None and i not in seen:
                            seen.add(i)
                            h = np.frombuffer(h, "<u8")
                            owner.append(np.full(len(h), i, np.int32))
                            term.append(np.searchsorted(self.terms, h).astype(np.int32))
                            tf.append(np.frombuffer(n, "<i4"))
        if not owner:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        owner, term, tf = (np.concatenate(x) for x in (owner, term, tf))
        return owner, term, unit_weights(owner, term, tf, self.scale, len(self.ids))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lookup", "index", "known")}

    def vectors(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (text, term, weight) of the unit vectors of texts."""
        owner, hashes, _ = features(col)
        owner, term, tf = self.lookup.counts(owner, hashes)
        return owner, term, unit_weights(owner, term, tf, self.scale, len(col))

    def votes(self, owner, term, weight, n: int, without: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Raw votes of n queries, and the neighbours (query, vector, similarity). The k nearest examples vote;
        of examples that tie as one vector and don't all fit, each counts in part. Left out: of query i, one
        example with vector without[i] that is labelled own[i]."""
        q, e, s = self.index.search(owner, term, weight, n, self.k + (without is not None))
        pos, have = self.toxic[e], self.total[e]
        if without is not None:
            mine = e == without[q]
            pos, have = pos - np.where(mine, own[q], 0.0), have - mine
        before = np.cumsum(have) - have
        first = np.searchsorted(q, q)
        take = np.clip(self.k - (before - before[first] if len(q) else before), 0, have)
        w = take / np.maximum(have, 1.0) * s / (1.02 - np.minimum(1.0, s)) ** 2
        hits = np.bincount(q, weights=w * pos, minlength=n)
        whole = np.bincount(q, weights=w * have, minlength=n)
        return (hits + 2 * self.prior) / (whole + 2), (q, e, s)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.curve_x, self.curve_y), 0.0, 1.0)


def unit_weights(owner: np.ndarray, term: np.ndarray, tf: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
    weight = (1 + np.log(tf)) * scale[term] if len(tf) else np.zeros(0)
    norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=n))
    return (weight / np.maximum(norm[owner], 1e-12)).astype(np.float32)


def relevance(n: np.ndarray, pos: np.ndarray, all_n: float, all_pos: float) -> np.ndarray:
    """From LEAST_RELEVANCE up, by the G2 of the labels of the n examples (pos of them toxic) that have a feature."""
    n, pos = n.astype(float), pos.astype(float)

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    share = n / max(all_n, 1.0)
    neg, all_neg = n - pos, all_n - all_pos
    g2 = 2 * (part(pos, all_pos * share) + part(neg, all_neg * share) + part(all_pos - pos, all_pos * (1 - share)) + part(all_neg - neg, all_neg * (1 - share)))
    more = np.maximum(0.0, g2 - CHANCE_G2)
    return LEAST_RELEVANCE + more / (more + HALF_G2)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators curve as points of increasing x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        blocks.append([a, b, c, a * c])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            last = blocks.pop()
            p = blocks[-1]
            total = p[2] + last[2]
            p[1], p[3], p[2] = (p[1] * p[2] + last[1] * last[2]) / total, p[3] + last[3], total
    xs, ys = np.array([b[3] / b[2] for b in blocks]), np.array([(b[1] * b[2] + 0.05) / (b[2] + 0.1) for b in blocks])
    ys = np.maximum.accumulate(ys)
    return xs, ys


def train_rows(labels: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Labelled rows outside the held-out fold; null labels and ids are dropped."""
    return labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """train: (id, label) rows, of which those of at most max_examples ids are used: a bound on what the driver
    holds. Of rows with equal ids the largest label counts, and the least text. Ids without a document have no
    vector; examples without words vote for texts without known features."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sample = train.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_examples)
    sample = C.stored(sample, "examples")
    # At most max_examples narrow rows are broadcast.
    body = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    texts = C.stored(body.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")), "example-texts")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, hashes, _ = features(batch.column(2))
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])][: len(h)])
        tf = np.diff(np.r_[new, len(h)]).astype("<i4")
        cut = np.searchsorted(o[new], np.arange(batch.num_rows + 1))
        h = h[new].astype("<u8")
        spans = list(zip(cut[:-1], cut[1:]))
        hs, ns = ([x[a:b].tobytes() for a, b in spans] for x in (h, tf))
        digest = [hashlib.md5(x + n).digest() if x else b"" for x, n in zip(hs, ns)]
        return C.pa_batch(_id=batch.column(0), _y=batch.column(1), digest=pa.array(digest, pa.binary()), hashes=pa.array(hs, pa.binary()), tf=pa.array(ns, pa.binary()))

    found = C.stored(C.arrow_map(texts.select("_id", "_y", "_text"), words, f"_id {kind}, _y int, digest binary, hashes binary, tf binary"), "example-features")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()]
            y = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in h])
            term, at = np.unique(np.concatenate(h) if h else np.zeros(0, _U), return_inverse=True)
            yield C.pa_batch(term=term.view(np.int64), n=np.bincount(at, minlength=len(term)).astype(np.int64), pos=np.bincount(at, weights=y, minlength=len(term)).astype(np.int64))

    # A row per feature of at most max_examples texts, and one per example.
    counts = found.select("_y", "hashes").mapInArrow(C.lean(tally), "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()
    terms, in_n, in_pos = (counts.column(c).to_numpy() for c in ("term", "n", "pos"))
    order = np.argsort(terms.view(_U))
    terms, in_n, in_pos = terms.view(_U)[order], in_n[order], in_pos[order]
    rows = found.select("_id", "_y", "digest").toArrow().sort_by("_id")
    ids, y, digests = rows.column("_id").to_pylist(), np.array(rows.column("_y").to_pylist(), np.int64), rows.column("digest").to_pylist()
    lookup, v = Lookup(terms), len(terms)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(v + 1, "<i8"), 0
        for batch in (b for whole in batches for b in C.cut(whole)):
            own, h, n_words = features(batch.column(0))
            seen += len(n_words)
            df[:v] += np.bincount(lookup.counts(own, h)[1], minlength=v)
        df[v] = seen
        yield C.pa_batch(part=np.arange(0, v + 1, _PART), df=pa.array([df[a : a + _PART].tobytes() for a in range(0, v + 1, _PART)], pa.binary()))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<i8") for x in group.column("df").to_pylist()]
        return pa.table({"part": group.column("part")[:1], "df": pa.array([np.sum(parts, axis=0).astype("<i8").tobytes()], pa.binary())})

    # A row per _PART features and task, then one per _PART features.
    counted = body.select("_text").mapInArrow(C.lean(frequency), "part long, df binary").groupBy("part").applyInArrow(C.lean(add), "part long, df binary").toArrow().sort_by("part")
    df = np.frombuffer(b"".join(counted.column("df").to_pylist()), "<i8") if counted.num_rows else np.zeros(v + 1, np.int64)
    n, pos = len(ids), int(y.sum())
    scale = (np.log1p(df[v] / (1.0 + df[:v])) * relevance(in_n, in_pos, n, pos)).astype(np.float32)
    # Equal vectors are one, named by the least id.
    classes: dict[bytes, int] = {}
    of = np.array([classes.setdefault(x, len(classes)) if x else -1 for x in digests], np.int64).reshape(-1)
    empty = of < 0
    lead = np.full(len(classes), n, np.int64)
    np.minimum.at(lead, of[~empty], np.flatnonzero(~empty))
    prior = (float(y[empty].sum()) + 0.5 * pos / max(n, 1)) / (float(empty.sum()) + 0.5)
    toxic, total = (np.bincount(of[~empty], weights=x, minlength=len(classes)) for x in (y[~empty], np.ones(int((~empty).sum()))))
    model = Model(terms, scale, found._stored_at, classes, toxic, total, [ids[i] for i in lead], prior, k)
    if len(classes):
        own = dict(zip(ids, of.tolist()))

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.start()
            for batch in (b for whole in batches for b in slices(whole)):
                where = np.array([own[i] for i in batch.column(0).to_pylist()], np.int64)
                label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                raw = m.votes(*m.vectors(batch.column(2)), batch.num_rows, where, label)[0]
                yield C.pa_batch(raw=np.where(where < 0, m.prior, raw), y=label)

        # One pair of numbers per example.
        seen = texts.select("_id", "_y", "_text").mapInArrow(C.lean(left_out), "raw double, y double").toArrow()
        raw, label = (seen.column(c).to_numpy() for c in ("raw", "y"))
        order = np.lexsort((label, raw))
        model.curve_x, model.curve_y = isotonic(raw[order], label[order], np.ones(len(raw)))
    return model


#: Features whose document frequencies travel as one row.
_PART = 1 << 14


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Batches of at most _TOGETHER rows and about STEP_BYTES of text."""
    for part in C.cut(batch):
        for at in range(0, part.num_rows, _TOGETHER):
            yield part.slice(at, _TOGETHER)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, evidence), a row per input row; evidence: the nearest examples' ids and
    similarities. Null and empty texts, and texts without a known feature, get the rate of such examples. Only
    id and text are read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.start()
        known = m.known.setdefault(evidence, {})
        for batch in (b for whole in batches for b in slices(whole)):
            keys = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in batch.column(1).to_pylist()]
            here = {k: known[k] for k in keys if k in known}
            new = {k: i for i, k in enumerate(keys) if k not in here}
            if new:
                n = len(new)
                raw, (q, e, sim) = m.votes(*m.vectors(batch.column(1).take(pa.array(list(new.values())))), n)
                raw[np.bincount(q, minlength=n) == 0] = m.prior
                best = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < evidence)
                near: list[list] = [[] for _ in range(n)]
                for i, x, y in zip(q[best].tolist(), e[best].tolist(), sim[best].tolist()):
                    near[i].append((x, round(y, 6)))
                made = dict(zip(new, zip(m.probability(raw).tolist(), near)))
                here |= made
                if len(known) > _KNOWN:
                    known.clear()
                known.update(made)
            p = np.array([here[k][0] for k in keys])
            near = [[{"example": str(m.ids[x]), "similarity": y} for x, y in here[k][1]] for k in keys]
            yield C.pa_batch(doc_id=batch.column(0), score=p, predicted=(p >= 0.5).astype(np.int32), evidence=pa.array(near, pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64())]))))

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(C.lean(run), f"doc_id {kind}, score double, predicted int, evidence array<struct<example string, similarity double>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, train_rows(C.table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
