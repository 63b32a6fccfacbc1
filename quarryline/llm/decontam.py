"""Benchmark decontamination by latent semantic retrieval.

Items and all passages of the corpus are TF-IDF vectors over the items' own terms. A distributed
randomised SVD finds the leading right singular vectors of the passages (items included): a random
block is multiplied by A'A in one pass over the corpus, and the Nystrom form of that product, which is
symmetric, gives the basis from a small eigenproblem. Windows of every document are compared with every item by the cosine in that
basis, save windows that lack the terms without which no match is possible; what is close enough is checked by the longest common subsequence of words, and matches that
are only paraphrases also have to carry the item's answer.

The corpus's words are looked up once; what is kept per document are the places of the items' terms,
from which statistics, SVD, search and verification all follow, since no other word can be part of a
common subsequence. Items are handled in blocks, so that what is broadcast is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C
from .toxicity import Lookup

_U = np.uint64
PASSAGE, STRIDE, ITEMS = 48, 8, 256
#: Bytes of places that a worker looks at together, and passages from which their products are added up.
SLICE_BYTES, ROWS = 1 << 20, 8192
MIN_COSINE, MIN_LCS, SURE_LCS = 0.4, 0.55, 0.75
#: A term of over this share of all passages doesn't count as a sign of an item.
COMMON = 0.05
_SENTENCE = re.compile(r"[.!?]\s+")


class Items:
    """A block of items: their terms, and each item's words as places in them."""

    def __init__(self, rows: list[tuple], answers: list[str | None]):
        self.ids = [r[0] for r in rows]
        texts = pa.array([r[1] or "" for r in rows], pa.string())
        w = C.Words(texts, lower=True, gaps=C.NOT_ALNUM)
        self.lookup = Lookup(np.unique(w.hash))
        place = np.searchsorted(self.lookup.terms, w.hash)
        self.words = [place[a:b] for a, b in zip(w.of[:-1], w.of[1:])]
        self.answers = [self._answer(text, given) for (_, text, *_), given in zip(rows, answers)]

    def _answer(self, text: str | None, given: str | None) -> set[int]:
        """The terms of the answer: the one given, or the item's last sentence of three words or more."""
        if given is None:
            parts = [p for p in _SENTENCE.split(text or "") if len(p.split()) >= 3]
            given = parts[-1] if parts else text or ""
        w = C.Words(pa.array([given], pa.string()), lower=True, gaps=C.NOT_ALNUM)
        at = np.searchsorted(self.lookup.terms, w.hash)
        at = np.minimum(at, len(self.lookup.terms) - 1)
        return set(at[self.lookup.terms[at] == w.hash].tolist()) if len(self.lookup.terms) else set()


def lcs(item: dict[int, int], words: list[int], n: int) -> int:
    """Length of the longest common subsequence of an item of n words, given as the bit mask of each term's
    places, and a list of terms: bit-parallel, one step per word."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def term_places(docs: DataFrame, lookup: Lookup, id_col: str, text_col: str) -> DataFrame:
    """A stored table (doc_id, n_words, pos, term): of every document the places of its words that are
    terms, as packed 4-byte and 2-byte (4-byte beyond 65,536 terms) numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    wide = _term_type(len(lookup.terms))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = C.Words(batch.column(1), lower=True, gaps=C.NOT_ALNUM)
        at, place = lookup.places(w.hash)
        place = place.astype(wide)
        cuts = np.searchsorted(at, w.of)
        pos = (at - np.repeat(w.of[:-1], np.diff(cuts))).astype("<u4")
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return C.pa_batch(doc_id=batch.column(0), n_words=np.diff(w.of).astype(np.int64), pos=pa.array([pos[a:b].tobytes() for a, b in spans], pa.binary()), term=pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()))

    return C.stored(C.arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), one, f"doc_id {kind}, n_words long, pos binary, term binary", C.SMALL_STEP), "term-places")


def _term_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


class Slices:
    """(n_words, lengths, pos, term) arrays of record batches of term_places, cut to about SLICE_BYTES."""

    def __init__(self, batches: Iterator[pa.RecordBatch], wide: str):
        self.batches, self.wide = batches, wide

    def __iter__(self):
        for whole in self.batches:
            for b in C.cut(whole, SLICE_BYTES):
                (pos, at), (term, _) = (C.text_buffer(b.column(c)) for c in ("pos", "term"))
                yield b, b.column("n_words").to_numpy(), np.diff(at) // 4, pos.view("<u4").astype(np.int64), term.view(self.wide).astype(np.int64)


def _passage_entries(size, pos, term, n_terms: int, keep: np.ndarray | None = None):
    """Distinct (passage, term) with tf, passages being PASSAGE words each, numbered within the slice."""
    owner = np.repeat(np.arange(len(size)), size)
    if keep is not None:
        good = keep[term]
        owner, pos, term = owner[good], pos[good], term[good]
    chunk = pos // PASSAGE
    new = np.ones(len(pos), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (chunk[1:] != chunk[:-1])
    number = np.cumsum(new) - 1
    pair, tf = np.unique(number * n_terms + term, return_counts=True)
    return pair // n_terms, pair % n_terms, tf


def _unit(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.bincount(number, weights=weight * weight))
    return weight / norm[number]


def _add_gram_times(out: np.ndarray, number, term, weight, block: np.ndarray) -> None:
    """Add A'A times block to out, for rows of A given by their entries (ordered by row). Rows of as many
    entries are multiplied together; the way back is a product per term."""
    if not len(number):
        return
    w = weight.astype(np.float32)
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    size = np.diff(np.r_[starts, len(number)])
    y = np.zeros((len(starts), block.shape[1]), np.float32)
    for m in np.unique(size):
        rows = np.flatnonzero(size == m)
        for some in np.array_split(rows, max(1, len(rows) * int(m) // 4096)):
            at = starts[some][:, None] + np.arange(m)
            y[some] = np.matmul(w[at][:, None, :], block[term[at]])[:, 0]
    row = np.repeat(np.arange(len(starts)), size)
    order = np.argsort(term.astype(np.uint32), kind="stable")
    t = term[order]
    cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(t)]):
        some = order[a:b]
        out[t[a]] += w[some] @ y[row[some]]


def _summed(places: DataFrame, fn, width: int) -> np.ndarray:
    """The sum over all tasks of fn(slices), an array of a fixed number of rows of `width` floats."""
    spark = places.sparkSession

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fn(batches)
        rows = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            yield C.pa_batch(row=some.astype(np.int64), part=pa.array([total[i].astype("<f8").tobytes() for i in some], pa.binary()))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.column("row").to_numpy()
        data = np.frombuffer(b"".join(group.column("part").to_pylist()), "<f8").reshape(-1, width)
        ids, inverse = np.unique(rows, return_inverse=True)
        out = np.zeros((len(ids), width))
        np.add.at(out, inverse, data)
        return pa.table({"row": ids, "part": pa.array([x.tobytes() for x in out], pa.binary())})

    parts = places.mapInArrow(C.lean(part), "row long, part binary").groupBy(F.pmod("row", F.lit(C.partitions(spark))).alias("b")).applyInArrow(add, "row long, part binary")
    found = parts.toArrow()  # one row per term of the block of items: bounded
    size = int(np.max(found.column("row").to_numpy(), initial=-1)) + 1
    out = np.zeros((size, width))
    for row, data in zip(found.column("row").to_pylist(), found.column("part").to_pylist()):
        out[row] = np.frombuffer(data, "<f8")
    return out


def _padded(x: np.ndarray, rows: int) -> np.ndarray:
    return x if len(x) >= rows else np.vstack([x, np.zeros((rows - len(x), x.shape[1]))])


def latent_basis(places: DataFrame, items: Items, extra: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idf, telling, basis): inverse passage frequencies, which terms tell items apart, and the leading
    right singular vectors of the passages' and items' unit TF-IDF rows, a column each."""
    v = len(items.lookup.terms)
    wide = _term_type(v)

    def frequency(batches):
        df, n = np.zeros(v), 0.0
        for _, n_words, size, pos, term in Slices(batches, wide):
            number, t, _ = _passage_entries(size, pos, term, v)
            df += np.bincount(t, minlength=v)
            n += float(np.ceil(n_words / PASSAGE).sum())
        return np.r_[df, n][:, None]

    counts = _padded(_summed(places, frequency, 1), v + 1)[:, 0]
    n_passages = max(counts[v], 1.0)
    df = counts[:v]
    idf = np.log1p(n_passages / (1.0 + df))
    telling = df <= max(2.0, COMMON * n_passages)
    for w in items.words:  # an item of common terms only is found by those
        if len(w) and telling[np.unique(w)].sum() < 3:
            telling[w] = True
    own_row = np.repeat(np.arange(len(items.words)), [len(w) for w in items.words])
    own_term = np.concatenate(items.words) if items.words else np.zeros(0, np.int64)
    good = telling[own_term]
    pair, tf = np.unique(own_row[good] * v + own_term[good], return_counts=True)
    row, term = pair // v, pair % v
    weight = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(items.words)))
    weight = weight / np.maximum(norm[row], 1e-12)
    width = int(min(v, len(items.words) + extra))
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))[0] if v else np.zeros((0, 0))
    # Each item weighs as much as the passages that its least common terms are in.
    strong = math.sqrt(max(1.0, float(np.median(df[telling])) if telling.any() else 1.0))

    b32 = block.astype(np.float32)

    def run(batches):
        total, held, n = np.zeros((v, width)), [], 0
        for _, n_words, size, pos, t in Slices(batches, wide):
            number, t, tf = _passage_entries(size, pos, t, v, telling)
            if len(number):
                held.append((number + n, t, _unit(number, (1 + np.log(tf)) * idf[t])))
                n += int(number[-1]) + 1
            if n > ROWS:
                _add_gram_times(total, *(np.concatenate(x) for x in zip(*held)), b32)
                held, n = [], 0
        if held:
            _add_gram_times(total, *(np.concatenate(x) for x in zip(*held)), b32)
        return total

    if not width:
        return idf, telling, block
    image = _padded(_summed(places, run, width), v)
    _add_gram_times(image, row, term, weight * strong, b32)
    # Nystrom: A'A is close to image (block' image)^-1 image', made stable by a small shift.
    shift = 1e-6 * np.linalg.norm(image)
    image = image + shift * block
    small = block.T @ image
    root = np.linalg.cholesky((small + small.T) / 2 + 1e-9 * np.trace(small) / width * np.eye(width))
    left, _, _ = np.linalg.svd(np.linalg.solve(root, image.T).T, full_matrices=False)
    return idf, telling, left


def search(places: DataFrame, items: Items, idf, telling, basis, item_type: T.DataType = T.LongType(), min_cosine=MIN_COSINE, min_lcs=MIN_LCS, sure_lcs=SURE_LCS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, cosine, lcs, answer) of the best match of each document and
    item (by lcs, then cosine; of equal ones the first in the document); words are runs of letters, digits and bytes beyond ASCII, counted from 0."""
    v = len(items.lookup.terms)
    wide, kind = _term_type(v), places.schema["doc_id"].dataType.simpleString()
    lengths = np.array([len(w) for w in items.words])
    # A common subsequence of min_lcs has at least so many of the item's telling words.
    common = np.array([int((~telling[w]).sum()) if len(w) else 0 for w in items.words])
    need = np.maximum(1, np.ceil(min_lcs * lengths - 1e-9).astype(np.int64) - common)
    reach = np.ceil(1.6 * lengths).astype(np.int64) + STRIDE
    pairs = np.array(sorted({(int(t), i) for i, w in enumerate(items.words) for t in np.unique(w) if telling[t]}), np.int64).reshape(-1, 2)
    of_term = np.searchsorted(pairs[:, 0], np.arange(v + 1))
    base32 = basis.astype(np.float32)
    q = np.zeros((len(items.words), basis.shape[1]), np.float32)
    for i, w in enumerate(items.words):
        t, tf = np.unique(w[telling[w]] if len(w) else w, return_counts=True)
        if len(t):
            x = ((1 + np.log(tf)) * idf[t]) @ basis[t]
            q[i] = x / max(np.linalg.norm(x), 1e-12)
    masks = [_masks(w) for w in items.words]
    answers, ids, arrow_type = items.answers, items.ids, to_arrow_type(item_type)

    def windows(o, p, t):
        """(text, item, first word) of the stretches that have the telling words a match needs."""
        n = of_term[t + 1] - of_term[t]
        entry = np.repeat(np.arange(len(t)), n)
        item = pairs[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(of_term[t], n), 1]
        o, p = o[entry], p[entry]
        order = np.lexsort((p, item, o))
        o, p, item = o[order], p[order], item[order]
        last = np.arange(len(o)) + need[item] - 1
        ok = last < len(o)
        last = np.minimum(last, len(o) - 1)
        ok &= (o[last] == o) & (item[last] == item) & (p[last] - p < reach[item])
        o, p, item = o[ok], p[ok], item[ok]
        # Of stretches that begin in one cell of STRIDE words the first is enough: it is as long again.
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (item[1:] != item[:-1]) | (p[1:] // STRIDE != p[:-1] // STRIDE)
        return o[new], item[new], p[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, size, pos, term in Slices(batches, wide):
            cuts = np.r_[0, np.cumsum(size)]
            owner = np.repeat(np.arange(len(size)), size)
            good = telling[term]
            o, p, t = owner[good], pos[good], term[good]
            if not len(o):
                continue
            place = o.astype(np.int64) << 32 | p
            doc, item, begin = windows(o, p, t)
            found: dict[tuple[int, int], tuple] = {}
            for lo in range(0, len(doc), 4096):
                d, i, a = doc[lo : lo + 4096], item[lo : lo + 4096], begin[lo : lo + 4096]
                s = np.searchsorted(place, d << 32 | a)
                e = np.searchsorted(place, d << 32 | (a + reach[i]))
                n = e - s
                row = np.repeat(np.arange(len(d)), n)
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
                pair, tf = np.unique(row * v + t[entry], return_counts=True)
                r, tt = pair // v, pair % v
                w = ((1 + np.log(tf)) * idf[tt]).astype(np.float32)
                starts = np.searchsorted(r, np.arange(len(d) + 1))
                cos = np.zeros(len(d))
                for k in range(len(d)):
                    x0, x1 = starts[k], starts[k + 1]
                    x = w[x0:x1] @ base32[tt[x0:x1]]
                    cos[k] = float(x @ q[i[k]]) / max(float(np.sqrt(x @ x)), 1e-12)
                for k in np.flatnonzero(cos >= min_cosine):
                    which, text = int(i[k]), int(d[k])
                    own = slice(cuts[text], cuts[text + 1])
                    x0, x1 = cuts[text] + np.searchsorted(pos[own], [int(a[k]) - STRIDE, int(a[k]) + int(reach[which])])
                    near = [z for z in zip(term[x0:x1].tolist(), pos[x0:x1].tolist()) if z[0] in masks[which]]
                    m = lcs(masks[which], [z[0] for z in near], int(lengths[which])) / float(lengths[which])
                    if m < min_lcs:
                        continue
                    have = {z[0] for z in near}
                    told = answers[which]
                    answer = len(told & have) / len(told) if told else 1.0
                    if m < sure_lcs and answer < 0.5:
                        continue
                    best = found.get((text, which))
                    if best is None or (m, float(cos[k])) > (best[3], best[2]):
                        found[text, which] = (near[0][1], near[-1][1] + 1, float(cos[k]), m, answer)
            if found:
                keys = sorted(found)
                cols = list(zip(*(found[k] for k in keys)))
                yield C.pa_batch(doc_id=batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())), item_id=pa.array([ids[k[1]] for k in keys], arrow_type), start_word=np.array(cols[0], np.int64), end_word=np.array(cols[1], np.int64), cosine=np.array(cols[2]), lcs=np.array(cols[3]), answer=np.array(cols[4]))

    return places.mapInArrow(C.lean(run), f"doc_id {kind}, item_id {item_type.simpleString()}, start_word long, end_word long, cosine double, lcs double, answer double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, items_at_once: int = ITEMS, **limits) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, cosine, lcs, answer), a row per document and item found in it.

    lcs is the share of the item's words that the passage has in order, answer the share of the answer's
    terms that it has. Matches under sure_lcs need half the answer. Items without words, with null ids or
    null texts never match; null or empty texts have no match; documents with equal ids and repeated rows
    are searched each on its own; equal items match alike. The benchmark is read in blocks of
    items_at_once items, ordered by id; only id, text, item and answer columns are read. Empty tables give an empty result."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    chosen = benchmark.select(F.col(item_col), F.col(item_text).cast("string"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string"))).filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).distinct()
    out = None
    # Items come to the driver a block at a time.
    for rows in C.batches_of(chosen.orderBy(item_col, item_text).toLocalIterator(), items_at_once):
        items = Items([(r[0], r[1]) for r in rows], [r[2] for r in rows])
        if not len(items.lookup.terms):
            continue
        places = term_places(docs, items.lookup, id_col, text_col)
        part = search(places, items, *latent_basis(places, items), item_type, **limits)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, item_id {item_type.simpleString()}, start_word long, end_word long, cosine double, lcs double, answer double")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
