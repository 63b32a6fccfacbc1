"""Passages that repeat across documents, by compact windows.

The sequence of a document's `shingle`-word hashes is hashed again by several functions. For each, the
Cartesian tree of the values groups all subsequences that have the same minimum: a compact window
(l, c, r) stands for every [i, j] with l <= i <= c <= j <= r. Only windows at least as wide as the
shortest passage count, about 2 n / (t + 1) of them. Documents whose windows share a minimum may share
a passage there:

* exact passages: around the shared pivot, hashes of the words left and right at graded distances say how
  far the copies agree. Members of a group that agree over the length of a passage are one class, found by
  sorting, however many they are; no pair is formed.
* near-duplicates: windows that share their minima with the same other document are joined by their
  intervals; where enough of the windows of enough functions agree along a run, the words of both documents
  are read there and compared. What stays unexplained meets the other documents of its groups.

Windows travel as packed arrays, one row per task and bucket; equal pivots within one task are first
reduced to those that differ, so that a hot passage arrives once per task and not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
SHINGLE, MIN_WORDS, FUNCTIONS, STEP = 8, 50, 3, 6
_REACH = 7  # graded distances to either side, STEP words each
_APART = 36  # words of a stretch of one repeated shingle that one pivot stands for; a pivot reaches as far to either side
WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "<u2"), ("right", "<u2"), ("room_l", "u1"), ("room_r", "u1"), ("fn", "u1"), ("told", "u1"), ("ctx_l", "<u4", _REACH), ("ctx_r", "<u4", _REACH)])
#: A near-duplicate passage is kept if this share of its words lies in sequences of COMMON words that the other's passage has.
VERIFIED, COMMON = 0.6, 4
#: Words that may differ between two agreeing ones of a passage; words read about a proposal on either side.
GAP, PAD = 12, 64
#: Times as many partners that what is still open meets in each turn.
FASTER = 8
#: Bytes of text whose windows one group holds, and one task; rows of what came of them, and of a batch of links.
GROUP_TEXT, TASK_TEXT, GROUP_ROWS, TASK_ROWS, LINKS = 2 << 20, 16 << 20, 200_000, 2_000_000, 500_000
_SEEDS = [_U(x | 1) for x in (0x8E3F5B1C9D2A7741, 0xD1B54A32D192ED03, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC6BC279692B5CC83, 0xE7037ED1A0B428DB)]


def compact_windows(values: np.ndarray, width: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every compact window at least `width` wide in the Cartesian tree of each owner's values;
    of equal values the leftmost is the minimum.

    A node's window is that wide exactly if the node is the minimum of some run of `width` values, so the
    pivots are the arg-minima of the sliding window, and the window ends at the nearest smaller pivots."""
    n = len(values)
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, empty
    owner = np.zeros(n, np.int64) if owner is None else owner
    bits = int(n).bit_length()
    packed = ((values >> _U(bits)) << _U(bits)) | np.arange(n, dtype=_U)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=_U)
    grid[:n] = packed
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    inside = owner[: n - width + 1] == owner[width - 1 :]
    place = (least[inside] & _U((1 << bits) - 1)).astype(np.int64)
    if not len(place):
        return empty, empty, empty
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    c = place[new]
    v, own = packed[c], owner[c]
    first = np.searchsorted(owner, own, side="left")
    last = np.searchsorted(owner, own, side="right") - 1
    left = _nearest_smaller(v, own)
    right = len(c) - 1 - _nearest_smaller(v[::-1], own[::-1])[::-1]
    low = np.where(left >= 0, c[np.maximum(left, 0)] + 1, first)
    right = np.where(right > len(c) - 1, -1, right)
    high = np.where(right >= 0, c[np.maximum(right, 0)] - 1, last)
    return low, c, high


def _nearest_smaller(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each, among those of one owner; -1 without one."""
    guess = np.arange(len(v)) - 1
    while True:
        g = np.maximum(guess, 0)
        bad = (guess >= 0) & ((v[g] > v) | (own[g] != own))
        if not bad.any():
            return guess
        stop = bad & (own[g] != own)
        guess = np.where(stop, -1, np.where(bad, guess[g], guess))


def _windows_of(col: pa.Array, ids: np.ndarray, shingle: int, min_words: int, functions: int) -> np.ndarray:
    """The packed windows of a column of texts."""
    w = C.Words(col, lower=True)
    words, owner = w.hash, w.text_of_word()
    n = len(words)
    if n < min_words:
        return np.zeros(0, WINDOW)
    grams = C.gram_hash(words, shingle)
    # Sums from which the hash of any run of words follows.
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(words * C._powers(C._Q, n), dtype=_U, out=sums[1:])
    back = C._powers(C._QI, n + 1)
    whole = owner[: len(grams)] == owner[shingle - 1 :]
    place = np.flatnonzero(whole)
    g, own = grams[place], owner[place]
    t = min_words - shingle + 1
    first, last = w.of[:-1], w.of[1:]
    out = []
    for f in range(functions):
        h = C.mix(g * _SEEDS[f] + _U(f))
        low, c, high = compact_windows(h, t, own)
        if not len(c):
            continue
        # Runs of one repeated shingle give a pivot in every period: the first in each stretch of _APART words
        # and the run's last are kept, so that what they cover has no gaps.
        same = np.zeros(len(c), bool)
        same[1:] = (h[c[1:]] == h[c[:-1]]) & (own[c[1:]] == own[c[:-1]]) & (c[1:] - c[:-1] < t // 2)
        begin = c[np.maximum.accumulate(np.where(same, 0, np.arange(len(c))))]
        stretch = (c - begin) // _APART
        keep = ~same | ~np.r_[same[1:], False]
        keep[1:] |= stretch[1:] != stretch[:-1]
        low, c, high = low[keep], c[keep], high[keep]
        at = place[c]
        d = own[c]
        rec = np.zeros(len(c), WINDOW)
        rec["key"], rec["doc"], rec["at"], rec["fn"] = h[c], ids[d], at - first[d], f
        rec["left"], rec["right"] = np.minimum(c - low, 65535), np.minimum(high - c, 65535)
        before, after = at - first[d], last[d] - (at + shingle)
        rec["room_l"], rec["room_r"] = np.minimum(before, 255), np.minimum(after, 255)
        for k in range(_REACH):
            dist = STEP * (k + 1)
            lo = np.maximum(at - dist, 0)
            rec["ctx_l"][:, k] = np.where(before >= dist, C.mix((sums[at] - sums[lo]) * back[lo]) >> _U(32), _U(0)).astype(np.uint32)
            end = np.minimum(at + shingle + dist, n)
            rec["ctx_r"][:, k] = np.where(after >= dist, C.mix((sums[end] - sums[at + shingle]) * back[at + shingle]) >> _U(32), _U(0)).astype(np.uint32)
        out.append(rec)
    return np.concatenate(out) if out else np.zeros(0, WINDOW)


def _combine(rec: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with i graded distances on the left and j on the right, hash of pivot and both contexts). All
    distances up to those count, so that in a hot group two hashes that are equal by chance add a step at most."""
    ok = np.flatnonzero((rec["room_l"] >= STEP * i) & (rec["room_r"] >= STEP * j))
    h = rec["key"][ok].copy()
    for k in range(i):
        h = C.mix(h + (rec["ctx_l"][ok, k].astype(_U) << _U(20)) + _U(k + 1))
    for k in range(j):
        h = C.mix(h + (rec["ctx_r"][ok, k].astype(_U) << _U(20)) + _U(k + 101))
    return ok, h


_MET = ("doc", "start", "end", "mate", "exact", "fn", "shift", "pivot", "key")


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.r_[start, len(sorted_keys)])


def _meet(rec: np.ndarray, shingle: int, min_words: int) -> dict[str, np.ndarray]:
    """Of one bucket's windows: the spans (start, end) in which a document shares a pivot with `mate`, the first
    of its group. key is the pivot's where its group has documents besides those two, else 0."""
    cols: dict[str, list] = {k: [] for k in _MET}

    def put(r: np.ndarray, start, end, mate, exact: int, shift, key) -> None:
        for k, x in zip(_MET, (r["doc"], start, end, mate, np.full(len(r), exact), r["fn"], shift, r["at"], key)):
            cols[k].append(np.asarray(x).astype(np.int64))

    def room(r: np.ndarray, side: str) -> np.ndarray:
        return STEP * np.minimum(r["room_" + side] // STEP, _REACH).astype(np.int64)

    told = rec[rec["told"] == 1]  # met already in the task that read them; key holds the other document
    at = told["at"].astype(np.int64)
    put(told, at - room(told, "l"), at + shingle + room(told, "r"), told["key"].view(np.int64) if len(told) else at, 1, at - told["ctx_l"][:, 0], np.zeros(len(told)))
    rec = rec[rec["told"] == 0]
    rec = rec[np.lexsort((rec["at"], rec["doc"], rec["key"]))]
    start, size = _groups(rec["key"])
    if len(rec):
        rec = rec[np.repeat(rec["doc"][start] != rec["doc"][start + size - 1], size)]
    n = len(rec)
    if n:
        start, size = _groups(rec["key"])
        # The group's first document stands for it; a window agrees with it over what both intervals span.
        one = rec[np.repeat(start, size)]
        lo = np.minimum(rec["left"], one["left"]).astype(np.int64)
        hi = np.minimum(rec["right"], one["right"]).astype(np.int64)
        at = rec["at"].astype(np.int64)
        other = rec["doc"] != one["doc"]
        docs = np.r_[0, np.cumsum((rec["doc"][1:] != rec["doc"][:-1]) | (rec["key"][1:] != rec["key"][:-1]))]
        many = np.repeat(docs[start + size - 1] - docs[start] > 1, size)
        put(rec[other], (at - lo)[other], (at + hi + shingle)[other], one["doc"][other], 0, (at - one["at"])[other], np.where(many, rec["key"].view(np.int64), 0)[other])
        reach = -(-(min_words - shingle - STEP) // STEP)
        found = []
        for i in range(min(reach, _REACH) + 1):
            j = reach - i
            if not 0 <= j <= _REACH:
                continue
            ok, h = _combine(rec, i, j)
            if not len(ok):
                continue
            o = np.lexsort((rec["at"][ok], rec["doc"][ok], h))
            ok, h = ok[o], h[o]
            s, z = _groups(h)
            d = rec["doc"][ok]
            shared = np.repeat(d[s] != d[s + z - 1], z)
            found.append((ok[shared], np.repeat(ok[s], z)[shared], i, j))
        if found:
            # A row per window and first document: what one of them shares on the left, another may not on the right.
            hit = np.concatenate([x[0] for x in found])
            where = np.concatenate([x[1] for x in found])
            sides = [np.concatenate([np.full(len(x[0]), x[k]) for x in found]) for k in (2, 3)]
            o = np.lexsort((where, hit))
            hit, where = hit[o], where[o]
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1]) | (where[1:] != where[:-1])
            s = np.flatnonzero(new)
            if len(s):
                best_l, best_r = (np.maximum.reduceat(x[o], s) for x in sides)
                put(rec[hit[s]], at[hit[s]] - STEP * best_l, at[hit[s]] + shingle + STEP * best_r, rec["doc"][where[s]], 1, at[hit[s]] - at[where[s]], np.zeros(len(s)))
    return {k: np.concatenate(v) for k, v in cols.items()}


def _united(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the first, start, end) of the unions of spans that touch or overlap; rows are ordered by group and start."""
    if not len(start):
        return start, start, end
    wide = np.int64(1) << 34
    far = np.maximum.accumulate(group * wide + end)
    first = np.flatnonzero(np.r_[True, (group * wide + start)[1:] > far[:-1]])
    return first, start[first], far[np.r_[first[1:], len(far)] - 1] - group[first] * wide


def _numbered(*cols: np.ndarray) -> np.ndarray:
    """Numbers, from 0, of the runs of equal rows."""
    new = np.zeros(len(cols[0]), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _inside(doc, start, end, of, lo, hi) -> np.ndarray:
    """Whether each span (of, lo, hi) lies in one of the disjoint spans (doc, start, end), ordered by both."""
    if not len(doc):
        return np.zeros(len(of), bool)
    names, n = np.unique(np.r_[doc, of], return_inverse=True)
    wide = np.int64(1) << 34
    key = n[: len(doc)] * wide + start
    want = n[len(doc) :] * wide + lo
    at = np.searchsorted(key, want, side="right") - 1
    safe = np.maximum(at, 0)
    return (at >= 0) & (doc[safe] == of) & (end[safe] >= hi)


#: What _sorted_out() tells of a document: its exact spans, near-duplicates to compare, and windows that may need other partners.
_EXACT, _PROPOSED, _OPEN = 0, 1, 2
_TOLD = ("kind", "doc", "start", "end", "mate", "mate_start", "mate_end", "key", "pivot", "fn")


def _chains(doc, mate, pivot, shift, fn, shingle: int, min_words: int, functions: int, agree: float):
    """(doc, start, end, mate, mate's start, its end) of the runs of windows that two documents share at places
    that run along, with at least two windows and `agree` of those that equal texts share."""
    t = min_words - shingle + 1
    o = np.lexsort((shift, mate, doc))
    line = np.zeros(len(o), np.int64)
    if len(o):
        d, m, s = doc[o], mate[o], shift[o]
        line[o] = np.cumsum(np.r_[0, (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (s[1:] - s[:-1] > 12)])
    o = np.lexsort((fn, pivot, line))
    doc, mate, pivot, shift, fn, line = (x[o] for x in (doc, mate, pivot, shift, fn, line))
    if not len(o):
        return (np.zeros(0, np.int64),) * 6
    cut = np.r_[True, (line[1:] != line[:-1]) | (pivot[1:] - pivot[:-1] > t)]
    first = np.flatnonzero(cut)
    again = np.r_[False, (line[1:] == line[:-1]) & (pivot[1:] == pivot[:-1]) & (fn[1:] == fn[:-1])]
    n = np.add.reduceat((~again).astype(np.int64), first)
    lo, hi = pivot[first], pivot[np.r_[first[1:], len(pivot)] - 1] + shingle
    due = functions * 2 * np.maximum(hi - lo - shingle, 1) / (t + 1)
    there = pivot - shift
    low, high = np.minimum.reduceat(there, first), np.maximum.reduceat(there, first) + shingle
    good = (hi - lo >= 2 * shingle) & (n >= 2) & (n >= agree * due)
    return doc[first][good], lo[good], hi[good], mate[first][good], low[good], high[good]


def _clusters(doc, pivot, fn, key, shingle: int, min_words: int) -> np.ndarray:
    """Rows (in any order) that lie among shared windows wide enough for a passage, where other partners are left."""
    o = np.lexsort((pivot, doc))
    d, p = doc[o], pivot[o]
    if not len(o):
        return o
    cut = np.r_[True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > min_words - shingle + 1)]
    first = np.flatnonzero(cut)
    size = np.diff(np.r_[first, len(o)])
    wide = 10 * (p[first + size - 1] + shingle - p[first]) >= 8 * min_words
    line = np.cumsum(cut)
    k = key[o]
    by = np.lexsort((k, line))
    kinds = np.add.reduceat(np.r_[True, (k[by][1:] != k[by][:-1]) | (line[by][1:] != line[by][:-1])].astype(np.int64), first)
    good = wide & (kinds >= 3) & (np.maximum.reduceat((k != 0).astype(np.int64), first) > 0)
    return o[np.repeat(good, size) & (key[o] != 0)]


def _sorted_out(g: dict[str, np.ndarray], shingle: int, min_words: int, functions: int, agree: float) -> dict[str, np.ndarray]:
    """The rows of _TOLD of whole documents, from all the spans in which they met others."""
    cols: dict[str, list] = {k: [] for k in _TOLD}

    def put(kind: int, **given) -> None:
        n = len(given["doc"])
        for k in _TOLD:
            cols[k].append(np.full(n, kind) if k == "kind" else given.get(k, np.zeros(n, np.int64)))

    exact = np.flatnonzero(g["exact"] == 1)
    e = exact[np.lexsort((g["start"][exact], g["shift"][exact], g["mate"][exact], g["doc"][exact]))]
    first, start, end = _united(_numbered(g["doc"][e], g["mate"][e], g["shift"][e]), g["start"][e], g["end"][e])
    doc, mate, shift = g["doc"][e][first], g["mate"][e][first], g["shift"][e][first]
    # What all mates cover together. Ends are graded: where it is short, its words tell how long it is.
    o = np.lexsort((start, doc))
    f, s, t = _united(_numbered(doc[o]), start[o], end[o])
    sure = np.zeros(len(o), bool)
    wide = t - s >= min_words + 2 * STEP
    sure[o] = np.repeat(wide, np.diff(np.r_[f, len(o)]))
    put(_EXACT, doc=doc[sure], start=start[sure], end=end[sure], mate=mate[sure])
    short = ~sure & (mate != doc)
    put(_PROPOSED, doc=doc[short], start=start[short], end=end[short], mate=mate[short], mate_start=(start - shift)[short], mate_end=(end - shift)[short])
    other = np.flatnonzero(mate != doc)
    o = other[np.lexsort((start[other], doc[other]))]
    f, s, t = _united(_numbered(doc[o]), start[o], end[o])
    loose = np.flatnonzero((g["exact"] == 0) & (g["mate"] != g["doc"]))
    loose = loose[~_inside(doc[o][f], s, t, g["doc"][loose], g["pivot"][loose], g["pivot"][loose] + shingle)]
    part = {k: g[k][loose] for k in ("doc", "mate", "pivot", "shift", "fn", "key")}
    put(_PROPOSED, **dict(zip(("doc", "start", "end", "mate", "mate_start", "mate_end"), _chains(*(part[k] for k in ("doc", "mate", "pivot", "shift", "fn")), shingle, min_words, functions, agree))))
    left = _clusters(part["doc"], part["pivot"], part["fn"], part["key"], shingle, min_words)
    put(_OPEN, **{k: part[k][left] for k in ("doc", "pivot", "fn", "key")})
    return {k: np.concatenate(v).astype(np.int64) for k, v in cols.items()}


def _covered_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's words (hashes) lie in sequences of COMMON words that b has too."""
    if len(a) < COMMON or len(b) < COMMON:
        return np.zeros(len(a), bool)
    hit = np.flatnonzero(np.isin(C.gram_hash(a, COMMON), C.gram_hash(b, COMMON)))
    told = np.zeros(len(a) + 1, np.int64)
    np.add.at(told, hit, 1)
    np.add.at(told, hit + COMMON, -1)
    return np.cumsum(told[:-1]) > 0


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's words (hashes) that lie in sequences of COMMON words that b has too."""
    return float(_covered_words(a, b).mean()) if len(a) else 0.0


def passage_in(a: np.ndarray, b: np.ndarray, lo: int, hi: int, min_words: int, covered: np.ndarray | None = None) -> tuple[int, int, bool] | None:
    """(start, end, exact) of the passage of a about [lo, hi) whose words b has too: it runs from one agreeing
    word to another, with at most GAP others between two; None if it is shorter than min_words or less than
    VERIFIED of its words agree. covered: _covered_words(a, b), where it is known."""
    told = np.flatnonzero(_covered_words(a, b) if covered is None else covered)
    if not len(told):
        return None
    cut = np.flatnonzero(np.r_[True, np.diff(told) > GAP + 1])
    start, end = told[cut], told[np.r_[cut[1:], len(told)] - 1] + 1
    best = int(np.argmax(np.minimum(end, hi) - np.maximum(start, lo)))
    i, j = int(start[best]), int(end[best])
    n = int(np.searchsorted(told, j) - np.searchsorted(told, i))
    if j - i < min_words or n < VERIFIED * (j - i):
        return None
    return i, j, n == j - i and a[i:j].tobytes() in b.tobytes()


def equal_runs(a: np.ndarray, b: np.ndarray, min_words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the stretches of a's words (hashes) that lie in runs of min_words words that b has too,
    and of b's that a has."""
    if len(a) < min_words or len(b) < min_words:
        return [], []
    grams = [C.gram_hash(x, min_words) for x in (a, b)]
    out = []
    for g, other in (grams, grams[::-1]):
        hit = np.flatnonzero(np.isin(g, other))
        _, start, end = _united(np.zeros(len(hit), np.int64), hit, hit + min_words)
        out.append(list(zip(start.tolist(), end.tolist())))
    return out[0], out[1]


def _verified(spark, whole: DataFrame, proposed: DataFrame, min_words: int) -> DataFrame:
    """(doc, start, end, mate, exact) of the proposed passages whose words agree: the words about each are read
    on both sides and compared, which also tells where it begins and ends. A stretch of a document that many
    proposals name is read once."""
    grid = lambda lo, hi: (F.greatest(F.lit(0), F.floor((F.col(lo) - PAD) / PAD) * PAD).cast("long"), (F.ceil((F.col(hi) + PAD) / PAD) * PAD).cast("long"))
    (a0, a1), (b0, b1) = grid("start", "end"), grid("mate_start", "mate_end")
    name = lambda of, lo, hi: F.concat_ws(":", of, lo, hi)
    asked = C.stored(proposed.select("doc", "start", "end", "mate", "mate_start", "mate_end").distinct().select("*", a0.alias("a0"), b0.alias("b0"), name("doc", a0, a1).alias("own"), name("mate", b0, b1).alias("its")), "asked")
    if not asked.limit(1).count():
        return spark.createDataFrame([], "doc long, start long, end long, mate long, exact long")
    areas = asked.select(F.col("own").alias("area")).unionByName(asked.select(F.col("its").alias("area"))).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    piece = lambda i: F.split_part("area", F.lit(":"), F.lit(i)).cast("long")
    needs = areas.groupBy(piece(1).alias("of_id")).agg(F.collect_list(F.struct("area", "n", piece(2).alias("lo"), piece(3).alias("hi"))).alias("needs"))
    needs = C.stored(needs, "compared-words")
    texts = whole.join(C.if_small(needs), F.col("id") == F.col("of_id")).select("text", "needs")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = C.Words(batch.column(0), lower=True)
        rows = [(w.hash[w.of[i] + min(n["lo"], w.of[i + 1] - w.of[i]) : min(w.of[i] + n["hi"], w.of[i + 1])].astype("<u8").tobytes(), n) for i, x in enumerate(batch.column(1).to_pylist()) for n in x]
        return C.pa_batch(area=pa.array([n["area"] for _, n in rows], pa.string()), n=pa.array([n["n"] for _, n in rows], pa.int64()), words=pa.array([x for x, _ in rows], pa.binary()))

    # An id may have several rows; those that differ are compared each.
    read_words = C.stored(C.arrow_map(texts, read, "area string, n long, words binary", C.SMALL_STEP).groupBy("area").agg(F.max("n").alias("n"), F.collect_set("words").alias("words")), "area-words")
    pairs = C.lookup(asked, read_words.select(F.col("area").alias("own"), "n", F.col("words").alias("a")), "own", "n")
    pairs = C.lookup(pairs.drop("n"), read_words.select(F.col("area").alias("its"), "n", F.col("words").alias("b")), "its", "n")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, lo, hi, mate, there, back, a0, b0, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            for own, its in ((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x in a for y in b):
                exact, covered = False, _covered_words(own, its)
                if hit := passage_in(own, its, lo - a0, hi - a0, min_words, covered):
                    out.append((doc, a0 + hit[0], a0 + hit[1], mate, int(hit[2])))
                    exact = hit[2]
                    # The other document's row, as the first that has it.
                    if hit := passage_in(its, own, there - b0, back - b0, min_words):
                        out.append((mate, b0 + hit[0], b0 + hit[1], mate, int(hit[2])))
                # Equal words amid others that agree less are an exact passage, whatever is said of the whole.
                if not exact and np.diff(np.flatnonzero(np.r_[True, ~covered, True])).max() > min_words:
                    for of, base, runs in zip((doc, mate), (a0, b0), equal_runs(own, its, min_words)):
                        out += [(of, base + i, base + j, mate, 1) for i, j in runs]
        cols = list(zip(*out)) if out else [[]] * 5
        return C.pa_batch(**{k: pa.array(x, pa.int64()) for k, x in zip(("doc", "start", "end", "mate", "exact"), cols)})

    pairs = pairs.select("doc", "start", "end", "mate", "mate_start", "mate_end", "a0", "b0", "a", "b")
    return C.arrow_map(pairs, compare, "doc long, start long, end long, mate long, exact long").distinct()


def _runs(g: dict[str, np.ndarray], doc: int, min_words: int) -> list[tuple[int, int, int, bool]]:
    """The passages (start, end, first document, exact) of one document."""
    spans = [(int(a), int(b), int(m), e == 1) for a, b, m, e in zip(g["start"], g["end"], g["mate"], g["exact"])]
    spans.sort()
    together: list[list] = []
    far = -1
    for span in spans:
        if not together or span[0] > far:
            together.append([])
            far = span[1]
        together[-1].append(span)
        far = max(far, span[1])
    out: list[tuple[int, int, int, bool]] = []
    for part in together:
        if max(b for _, b, _, _ in part) - part[0][0] >= min_words:
            out += _by_first(part, doc)
    return out


def _next_partners(g: dict[str, np.ndarray], turn: int) -> dict[str, np.ndarray]:
    """All of _partners_by_part() at once."""
    parts = list(_partners_by_part(g, turn))
    return {k: np.concatenate([np.zeros(0, np.int64), *(x[k] for x in parts)]) for k in _LINK}


_LINK = ("doc", "mate", "pivot", "shift", "fn", "key")


def _partners_by_part(g: dict[str, np.ndarray], turn: int) -> Iterator[dict[str, np.ndarray]]:
    """Links of open windows to further members of their groups, some at a time. g: (key, doc, pivot, fn, open), each
    member of the groups but the first, which all have met. In turn 1 the next of them meets all those behind it, in
    each turn then FASTER times as many do, if one of the two is open; the later document is told."""
    o = np.lexsort((g["pivot"], g["doc"], g["key"]))
    key, doc, pivot, fn, opened = (g[k][o] for k in ("key", "doc", "pivot", "fn", "open"))
    if not len(o):
        return
    member = _numbered(key, doc)
    at = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])  # a member's first place
    is_open = np.maximum.reduceat(opened, at)[member] > 0
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    base = np.repeat(member[first], np.diff(np.r_[first, len(o)]))  # number of the group's first member
    parts, held = [], 0
    begin = sum(FASTER**i for i in range(turn - 1))
    for hub in range(begin, begin + FASTER ** (turn - 1)):
        rows = np.flatnonzero(member - base > hub)
        if not len(rows):
            break
        it = at[base[rows] + hub]
        rows, it = (x[is_open[rows] | is_open[it]] for x in (rows, it))
        parts.append((doc[rows], doc[it], pivot[rows], pivot[rows] - pivot[it], fn[rows], key[rows]))
        held += len(rows)
        if held >= LINKS:
            yield dict(zip(_LINK, map(np.concatenate, zip(*parts))))
            parts, held = [], 0
    if held:
        yield dict(zip(_LINK, map(np.concatenate, zip(*parts))))


def _by_first(spans: list[tuple[int, int, int, bool]], doc: int) -> list[tuple[int, int, int, bool]]:
    """Spans that touch or overlap, cut into intervals whose words have the same first document: the smallest
    of the spans that cover them, not of all, since a document that has one end needn't have the other."""
    edges = np.unique([x for a, b, _, _ in spans for x in (a, b)])
    first, exact = np.full(len(edges) - 1, doc, np.int64), np.zeros(len(edges) - 1, bool)
    for a, b, m, e in spans:
        i, j = np.searchsorted(edges, (a, b))
        first[i:j] = np.minimum(first[i:j], m)
        exact[i:j] |= e
    start = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    stop = np.r_[start[1:], len(first)]
    rows = [(int(edges[i]), int(edges[j]), int(first[i]), bool(exact[i:j].any())) for i, j in zip(start, stop)]
    # Ends are graded. A rest within two steps of them is no row of its own: if another document has it, it goes
    # with what is cut beside it; if this is the first, it stays uncut.
    out: list[tuple[int, int, int, bool]] = []
    for k, (a, b, m, e) in enumerate(rows):
        if b - a <= 2 * STEP and len(rows) > 1:
            if m == doc:
                continue
            if out and out[-1][1] == a and out[-1][2] != doc:
                out[-1] = (out[-1][0], b, out[-1][2], out[-1][3])
                continue
            if k + 1 < len(rows) and rows[k + 1][2] != doc:
                rows[k + 1] = (a, *rows[k + 1][1:])
                continue
        out.append((a, b, m, e))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE, functions: int = FUNCTIONS, agree: float = 0.1) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id, exact): the passages of min_words words or more that
    another document has too; words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered, counted from 0, end excluded.

    first_doc_id is the smallest id that the passage was linked to, the row's own included; it is the row's own
    for documents that others are linked to and that have no link to a smaller id. Passages
    that touch or overlap are one row as long as that id is the same, and rows of their own from where it
    changes; such a row may be shorter than a passage. Ends of exact passages of min_words + 12 words or more are
    exact to within the graded distances (6 words); all others are read on both sides, begin and end with agreeing
    words, and have min_words words or more. Exact passages of min_words words or more are always found; near-duplicates
    with a probability that grows with their agreement. They are kept only if at least VERIFIED (60 %) of
    their words lie in sequences of COMMON (4) words that the other document's passage has too.

    Windows meet the first document of their pivot group; windows that no passage found so covers, and that lie
    among enough others for one, meet the group's further documents too, one of them, then 8, then 64, until
    none is left. Ids are integers; rows of one id are one document; rows with a null id or text, and texts
    under min_words words, have no passages. Only id and text are read; an empty table gives an empty one."""
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    size = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = _groups_for(spark, size, GROUP_TEXT)

    def grouped(df: DataFrame, by: str | None, most: int, tasks: int):
        """df in groups of the documents or keys of column `by`, whose number follows the data, not the settings."""
        if by:
            df = df.withColumn("bucket", F.pmod(F.hash(by), F.lit(most)))
        return (df.repartition(tasks, "bucket") if tasks > C.partitions(spark) else df).groupBy("bucket")

    def by_rows(df: DataFrame, by: str, rows: int):
        return grouped(df, by, _groups_for(spark, rows, GROUP_ROWS), rows // TASK_ROWS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def taken() -> np.ndarray:
            rec = np.concatenate(held)
            held.clear()
            return rec

        for batch in (b for x in batches for b in C.cut(x, C.SMALL_STEP)):
            rec = _windows_of(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False), shingle, min_words, functions)
            held.append(rec)
            size += rec.nbytes
            if size > (12 << 20):
                yield _packed(taken(), buckets, shingle, min_words)
                size = 0
        if size:
            yield _packed(taken(), buckets, shingle, min_words)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        rec = np.frombuffer(b"".join(group.column("windows").to_pylist()), WINDOW)
        return pa.table(_meet(rec, shingle, min_words))

    met = grouped(whole.mapInArrow(C.lean(emit), "bucket int, windows binary"), None, buckets, size // TASK_TEXT).applyInArrow(C.lean(meet), ", ".join(f"{c} long" for c in _MET))
    met = C.stored(met, "shared-windows")

    def columns(g: pa.Table) -> dict[str, np.ndarray]:
        return {k: g.column(k).to_numpy() for k in g.column_names}

    def sort_out(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table(_sorted_out(columns(group), shingle, min_words, functions, agree))

    # A document is as large a group as there is; many of them share a bucket to save calls.
    told = C.stored(by_rows(met, "doc", met.count()).applyInArrow(C.lean(sort_out), ", ".join(f"{c} long" for c in _TOLD)), "sorted-out")
    spans = told.filter(F.col("kind") == _EXACT).select("doc", "start", "end", "mate", F.lit(1).cast("long").alias("exact"))
    found = [C.stored(_verified(spark, whole, told.filter(F.col("kind") == _PROPOSED), min_words), "verified")]
    opened = told.filter(F.col("kind") == _OPEN).select("doc", "key", "pivot", "fn")
    members = met.filter("exact = 0 AND key <> 0").select("doc", "key", "pivot", "fn")

    def still_open(key: tuple, group: pa.Table) -> pa.Table:
        g = columns(group)
        o = np.flatnonzero(g["open"] == 0)
        o = o[np.lexsort((g["pivot"][o], g["doc"][o]))]
        f, s, t = _united(_numbered(g["doc"][o]), g["pivot"][o], g["key"][o])
        rows = np.flatnonzero(g["open"] == 1)
        rows = rows[~_inside(g["doc"][o][f], s, t, g["doc"][rows], g["pivot"][rows], g["pivot"][rows] + shingle)]
        rows = rows[_clusters(g["doc"][rows], g["pivot"][rows], g["fn"][rows], g["key"][rows], shingle, min_words)]
        return pa.table({k: g[k][rows] for k in ("doc", "key", "pivot", "fn")})

    def partners(turn: int):
        # A hot group's links are many times its members: they leave as they are made.
        def meet_next(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                for part in _partners_by_part(columns(pa.Table.from_batches(list(batches))), turn):
                    yield C.pa_batch(**part)
            finally:
                C.trim()

        return meet_next

    def along(key: tuple, group: pa.Table) -> pa.Table:
        g = columns(group)
        cols = _chains(*(g[k] for k in ("doc", "mate", "pivot", "shift", "fn")), shingle, min_words, functions, agree)
        return pa.table(dict(zip(("doc", "start", "end", "mate", "mate_start", "mate_end"), cols)))

    turn = 0
    while opened.limit(1).count():
        turn += 1
        known = found[0]
        for x in found[1:]:
            known = known.unionByName(x)
        # The spans found so far and the open windows of a document, in one group: a span's end travels as its key.
        both = opened.withColumn("open", F.lit(1)).unionByName(known.select("doc", F.col("end").alias("key"), F.col("start").alias("pivot"), F.lit(0).cast("long").alias("fn"), F.lit(0).alias("open")))
        opened = C.stored(by_rows(both, "doc", opened.count() + known.count()).applyInArrow(C.lean(still_open), "doc long, key long, pivot long, fn long"), "open-windows")
        keys = C.stored(opened.select(F.col("key").alias("open_key")).distinct(), "open-keys")
        own = members.join(C.if_small(keys), F.col("key") == F.col("open_key"), "left_semi").withColumn("open", F.lit(0)).unionByName(opened.withColumn("open", F.lit(1)))
        links = C.stored(by_rows(own, "key", met.count()).applyInArrow(partners(turn), "doc long, mate long, pivot long, shift long, fn long, key long"), "further-links")
        if not (n := links.count()):
            break
        found.append(C.stored(_verified(spark, whole, by_rows(links, "doc", n).applyInArrow(C.lean(along), "doc long, start long, end long, mate long, mate_start long, mate_end long"), min_words), "verified"))
    for x in found:
        spans = spans.unionByName(x)

    def each(g: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        cols = columns(g)
        order = np.argsort(cols["doc"], kind="stable")
        cols = {k: v[order] for k, v in cols.items()}
        ids, at = np.unique(cols["doc"], return_index=True)
        for d, a, b in zip(ids.tolist(), at, np.r_[at[1:], len(order)]):
            yield d, {k: v[a:b] for k, v in cols.items()}

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = [(d, *x) for d, part in each(group) for x in _runs(part, d, min_words)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "start_word": pa.array(cols[1], pa.int64()), "end_word": pa.array(cols[2], pa.int64()), "first_doc_id": pa.array(cols[3], pa.int64()), "exact": pa.array(cols[4], pa.bool_())})

    return by_rows(spans, "doc", told.count() + sum(x.count() for x in found)).applyInArrow(C.lean(merge), "doc_id long, start_word long, end_word long, first_doc_id long, exact boolean")


def _groups_for(spark, amount: int, most: int) -> int:
    """Groups to make of an amount of which one should hold `most`."""
    return max(4 * C.partitions(spark), -(-amount // most))


def _reduced(rec: np.ndarray, shingle: int, min_words: int) -> np.ndarray:
    """Windows of one task that agree in pivot and contexts over a whole passage are one: its two lowest
    documents stay to meet other tasks', and the rest are told of the lowest here and now."""
    sides = np.minimum(rec["room_l"] // STEP, _REACH).astype(np.int64) + np.minimum(rec["room_r"] // STEP, _REACH)
    wide = np.flatnonzero(shingle + STEP * sides >= min_words - STEP)
    if not len(wide):
        return rec
    h = rec["key"][wide]
    for side in ("l", "r"):
        h = C.mix(h + np.minimum(rec["room_" + side][wide] // STEP, _REACH).astype(_U))
        for k in range(_REACH):
            h = C.mix(h + rec["ctx_" + side][wide, k].astype(_U) + _U(k))
    order = np.lexsort((rec["at"][wide], rec["doc"][wide], h))
    start, size = _groups(h[order])
    d = rec["doc"][wide][order]
    lowest = np.repeat(d[start], size)
    place = np.arange(len(d)) - np.repeat(start, size)
    tell = (place >= 2) & (d != lowest) & (np.repeat(d[np.minimum(start + 1, len(d) - 1)], size) != lowest)
    rows = wide[order[tell]]
    rec["told"][rows] = 1
    rec["key"][rows] = lowest[tell].view(_U)
    rec["ctx_l"][rows, 0] = np.repeat(rec["at"][wide[order[start]]], size)[tell]  # where the lowest has it
    return rec


def _packed(rec: np.ndarray, buckets: int, shingle: int, min_words: int) -> pa.RecordBatch:
    """One row per bucket: windows by their pivot, those told already by their document."""
    rec = _reduced(rec, shingle, min_words)
    by = np.where(rec["told"] == 1, C.mix(rec["doc"].view(_U) if rec["doc"].flags.c_contiguous else rec["doc"].astype(_U)), rec["key"])
    b = (by >> _U(40)) % _U(buckets)
    order = np.argsort(b, kind="stable")
    b, rec = b[order], rec[order]
    start, size = _groups(b)
    ends = pa.py_buffer((np.r_[start, len(rec)] * rec.itemsize).astype(np.int32))
    return C.pa_batch(bucket=b[start].astype(np.int32), windows=pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(rec.view(np.uint8))]))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans; the white space before a cut goes with it."""
    import re

    ends, at, out = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)], 0, []
    for a, b in sorted(spans):
        b = min(b, len(ends))
        if a < b:
            from_ = ends[a - 1][1] if a else 0
            out.append(text[at:max(at, from_)])
            at = max(at, ends[b - 1][1])
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", least_words: int = 10, **settings) -> DataFrame:
    """docs with every repeated passage left in the document of the smallest id alone. What is left of the
    others stays with all its columns; documents that had a passage and are left with fewer than
    least_words words go. Documents without such passages, or with a null id or text, stay as they are."""
    spans = repeated_passages(docs, id_col, text_col, **settings).filter("first_doc_id <> doc_id")
    of, cuts_of = C.fresh("__of", docs), C.fresh("__spans", docs)
    per_doc = C.stored(spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts_of)).withColumnRenamed("doc_id", of), "cuts")
    names, schema = docs.columns, docs.schema
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        spans = batch.column(len(names)).to_pylist()
        cols = list(batch.columns[: len(names)])
        if any(spans):
            texts = cols[at].to_pylist()
            keep = np.ones(len(texts), bool)
            for i, cuts in enumerate(spans):
                if cuts:
                    texts[i] = cut_spans(texts[i], [(c["start_word"], c["end_word"]) for c in cuts])
                    keep[i] = len(texts[i].encode("utf-8", "surrogatepass").split()) >= least_words
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                had = cols[chars].to_pylist()
                cols[chars] = pa.array([len(t) if c else h for t, c, h in zip(texts, spans, had)], cols[chars].type)
            return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))
        return pa.RecordBatch.from_arrays(cols, names=names)

    joined = docs.join(C.if_small(per_doc), F.col(id_col).cast("long") == F.col(of), "left").drop(of)
    return C.arrow_map(joined, one, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(C.table(spark, sf_dir, "documents"))
