"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a common variant within r / 2 bits of both. Every distinct
fingerprint therefore stands for all variants in its ball of radius r / 2 (2,081 of 64 bits for r = 4),
variants are shuffled to blocks, and equal variants of two fingerprints are a link.

A block holds the variants that agree in `block_bits` chosen bits. A fingerprint reaches only the
blocks whose index is within r / 2 flips of its own, so one row per (fingerprint, block) is shuffled
and the variants of that block are written out inside it: the same variants meet, and the shuffle
carries 37 rows a fingerprint at 8 bits instead of 2,081. block_bits follows from the number of
fingerprints so that a block's variants fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHINGLE, _SEED = 4, 42
#: Variants that one block should hold.
BLOCK_VARIANTS = 1 << 20
#: Links up to which components are found by union-find in one task; beyond, by rounds of joins.
SMALL_LINKS = 1_000_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 4-word shingles of a text; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= _SHINGLE:
        return xxh64_intdigest(b" ".join(words), _SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    a = [0, *ends[:-_SHINGLE].tolist()]
    b = (ends[_SHINGLE - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(joined[i:j], _SEED) for i, j in zip(a, b)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; other columns aren't carried. A null
    or wordless text has fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return C.pa_batch(doc_id=batch.column(0), fp=fps.view(np.int64))

    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), one, f"doc_id {kind}, fp long")


# --- links ---------------------------------------------------------------------------------


def _half(radius: int) -> int:
    """Half the radius, rounded up: an odd distance has its middle nearer to one end."""
    if not 0 <= radius <= 4:
        raise ValueError("radius must be from 0 to 4")
    return (radius + 1) // 2


def _flips(bits: list[int], most: int) -> list[np.ndarray]:
    """Masks that flip exactly 0, 1 .. most of the bits."""
    one = np.array([1 << b for b in bits], dtype=_U)
    out = [np.zeros(1, _U), one]
    if most >= 2:
        i, j = np.triu_indices(len(bits), 1)
        out.append(one[i] | one[j])
    return out[: most + 1]


def _lowest(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n lowest set bits of x (n up to 2)."""
    first = x & (~x + _U(1))
    rest = x & ~first
    second = rest & (~rest + _U(1))
    return np.where(n >= 1, first, _U(0)) | np.where(n >= 2, second, _U(0))


def links(distinct: DataFrame, radius: int = 4, block_bits: int | None = None, fp_col: str = "fp") -> DataFrame:
    """(a, b), a < b as unsigned numbers: every two of the distinct fingerprints at most `radius` (0 to 4)
    bits apart, each pair once. Nulls are dropped; an empty table gives none.

    Two fingerprints that are d bits apart share several variants; only the canonical one, the smaller
    fingerprint with the lowest d // 2 of the differing bits flipped, reports the pair."""
    half = _half(radius)
    one = distinct.select(F.col(fp_col).alias("fp")).filter(F.col("fp").isNotNull())
    if block_bits is None:
        n = one.count()
        ball = sum(math.comb(64, i) for i in range(half + 1))
        block_bits = min(24, max(2, math.ceil(math.log2(max(1, n * ball / BLOCK_VARIANTS)))))
    # Spread the block's bits over the word; which bits are chosen has no bearing on the result.
    chosen = [i * 64 // block_bits for i in range(block_bits)]
    others = [i for i in range(64) if i not in chosen]
    weights = np.array([1 << b for b in chosen], dtype=_U)
    near = [np.concatenate(_flips(list(range(block_bits)), half)[d : d + 1]) for d in range(half + 1)]
    moves = np.concatenate(near)
    moved = np.concatenate([np.full(len(x), d, np.int8) for d, x in enumerate(near)])
    scatter = np.zeros(len(moves), dtype=_U)
    for k, w in enumerate(weights):
        scatter |= np.where((moves >> _U(k)) & _U(1) > 0, w, _U(0))
    free = _flips(others, half)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
        block = np.zeros(len(fp), dtype=_U)
        for k, b in enumerate(chosen):
            block |= ((fp >> _U(b)) & _U(1)) << _U(k)
        return C.pa_batch(block=(block[:, None] ^ moves[None, :]).ravel().astype(np.int64), fp=np.repeat(fp, len(moves)).view(np.int64), move=np.tile(np.arange(len(moves), dtype=np.int32), len(fp)))

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(_U)
        move = group.column("move").to_numpy()
        a, b = _block_links(fp, fp ^ scatter[move], moved[move].astype(np.int64), free, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    def spread_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield spread(batch.slice(at, 4096))

    return one.mapInArrow(spread_parts, "block long, fp long, move int").groupBy("block").applyInArrow(C.lean(meet), "a long, b long")


def _block_links(fp: np.ndarray, placed: np.ndarray, dist: np.ndarray, free: list[np.ndarray], radius: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of fp whose canonical common variant lies in this block; placed is fp moved into the
    block by dist flips of the block's bits, free the flips of the other bits."""
    half = _half(radius)
    parts = []
    for d in range(half + 1):
        own = np.flatnonzero(dist == d)
        if len(own):
            parts.append((own, np.concatenate(free[: half - d + 1])))
    total = sum(len(o) * len(m) for o, m in parts)
    slices = max(1, math.ceil(total / most))  # bounds the memory; each slice has its share of the variants
    none = np.zeros(0, _U)
    out_a, out_b = [none], [none]
    golden = _U(0x9E3779B97F4A7C15)
    for s in range(slices):
        values, who = [], []
        for own, masks in parts:
            step = max(1, (1 << 21) // len(masks))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                v = (placed[some, None] ^ masks[None, :]).ravel()
                w = np.repeat(some.astype(np.int32), len(masks))
                if slices > 1:
                    keep = ((v * golden) >> _U(40)) % _U(slices) == _U(s)
                    v, w = v[keep], w[keep]
                values.append(v)
                who.append(w)
        if not values:
            continue
        v, w = np.concatenate(values), np.concatenate(who)
        del values, who
        ordered = np.sort(v)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(twice):
            continue
        quick = np.zeros(1 << 20, dtype=bool)
        quick[(twice * golden) >> _U(44)] = True
        maybe = np.flatnonzero(quick[(v * golden) >> _U(44)])
        at = np.minimum(np.searchsorted(twice, v[maybe]), len(twice) - 1)
        maybe = maybe[twice[at] == v[maybe]]
        order = np.argsort(v[maybe], kind="stable")
        v, w = v[maybe][order], w[maybe][order]
        i, gap = np.arange(len(v)), 1
        while len(i):  # pairs `gap` places apart within a run of equal variants
            i = i[i + gap < len(v)]
            i = i[v[i] == v[i + gap]]
            x, y = fp[w[i]], fp[w[i + gap]]
            a, b = np.minimum(x, y), np.maximum(x, y)
            differ = a ^ b
            bits = np.bitwise_count(differ).astype(np.int64)
            mine = (bits > 0) & (bits <= radius) & (v[i] == (a ^ _lowest(differ, bits // 2)))
            out_a.append(a[mine])
            out_b.append(b[mine])
            gap += 1
    return np.concatenate(out_a), np.concatenate(out_b)


# --- components ----------------------------------------------------------------------------


def components(edges: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """(node, root): the connected components of (a, b), each named by its smallest node (as a signed
    number). Up to `small` links, a measured bound, they are joined in one task; beyond that, in rounds of
    large-star and small-star joins, each round a table in the shared folder."""
    n = edges.count()
    if n <= small:
        def union(key: tuple, group: pa.Table) -> pa.Table:
            a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
            node, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
            up = np.arange(len(node))
            x, y = flat[: len(a)], flat[len(a) :]
            while True:  # hooking and pointer jumping
                rx, ry = up[x], up[y]
                if (rx == ry).all():
                    break
                np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
                while (up[up] != up).any():
                    up = up[up]
            return pa.table({"node": node, "root": node[up]})

        return edges.select("a", "b").groupBy(F.lit(0).alias("all")).applyInArrow(union, "node long, root long")
    now = C.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w")).select("a", F.least("m", "a").alias("m"), "w")
        large = C.lookup(both, low, "a", "w").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = C.stored(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w"))
        star = C.lookup(large, low, "a", "w").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = C.stored(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        C.drop_stored(large)
        changed = after.exceptAll(now).limit(1).count() or now.exceptAll(after).limit(1).count()
        C.drop_stored(now)
        now = after
        if not changed:
            break
    stars = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(stars.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(doc_id, fp, n_near, component_id), a row per input row.

    n_near counts the other rows linked directly (equal fingerprints are linked); component_id is the
    smallest id that links reach, the row's own included. Copies meet only as one fingerprint with a
    count, never as pairs of rows. Null texts have fingerprint zero; a null id counts as a row but
    names no component (null if its component has no other id); repeated rows are rows of their own."""
    prints = C.stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = C.stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "classes")
    pairs = C.stored(links(classes, radius), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = both.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("near")).withColumnRenamed("a", "fp")
    roots = components(pairs).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp", "left").join(reached, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("near", F.lit(0)).alias("near"))
    linked = C.stored(linked, "linked")
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("w"))
    per_class = C.stored(C.lookup(linked, named, "root", "w").select("fp", "n", (F.col("near") + F.col("n") - 1).alias("n_near"), "component_id"), "per-class")
    return C.lookup(prints, per_class, "fp", "n").select("doc_id", "fp", "n_near", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """docs with one document of each component of near-duplicates, that with the smallest id; all columns
    stay. Of rows with that id one stays; rows with null ids go if their component has another id."""
    found = C.stored(near_duplicates(docs, id_col, text_col, radius), "near-duplicates")
    gone = C.stored(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    left = C.without(docs, gone, id_col)
    again = C.stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(id_col)), "repeated-ids")
    if not again.limit(1).count():
        return left
    name = C.fresh("__again", left)
    once = left.join(C.if_small(again.withColumnRenamed(id_col, name)), F.col(id_col).eqNullSafe(F.col(name)), "left_semi").dropDuplicates([id_col])
    return C.without(left, again, id_col).unionByName(once)


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16("fp").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")
