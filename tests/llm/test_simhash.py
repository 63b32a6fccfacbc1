import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quarryline.llm import simhash as S


def plain(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(odd, prose):
    for _, t in odd[:5] + odd[8:]:
        assert S.fingerprint(t) == plain(t)
    assert S.fingerprint("A b\tC\x0bd") == S.fingerprint("a b c d") == xxh64_intdigest(b"a b c d", 42)


def brute(fps, radius=4):
    fps = np.array(fps, np.uint64)
    return {tuple(sorted((int(fps[i]), int(fps[j])))) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= radius}


def neighbours(rng, n, spread):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    out = set(base.tolist())
    for x in base.tolist():
        for _ in range(spread):
            y = x
            for b in rng.choice(64, rng.integers(0, 8), replace=False):
                y ^= 1 << int(b)
            out.add(y)
    return sorted(out)


@pytest.mark.parametrize("radius,bits", [(4, 4), (4, 9), (3, 5), (2, 6), (1, 3), (0, 2)])
def test_links_equal_brute_force(spark, radius, bits):
    fps = neighbours(np.random.default_rng(radius), 60, 6)
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = [tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in S.links(d, radius, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(fps, radius)


def test_sliced_blocks_lose_nothing():
    fps = np.array(neighbours(np.random.default_rng(3), 40, 5), np.uint64)
    free = S._flips(list(range(64)), 2)
    a, b = S._block_links(fps, fps, np.zeros(len(fps), np.int64), free, 4, most=20_000)
    assert {tuple(sorted(map(int, x))) for x in zip(a, b)} == brute(fps)


def test_components_both_ways(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1040)]
    d = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    one = sorted(map(tuple, S.components(d).collect()))
    two = sorted(map(tuple, S.components(d, small=0).collect()))
    assert one == two and dict(one)[1040] == 1000


def test_near_duplicates_of_odd_rows(docs_of, odd):
    got = S.near_duplicates(docs_of(odd)).collect()
    assert len(got) == len(odd)
    empty = [r for r in got if r["fp"] == 0]
    assert len(empty) == 4 and {r["n_near"] for r in empty} == {3} and {r["component_id"] for r in empty} == {1}
    same = [r for r in got if r["doc_id"] in (7, 8)]
    assert [r["n_near"] for r in same] == [2, 2, 2] and {r["component_id"] for r in same} == {7}
    assert S.near_duplicates(docs_of([])).count() == 0


def test_hot_copies_are_not_paired(docs_of, prose):
    rows = [(i, prose(40, 1)) for i in range(400)] + [(1000 + i, prose(40, 10 + i)) for i in range(300)]
    got = {r["doc_id"]: r for r in S.near_duplicates(docs_of(rows)).collect()}
    assert len(got) == 700 and got[399]["n_near"] == 399 and got[399]["component_id"] == 0


def test_deduplicated_keeps_one_each(docs_of, prose):
    rows = [(5, prose(60, 1)), (3, prose(60, 1)), (3, prose(60, 1)), (9, prose(60, 2)), (None, prose(60, 3)), (None, prose(60, 3)), (None, prose(60, 2))]
    got = S.deduplicated(docs_of(rows))
    assert got.columns == docs_of([]).columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [3, 9] or sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 3, 9]
    assert S.deduplicated(docs_of([])).count() == 0


def test_query_against_brute_force(spark, sf):
    got = S.query(spark, sf).orderBy("doc_id").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fp = {i: plain(t) for i, t in docs.items()}
    ids = sorted(fp)
    v = np.array([fp[i] for i in ids], np.uint64)
    near = np.array([[np.bitwise_count(a ^ b) <= 4 for b in v] for a in v])
    comp = np.arange(len(ids))
    for _ in ids:
        comp = np.array([comp[n].min() for n in near])
    assert [(r["doc_id"], r["fingerprint"], r["n_near"], r["component_id"]) for r in got] == [(i, f"{fp[i]:016x}", int(near[k].sum()) - 1, ids[comp[k]]) for k, i in enumerate(ids)]
