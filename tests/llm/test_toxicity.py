import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import toxicity as X


def entries(rng, n, terms):
    """n random unit vectors as a matrix and as entries; some are equal, one is empty."""
    full = (rng.random((n, terms)) * (rng.random((n, terms)) < rng.choice([0.02, 0.1, 0.7], terms))).round(2)
    if n > 4:
        full[3], full[2] = full[1], 0
    full = full / np.maximum(np.sqrt((full**2).sum(axis=1, keepdims=True)), 1e-12)
    who, term = np.nonzero(full)
    return full, (who, term, full[who, term])


@pytest.mark.parametrize("n,terms,k", [(0, 6, 3), (1, 6, 3), (7, 7, 25), (900, 40, 5), (2000, 300, 25)])
def test_index_is_exact(n, terms, k):
    rng = np.random.default_rng(n)
    have, stored = entries(rng, n, terms)
    asked, given = entries(rng, 61, terms)
    q, e, s = X.BlockMaxIndex(*stored, n, terms).search(*given, 61, k)
    for i in range(61):
        sims = have @ asked[i]
        best = np.sort(sims[sims > 1e-9])[::-1][:k]
        assert np.allclose(s[q == i], best, atol=1e-5) and np.allclose(sims[e[q == i]], s[q == i], atol=1e-5)
        assert len(set(e[q == i])) == len(best)


def test_search_works_on_one_query_at_a_time():
    """Beside scores, of 128 x 2,048 here, it needs memory for the entries of one query, 12,000 here."""
    n, terms, each = 2000, 2000, 200
    rng = np.random.default_rng(5)
    index = X.BlockMaxIndex(np.repeat(np.arange(n), 60), rng.permuted(np.tile(np.arange(terms), (n, 1)), axis=1)[:, :60].ravel(), np.full(n * 60, 0.13, np.float32), n, terms)
    assert (index.column < 0).all()  # all lists are short
    asked = (np.repeat(np.arange(128), each), np.tile(np.arange(each), 128), np.full(128 * each, 0.07, np.float32))
    index.search(*asked, 128, 25)
    tracemalloc.start()
    index.search(*asked, 128, 25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_lookup_finds_all_and_only_known_hashes(n):
    rng = np.random.default_rng(n)
    near = np.arange(n // 2, dtype=np.uint64) + np.uint64(1 << 63)  # these begin with the same bits
    terms = np.unique(np.r_[near, rng.integers(0, 1 << 64, n - n // 2, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)[:n]])
    asked = rng.permutation(np.r_[terms, terms, terms + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64)])
    at, place = X.Lookup(terms).places(asked)
    assert (at == np.flatnonzero(np.isin(asked, terms))).all() and (terms[place] == asked[at]).all()


def test_isotonic_curve_rises():
    x, y = X.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1


@pytest.fixture(scope="module")
def labelled(spark, docs_of, prose):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        t = prose(r.randint(20, 120), i).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(max(2, len(t) // 20)):
                t[r.randrange(len(t))] = r.choice(["vileword", "nastyword", "uglyword"])
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic), "clash"))
    return docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = X.fit(docs, X.train_rows(labels))
    got = X.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter(X.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and all(r["predicted"] == r["toxic"] for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(len(r["evidence"]) == 3 for r in got if r["toxic"])


def test_labels_of_the_held_out_fold_have_no_bearing(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, X.train_rows(labels)), X.fit(docs, X.train_rows(turned))
    assert (a.terms == b.terms).all() and a.ids == b.ids and (a.curve_y == b.curve_y).all()


def test_odd_rows(docs_of, odd, labelled):
    docs, labels = labelled
    model = X.fit(docs, X.train_rows(labels))
    got = X.score(docs_of([*odd, (70, "VILEWORD, nastyword!")]), model).collect()
    assert len(got) == len(odd) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["doc_id"] for r in got if r["predicted"]] == [70]
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert X.score(docs_of([]), model).count() == 0


def test_without_labels_or_with_one_kind(docs_of, labelled, spark):
    docs, labels = labelled
    none = X.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in X.score(docs, none).collect()} == {0}
    one = X.fit(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in X.score(docs, one).collect()} == {0}
    assert X.fit(docs_of([]), labels).ids == []


def test_repeated_ids_and_labels(docs_of, spark):
    docs = docs_of([(1, "b text"), (1, "a text"), (2, "other words"), (2, "other words"), (3, "a text")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 0), (9, 1)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert model.ids == [1, 2] and model.toxic.tolist() == [1, 0] and model.total.tolist() == [2, 1]


def brute_force(spark, sf):
    """Scores of all documents by cosines with every example."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["toxic"] for r in X.train_rows(spark.read.parquet(f"{sf}/labels.parquet")).collect()}

    def counts(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low).encode().split(b" ")
        out = {}
        for w in words:
            for f in ([w] if w else []) + [(w[:n], n) for n in X.BEGINNINGS if len(w) > n]:
                out[f] = out.get(f, 0) + 1
        return out

    bags = [counts(r["text"]) for r in docs]
    chosen = [i for i, r in enumerate(docs) if r["doc_id"] in labels]
    terms = {t: j for j, t in enumerate({t for i in chosen for t in bags[i]})}
    tf = np.zeros((len(docs), len(terms)))
    for i, bag in enumerate(bags):
        for t, c in bag.items():
            if t in terms:
                tf[i, terms[t]] = c
    y = np.array([labels[docs[i]["doc_id"]] for i in chosen], float)
    have = tf[chosen] > 0
    scale = np.log1p(len(docs) / (1 + (tf > 0).sum(axis=0))) * X.relevance(have.sum(axis=0), (have * y[:, None]).sum(axis=0), len(y), y.sum())
    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * scale
    w /= np.maximum(np.sqrt((w**2).sum(axis=1, keepdims=True)), 1e-12)
    empty = ~have.any(axis=1)
    prior = (y[empty].sum() + 0.5 * y.mean()) / (empty.sum() + 0.5)

    def vote(sims, labels):
        """The k nearest; those that tie with the last of them share what is left."""
        good = np.flatnonzero(sims > 1e-9)
        o = good[np.argsort(-sims[good].round(6), kind="stable")]
        left, up, down = X.NEIGHBOURS, 0.0, 0.0
        while len(o) and left > 0:
            tie = o[sims[o].round(6) == sims[o[0]].round(6)]
            take = min(left, len(tie))
            x = take * sims[tie[0]] / (1.02 - min(1.0, sims[tie[0]])) ** 2
            up, down, left, o = up + x * labels[tie].mean(), down + x, left - take, o[len(tie) :]
        return (up + 2 * prior) / (down + 2) if down else prior

    sims = w @ w[chosen].T
    raw = np.array([vote(s, y) for s in sims])
    out = np.array([vote(np.delete(sims[i], j), np.delete(y, j)) if tf[i].any() else prior for j, i in enumerate(chosen)])
    o = np.lexsort((y, out))
    return {r["doc_id"]: x for r, x in zip(docs, np.interp(raw, *X.isotonic(out[o], y[o], np.ones(len(y)))))}, prior


def test_query_against_brute_force(spark, sf):
    import zlib

    want, _ = brute_force(spark, sf)
    got = X.query(spark, sf).collect()
    assert len(got) == len(want) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    off = [abs(r["score"] - want[r["doc_id"]]) for r in got]
    assert np.mean(np.array(off) < 1e-3) > 0.99, sorted(off)[-20:]
