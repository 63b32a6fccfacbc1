import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import types as T

from quarryline.llm import common as C
from quarryline.llm import decontam as D


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30), st.lists(st.integers(0, 6), max_size=60))
def test_lcs(a, b):
    assert D.lcs(D._masks(np.array(a)), b, len(a)) == brute_lcs(a, b)


@pytest.fixture(scope="module")
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string, doc_id string")

    return make


def test_leaks_and_paraphrases(docs_of, items, prose):
    r = random.Random(1)
    bench = [(i, prose(35, 500 + i).capitalize() + ".", "x") for i in range(12)]
    docs = [(i, prose(200, i)) for i in range(40)]
    truth = set()
    for k in range(12):
        words = bench[k][1].split()
        if k % 3 == 0:
            hidden = " ".join(words).upper()
        elif k % 3 == 1:
            hidden = ", ".join(words)
        else:
            hidden = " ".join(w if r.random() > 0.2 else "other" + w for w in words)
        d = docs[k][1].split()
        docs[k] = (k, " ".join(d[: 10 * k]) + " " + hidden + " " + " ".join(d[10 * k :]))
        truth.add((k, k))
    got = {(x["doc_id"], x["item_id"]): x for x in D.contaminated(docs_of(docs), items(bench)).collect()}
    assert set(got) == truth
    assert all(got[k, k]["lcs"] == 1.0 for k in range(12) if k % 3 == 0)
    blocks = {(x["doc_id"], x["item_id"]) for x in D.contaminated(docs_of(docs), items(bench), items_at_once=5).collect()}
    assert blocks == truth


def test_scattered_words_are_no_leak(docs_of, items, prose):
    words = prose(30, 1).split()
    spread = " ".join(w + " " + prose(12, i) for i, w in enumerate(words))
    backwards = " ".join(reversed(words))
    docs = docs_of([(1, spread), (2, backwards), (3, prose(300, 9)), *[(10 + i, prose(80, 50 + i)) for i in range(20)]])
    assert D.contaminated(docs, items([(1, " ".join(words), "x")])).count() == 0


def test_answers_decide_on_paraphrases(docs_of, spark, prose):
    q, a = prose(24, 1), prose(6, 2)
    kept = " ".join(w for i, w in enumerate(q.split()) if i % 5 > 0)
    bench = spark.createDataFrame([(1, q + " " + a, a)], "item_id long, text string, answer string")
    docs = docs_of([(1, prose(50, 3) + " " + kept + " " + prose(50, 4)), (2, prose(50, 5) + " " + kept + " " + a + " " + prose(50, 6)), *[(10 + i, prose(80, 50 + i)) for i in range(20)]])
    assert [r["doc_id"] for r in D.contaminated(docs, bench, answer_col="answer").collect()] == [2]


def test_odd_rows(docs_of, items, odd, prose):
    bench = [(1, None, "x"), (2, "", "x"), (None, prose(20, 1), "x"), (3, prose(30, 1), "x"), (3, prose(30, 1), "y"), (4, "...", "x"), (5, "the", "x")]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs_of([(i, t) for i, t in odd if i != 5]), items(bench)).collect()}
    assert got == {(7, 3), (8, 3)}
    assert D.contaminated(docs_of([]), items(bench)).count() == 0
    assert D.contaminated(docs_of(odd), items([])).count() == 0


def test_latent_basis_is_close_to_the_exact_one(docs_of, items, prose):
    bench = [(i, prose(12, 100 + i), "x") for i in range(6)]
    block = D.Items([(i, t) for i, t, _ in bench], [None] * 6)
    r = random.Random(2)
    vocab = [w for _, t, _ in bench for w in t.split()]
    docs = docs_of([(i, " ".join(r.choice(vocab) for _ in range(60))) for i in range(80)] + [(100 + i, t) for i, (_, t, _) in enumerate(bench)])
    places = D.term_places(docs, block.lookup, "doc_id", "text")
    idf, telling, basis = D.latent_basis(places, block, extra=60)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    w = np.zeros((6, len(idf)))
    for i, x in enumerate(block.words):
        np.add.at(w[i], x[telling[x]], 1)
    w *= idf
    assert np.linalg.norm(w - w @ basis @ basis.T) < 0.05 * np.linalg.norm(w)


def test_query_against_brute_force(spark, sf):
    import re

    def words(t):
        return " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "

    docs = [(r["doc_id"], words(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    truth = {(i, j) for i, t in docs for j, b in bench if b in t}
    got = D.query(spark, sf).collect()
    assert truth <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        t, b = dict(docs)[r["doc_id"]].split(), dict(bench)[r["item_id"]].split()
        assert brute_lcs(b, t) >= 0.55 * len(b)


def test_item_ids_of_any_type(docs_of, prose, spark):
    item = prose(40, 8)
    bench = spark.createDataFrame([("mmlu/7", item), ("gsm/1", prose(40, 9)), (None, item)], "item_id string, text string")
    got = D.contaminated(docs_of([(1, prose(60, 1) + " " + item), (2, prose(90, 2))]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, "mmlu/7")]


def test_a_batch_is_worked_on_in_small_slices(monkeypatch, prose):
    """Twelve MB of places come in one batch; what a worker holds for them at a time doesn't grow with it."""
    vocabulary = prose(2500, 1).split()
    r = random.Random(2)
    items = D.Items([(i, " ".join(r.choices(vocabulary, k=40))) for i in range(200)], [None] * 200)
    v, n, each = len(items.lookup.terms), 8000, 250
    rng = np.random.default_rng(3)
    pos, term = np.arange(0, 3 * each, 3, "<u4").tobytes(), rng.integers(0, v, n * each).astype("<u2").tobytes()
    batch = C.pa_batch(doc_id=np.arange(n), n_words=np.full(n, 3 * each), pos=[pos] * n, term=[term[2 * each * i : 2 * each * (i + 1)] for i in range(n)])
    peaks = []

    def traced(fn):
        tracemalloc.start()
        out = fn([batch])
        out = out if isinstance(out, np.ndarray) else list(out)
        peaks.append(tracemalloc.get_traced_memory()[1] / (1 << 20))
        tracemalloc.stop()
        return out

    monkeypatch.setattr(D, "_summed", lambda places, fn, width: traced(fn))
    places = SimpleNamespace(schema=T.StructType([T.StructField("doc_id", T.LongType())]), mapInArrow=lambda fn, schema: traced(fn))
    D.search(places, items, *D.latent_basis(places, items))
    assert len(peaks) == 3 and max(peaks) < 64, peaks
