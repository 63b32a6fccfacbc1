"""BM25 where the chunks lie, against BM25 by postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline import registry
from quarryline.operators import dense as DN
from quarryline.operators import lexical as LX
from quarryline.operators import scoring as SC


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["漢"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    chunks = spark.createDataFrame([(f"{i:02d}", f"docs/src{i % 3}/w{i % 5}.txt", None if i == 7 else text(r.randint(0, 25))) for i in range(60)], "id string, path string, content string").repartition(4)
    queries = spark.createDataFrame([(i, text(4)) for i in range(9)] + [(20, "w1abc-w2def"), (21, "w1 w1 w2"), (22, ""), (23, None), (None, "w1")], "qid long, query string")
    return queries, chunks


def _no(*_, **__):
    raise AssertionError("postings were joined")


@pytest.mark.parametrize("weights", [LX.Weights(1.0, 0, 0, 0, 0, 0, 0), LX.Weights(1.0, 1.0, 0, 0, 4.0, 1.0, 2.0)])
@pytest.mark.parametrize("prefix", ["", "docs/src1"])
def test_scores_where_chunks_lie_equal_those_by_postings(corpus, monkeypatch, weights, prefix):
    queries, chunks = corpus
    fields = ("content", "path")
    want = LX.search(queries, chunks, 5, weights, prefix, posted=LX.postings(chunks, fields=fields), stats=LX.field_stats(chunks, fields)).collect()
    for name, to in (("ROWS", 4), ("CLAUSES", 3), ("HELD", 1)):
        monkeypatch.setattr(SC, name, to)
    monkeypatch.setattr(LX, "match_scores", _no)
    got = LX.search(queries, chunks, 5, weights, prefix).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_every_word_of_a_key_is_needed(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha alpha"), ("c", "beta x alpha")], "id string, content string")
    q = spark.createDataFrame([(1, "alpha-beta")], "qid long, query string")
    monkeypatch.setattr(LX, "match_scores", _no)
    assert {r["id"] for r in LX.search(q, chunks, 5, LX.Weights(0, 0, 0, 0, 0, 0, 2.0)).collect()} == {"a", "c"}


def test_ids_of_several_rows_go_by_postings(corpus):
    queries, chunks = corpus
    twice = chunks.unionByName(chunks.filter("id < '05'"))
    assert not LX.one_row_each(twice)
    found = LX.search(queries, twice, 5, LX.Weights(1.0, 0, 0, 0, 0, 0, 0))
    assert found.groupBy("qid", "id").count().filter("count > 1").count() == 0


def test_symbols_and_term_counts_need_no_postings(spark, sf, monkeypatch):
    monkeypatch.setattr(LX, "postings", _no)
    assert registry.queries()["l5_exact_symbol"](spark, sf).count() > 0
    assert registry.queries()["l3_postings"](spark, sf).count() > 0


def test_term_counts(spark):
    d = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["a"],)], "t array<string>")
    assert {tuple(r) for r in SC.term_counts(d, "t").select("term", F.col("df"), "cf").collect()} == {("a", 2, 3), ("b", 1, 1)}


@pytest.mark.parametrize("n_queries", [5, 60])
def test_nearest_in_blocks_equal_brute_force(spark, monkeypatch, n_queries):
    """Products decide nothing that the sum in double precision doesn't; ties, several dimensions, several passes."""
    for name, to in (("QUERY_BLOCK", 7), ("VECTOR_BLOCK", 16), ("PASS", 25), ("HELD", 40)):
        monkeypatch.setattr(DN, name, to)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(150)] + [(i, [1.0, 0.5]) for i in range(150, 160)] + [(160, [0.0] * 4), (161, None)]
    d = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    good = [(i, v) for i, v in rows if v and any(v)]
    unit = {i: [float(np.float32(x / np.sqrt(sum(y * y for y in v)))) for x in v] for i, v in good}
    asked = [i for i, _ in good if i % 3 == 0][: n_queries - 1] + [150]
    got = DN.search(d.filter(F.col("id").isin(asked)).selectExpr("id AS qid", "v AS qv"), d, 6).collect()

    def score(a, b):
        s = 0.0
        for x, y in zip(unit[a], unit[b]):
            s += x * y
        return round(s, 9)

    want = {(q, i, n + 1) for q in asked for n, i in enumerate(sorted((i for i in unit if len(unit[i]) == len(unit[q])), key=lambda i: (-score(q, i), i))[:6])}
    assert {(x["qid"], x["id"], x["rank"]) for x in got} == want and all(abs(x["score"] - score(x["qid"], x["id"])) < 1e-12 for x in got)


def test_many_queries_pair_no_rows(spark, sf):
    """Query and vector never meet in a join."""
    plan = registry.queries()["v1_exact_top60"](spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_tasks_follow_the_ranges(spark, monkeypatch):
    """A task orders a bounded number of ranges, however many there are."""
    from quarryline.operators import chunks as CH

    d = spark.range(1000).selectExpr("id % 100 AS k", "CAST(id DIV 100 * 3 AS INT) AS a", "CAST(id DIV 100 * 3 + id % 5 AS INT) AS b")
    before = {tuple(r) for r in CH.coalesce_ranges(d, "k", "a", "b").collect()}
    monkeypatch.setattr(CH, "RANGES", 100)
    got = CH.coalesce_ranges(d, "k", "a", "b")
    assert got.rdd.getNumPartitions() == 10 and {tuple(r) for r in got.collect()} == before
