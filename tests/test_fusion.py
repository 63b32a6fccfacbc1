import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarryline.operators import fusion as FU


def hits(spark, lex, den):
    rows = [("q", "lexical", i + 1, x) for i, x in enumerate(lex)] + [("q", "dense", i + 1, x) for i, x in enumerate(den)]
    return spark.createDataFrame(rows, "qid string, route string, rank int, id string")


def ranked(df):
    return [(r["id"], r["score"], r["source"]) for r in df.orderBy("rank").collect()]


def test_default_weights(spark):
    got = ranked(FU.rrf(hits(spark, "abc", "bd")))
    assert [g[0] for g in got] == ["b", "d", "a", "c"]
    assert [g[2] for g in got] == ["both", "dense", "lexical", "lexical"]
    assert [g[1] for g in got] == pytest.approx([0.15 / 22 + 0.85 / 21, 0.85 / 22, 0.15 / 21, 0.15 / 23])


def test_equal_weights_and_ties_by_id(spark):
    assert [g[0] for g in ranked(FU.rrf(hits(spark, "abc", "bd"), FU.EQUAL))] == ["b", "a", "d", "c"]
    assert [g[0] for g in ranked(FU.rrf(hits(spark, ["z"], ["m"]), FU.EQUAL))] == ["m", "z"]


def test_repeated_ids_keep_their_place(spark):
    got = dict((g[0], g[1]) for g in ranked(FU.rrf(hits(spark, ["a", "a", "b", ""], []))))
    assert got == pytest.approx({"a": 0.15 / 21, "b": 0.15 / 23})


def test_clamps(spark):
    got = ranked(FU.rrf(hits(spark, "a", "d"), FU.Fusion(-1, -5, 1)))
    assert got[0][0] == "d" and got[0][1] == pytest.approx(1 / 61) and got[1][:2] == ("a", 0.0)


@pytest.mark.parametrize("returned,order", [("c", "cabdstu"), ("", "abcdstu"), ("bac", "bacdstu")])
def test_rerank_assembly(spark, returned, order):
    rows = [("q", x, i + 1, x in "abc", x != "s") for i, x in enumerate("abcds")] + [("q", "t", 6, False, True), ("q", "u", 7, False, True)]
    r = spark.createDataFrame(rows, "qid string, id string, rank int, sent boolean, has_chunk boolean")
    back = spark.createDataFrame([("q", x, float(9 - i)) for i, x in enumerate(returned)], "qid string, id string, score double")
    got = FU.rerank_order(r, back, 5).orderBy("rank").collect()
    assert "".join(x["id"] for x in got) == order


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list("abcdefgh")), st.sets(st.sampled_from("abcdefgh")), st.integers(1, 8))
def test_rerank_order_is_a_permutation(spark, ids, back, head):
    r = spark.createDataFrame([("q", x, i + 1, i < 4, True) for i, x in enumerate(ids)], "qid string, id string, rank int, sent boolean, has_chunk boolean")
    b = spark.createDataFrame([("q", x, 1.0) for x in back], "qid string, id string, score double")
    got = [x["id"] for x in FU.rerank_order(r, b, head).orderBy("rank").collect()]
    assert sorted(got) == sorted(ids)


def test_anchor_moves_into_the_window(spark):
    r = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcdef")], "qid string, id string, rank int")
    a = spark.createDataFrame([("q", "e")], "qid string, id string")
    assert "".join(x["id"] for x in FU.anchor(r, a, 3).orderBy("rank").collect()) == "abecdf"
    assert "".join(x["id"] for x in FU.anchor(r, a, 5).orderBy("rank").collect()) == "abcdef"
