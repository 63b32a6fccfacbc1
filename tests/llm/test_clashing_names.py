"""Columns with the names that operators would give their own."""

import pytest

from quarryline.llm import common as C
from quarryline.llm import passages, simhash


@pytest.fixture(scope="module")
def clashing(spark, prose):
    text = prose(80, 1)
    rows = [(1, text), (2, text), (2, text), (3, prose(60, 2)), (None, prose(60, 3)), (4, None)]
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], "doc_id long, text string, __gone string, __again string, __of string, __spans string, __key string")


def test_without(clashing):
    got = C.without(clashing, clashing.filter("doc_id = 3").select("doc_id"))
    assert got.columns == clashing.columns and got.count() == 5


def test_deduplicated(clashing):
    got = simhash.deduplicated(clashing)
    assert got.columns == clashing.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "4", "None"]


def test_without_repeats(clashing):
    got = passages.without_repeats(clashing)
    assert got.columns == clashing.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "4", "None"]


def test_lookup(clashing):
    found = clashing.groupBy("doc_id").count()
    assert C.lookup(clashing, found, "doc_id", "count").count() == 6


def test_fresh(clashing):
    assert C.fresh("__OF", clashing) == "__OF_" and C.fresh("plain", clashing) == "plain"
