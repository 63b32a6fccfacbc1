"""Fragments judged by their whole texts."""

import pytest

from quarryline import registry
from quarryline.functions import text
from quarryline.plans import base as B
from pyspark.sql import functions as F


def test_the_whole_text_is_judged(spark, sf, monkeypatch, tmp_path):
    rows = [(1, "2024年\n1月\n3日", "a", "en"), (2, "a b\nc d\ne f\ng h", "a", "en"), (3, "1234 then prose that goes on", "a", "en"), (4, "---\n===", "a", "en"), (5, "     word after blanks", "a", "en"), (6, "2024-01-01 12:00", "a", "en"), (7, "1\n2\n3", "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    judged = {int(r["path"].split("/")[-1][:-4]): (r["noise"], r["date_only"]) for r in registry.queries()["p17_p18_fragments"](spark, str(tmp_path)).collect()}
    assert judged == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, False), 7: (True, True)}
    kept = {int(r["path"].split("/")[-1][:-4]) for r in registry.queries()["f10_fragment_gate"](spark, str(tmp_path)).collect()}
    assert kept == {3, 5, 6}
