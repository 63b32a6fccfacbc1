"""Searches with every query they are meant for."""

from pyspark.sql import functions as F

from quarryline import registry
from quarryline.plans import base as B


def test_every_twentieth_vector_is_a_query(spark, sf):
    got = {r["qid"]: r["n"] for r in registry.queries()["v1_exact_top60"](spark, sf).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    ids = {r["id"] for r in B.vectors(spark, sf).select("id").collect()}
    assert set(got) == {i for i in ids if i % 20 == 0} and set(got.values()) == {min(60, len(ids))}


def test_every_symbol_is_a_query(spark, sf):
    got = {r["qid"]: r["n"] for r in registry.queries()["l5_exact_symbol"](spark, sf).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    df = {r["symbol"]: r["count"] for r in B.chunks(spark, sf).filter("symbol <> ''").groupBy("symbol").count().collect()}
    assert got == {s: min(10, n) for s, n in df.items()} and max(df.values()) > 10
