import zlib

from pyspark.sql import functions as F

from quarryline.llm import sharding as S


def test_odd_rows_and_slots(docs_of, odd):
    got = S.assign(docs_of(odd), range(5), range(6)).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {}
    for i, t in odd:
        texts.setdefault(i, set()).add((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in got)
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)


def test_empty_table(docs_of):
    assert S.assign(docs_of([]), range(3)).count() == 0


def test_growth_and_weights(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    key = F.col("doc_id")
    rows = d.select(S.shard_of(key, range(8)).alias("a"), S.shard_of(key, range(9)).alias("b"), S.shard_of(key, {0: 1.0, 1: 3.0, 2: 0.0}).alias("w")).collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == 8 for r in moved) and 350 < len(moved) < 540
    heavy = sum(r["w"] == 1 for r in rows)
    assert 2850 < heavy < 3150 and not any(r["w"] == 2 for r in rows)
    sizes = [sum(r["a"] == s for r in rows) for s in range(8)]
    assert min(sizes) > 400


def test_one_id_holds_most_rows(docs_of):
    d = docs_of([(1, "same")] * 300 + [(i, "t") for i in range(2, 60)])
    got = S.assign(d, range(3)).groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n"), F.countDistinct("slot").alias("k")).collect()
    assert all(r["m"] + 1 == r["n"] == r["k"] for r in got)
    assert S.moved(S.assign(d, range(3), range(4))).filter("grown_shard <> 3").count() == 0


def test_query_equals_sql(spark, sf, duck, same):
    same(S.query(spark, sf), duck.sql(S.ORACLE))
