import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import vectors as V
from quarryline.operators import dense as DN
from quarryline.operators import lexical as LX


def values(spark, fn, items):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r["y"] for r in d.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_query_plan(spark):
    asked = ["where is serde.workspace set up", "the license-files key is where", "call hash_password from here please", "how does maxOutputLength work here", "open internal/a/b.x for me", "fix hash_password now", "how does this thing work", "在哪里 set serde.workspace here now", "upgrade it to v1.2.3 now", "send an HTTP GET request", "on 2026-08-06 it broke"]
    want = ["serde.workspace", "license-files", "hash_password", "maxOutputLength", "internal/a/b.x", *asked[5:]]
    assert values(spark, T.lexical_query, asked) == want


def test_compound_keys(spark):
    asked = ["set order-by-type and --kube-api-qps please", "nacos.core.auth", "v1-2-3 x", "a-b", "plain words", "\"quoted-key\" (other-key) third-key fourth-key", "under_score-key"]
    assert values(spark, T.compound_keys, asked) == [["order-by-type", "--kube-api-qps"], [], [], [], [], ["quoted-key", "other-key", "third-key"], []]


def test_fragment_noise(spark):
    items = ["", "2026\n年\n8月", "12:30\n1\n2", "1.26.5", "8080", "// ===\n---", "TODO: fix it", "a\nb\nc\nd", "words of prose", "x1\ny2\nz3\nw4\nabc"]
    assert values(spark, lambda c: T.is_fragment_noise(c, F.lit("fallback")), items) == [True, True, True, False, False, True, False, True, False, False]
    assert values(spark, lambda c: T.is_fragment_noise(c, F.lit("ast")), items) == [False] * len(items)


def test_prefixes():
    assert T.normalize_prefix("./a\\b//c/") == "a/b/c"
    for bad in ("/a", "C:/a", "a/../b"):
        with pytest.raises(ValueError):
            T.normalize_prefix(bad)


def test_retry_after(spark):
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    got = values(spark, lambda c: T.retry_after_seconds(c, now), ["5", " 7 ", "-3", "", "soon", "Thu, 01 Jan 2026 00:01:00 GMT", "Thu, 01 Jan 2025 00:01:00 GMT"])
    assert got == [5, 7, 0, 0, 0, 60, 0]


CHUNKS = [("1", "src/conf.toml", "", "order by type settings"), ("2", "src/app.py", "order_loader", "def order_loader by type"), ("3", "doc/zh.md", "", "中文 配置 说明"), ("4", "doc/zh2.md", "", "中文 配置 文档 order"), ("5", "web/x.py", "helper", "the and of")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, path string, symbol string, content string")


def ask(spark, chunks, query, **how):
    q = spark.createDataFrame([("q", query)], "qid string, query string")
    return [r["id"] for r in LX.search(q, chunks, **how).orderBy("rank").collect()]


def ask_all(spark, chunks, queries, **how):
    q = spark.createDataFrame([(x, x) for x in queries], "qid string, query string")
    rows = LX.search(q, chunks, **how).orderBy("rank").collect()
    return [[r["id"] for r in rows if r["qid"] == x] for x in queries]


def test_clauses(spark, chunks):
    kebab, symbol, han, mixed, stops = ask_all(spark, chunks, ["order-by-type", "order_loader", "中文", "请问 配置 order-by-type 在哪里", "the of and"])
    assert kebab[0] == "1" and symbol[0] == "2" and set(han) == {"3", "4"} and mixed[0] == "1" and stops == []


def test_weights(spark, chunks):
    assert ask(spark, chunks, "helper", weights=LX.Weights(1, 1, 0, 0, 0, 0, 0)) == []
    assert ask(spark, chunks, "helper", weights=LX.Weights(0, 0, 0.1, 0, 0, 0, 0)) == ["5"]
    assert ask(spark, chunks, "order", weights=LX.Weights(0, 0, 0, 0, 0, 0, 0)) == []
    assert ask(spark, chunks, "order type", prefix="src/app.py") == ["2"]


def test_prefix_acts_before_the_rank_limit(spark):
    rows = [(str(i), f"out/{i}.py", "", "needle " * 5) for i in range(40)] + [("in", "inside/a.py", "", "needle and much other text here")]
    c = spark.createDataFrame(rows, "id string, path string, symbol string, content string")
    assert ask(spark, c, "needle", k=3, prefix="inside") == ["in"]


def test_fallback_to_the_question_itself(spark, chunks):
    q = spark.createDataFrame([("a", "where is no_such_thing settings"), ("b", "where is order_loader type settings")], "qid string, query string")
    got = LX.lexical_route(q, chunks, 5).collect()
    assert {r["id"] for r in got if r["qid"] == "a"} == {"1"} and {r["id"] for r in got if r["qid"] == "b"} == {"2"}


def test_exact_dense_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((300, 16))
    d = spark.createDataFrame([(f"{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)] + [("zero", [0.0] * 16), ("short", [1.0])], "id string, v array<float>")
    q = d.filter("id < '005'").selectExpr("id AS qid", "v AS qv")
    got = DN.search(q, d, 7).collect()
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32).astype(float)
    for i in range(5):
        best = sorted(range(300), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:7]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == f"{i:03d}"), key=lambda r: r["rank"])] == [f"{j:03d}" for j in best]
    assert DN.search(q, d, 0).count() == 0 and DN.search(q, d.limit(0), 5).count() == 0
    with pytest.raises(Exception):
        DN.search(d.filter("id = 'zero'").selectExpr("id AS qid", "v AS qv"), d, 3).collect()


def test_blocks_of_queries_and_ties(spark, monkeypatch):
    monkeypatch.setattr(DN, "QUERY_BLOCK", 2)
    d = spark.createDataFrame([("zz", [1.0, 0.0]), ("aa", [2.0, 0.0]), ("mm", [3.0, 0.0])], "id string, v array<float>")
    q = spark.createDataFrame([(str(i), [1.0, 0.0]) for i in range(5)], "qid string, qv array<float>")
    got = DN.search(q, d, 3).orderBy("qid", "rank").collect()
    assert len(got) == 15 and [r["id"] for r in got[:3]] == ["aa", "mm", "zz"]


def test_validation(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0]), ("b", [0.0, 0.0])], "id string, v array<float>")
    r = DN.check_rows(d, 2).first()
    assert (r["n_rows"], r["n_ids"], r["wrong_dim"], r["unusable"], r["valid"]) == (3, 2, 1, 1, False)
    assert DN.within_envelope(d, 3) and not DN.within_envelope(d, 2)
    assert d.filter(V.usable(F.col("v"), 2)).count() == 1
