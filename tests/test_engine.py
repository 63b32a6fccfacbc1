import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryline.operators import evaluation as EV
from quarryline.operators import providers as PR
from quarryline.operators import reliability as RL
from quarryline.plans import engine as EN
from quarryline.plans import render as RN
from quarryline.streaming import watch as WT


def put(root, files):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)


FILES = {"core/auth.py": "def hash_password(x):\n    return x\n", "core/db.py": "def connect():\n    return 1\n", "web/view.js": "export function render(a) {\n  return a;\n}\n", "README.md": "# Title\n\nSome words on passwords.\n", ".env": "SECRET=1\n", "keys/id_rsa": "k\n"}


@pytest.fixture
def engine(spark, tmp_path):
    put(tmp_path / "ws", FILES)
    e = EN.Engine(spark, EN.Options(str(tmp_path / "data"), embedder=PR.HashEmbedder(16), reranker=PR.OverlapReranker(), fresh_seconds=0.0))
    yield e, tmp_path / "ws"
    e.close()


def test_life_of_a_workspace(engine):
    e, ws = engine
    first = e.sync(str(ws))
    assert first.mode == "full:first-build" and first.files == 4 and first.coverage == "100%"
    assert e.sync(str(ws)).revision == first.revision and not e.changed(str(ws))
    put(ws, {"core/db.py": "def connect_again():\n    return 2\n"})
    (ws / "web/view.js").unlink()
    assert e.changed(str(ws))
    second = e.sync(str(ws))
    assert second.mode == "delta" and second.files == 3 and second.deleted == 1
    st = e.status(str(ws))
    assert st["segments"] == 2 and st["tombstones"] == 1 and st["top_level_file_counts"] == {"core": 2, ".": 1} and st["coverage"] == "100%"
    e.options.fresh_seconds = 1e9
    r = e.search(str(ws), "where is connect_again defined exactly")
    assert r["mode"] == "hybrid+rerank" and r["hits"][0]["path"] == "core/db.py" and "def connect()" not in r["text"] and "SECRET" not in r["text"]
    only = e.search(str(ws), "hash_password", prefix="core", detail="paths")
    assert {h["path"] for h in only["hits"]} <= {"core/auth.py", "core/db.py"} and only["text"].startswith("## core/auth.py:1-") and "```" not in only["text"]
    m = e.repo_map(str(ws))
    assert "core/ (2 files" in m and "hash_password" in m
    assert e.embed_plan(str(ws))["pending"] == 0
    assert e.search_many([str(ws / "nowhere")], "hash_password")["outcome"] == "failed"
    for bad in ({"query": " "}, {"query": "x", "budget": -1}, {"query": "x", "detail": "most"}, {"query": "x", "prefix": "/abs"}):
        with pytest.raises(ValueError):
            e.search(str(ws), **bad)


def test_degraded_and_denied(spark, tmp_path):
    put(tmp_path / "ws", FILES)
    e = EN.Engine(spark, EN.Options(str(tmp_path / "d"), embedder=PR.HashEmbedder(8), max_vectors=1, fresh_seconds=1e9))
    r = e.search(str(tmp_path / "ws"), "hash_password")
    assert r["mode"] == "lexical" and r["text"].startswith("[degraded: dense-skipped(envelope)]")
    with pytest.raises(RuntimeError):
        RN.check_strict(True, r["degraded_reason"], False, False, 1)
    RN.check_strict(False, r["degraded_reason"], False, False, 1)
    e.close()


def test_import_outcomes_reach_the_journal(spark, tmp_path):
    put(tmp_path / "ws", {"a.py": "x = 1\n"})
    e = EN.Engine(spark, EN.Options(str(tmp_path / "d"), fresh_seconds=1e9))
    e.sync(str(tmp_path / "ws"))
    e.export_jobs(str(tmp_path / "ws"), str(tmp_path / "jobs"))
    jobs = spark.read.json(str(tmp_path / "jobs"))
    key = jobs.first()["embed_key"]
    assert jobs.first()["text"].startswith("This chunk is from a.py, python")
    rows = spark.createDataFrame([(1, "unknown", [1.0, 2.0]), (2, key, [1.0]), (3, key, [0.0, 0.0]), (4, key, [3.0, 4.0]), (5, key, [3.0, 4.0])], "n long, embed_key string, v array<float>")
    assert e.import_vectors(str(tmp_path / "ws"), rows, 2) == {"unknown_key": 1, "wrong_dim": 1, "bad_vector": 1, "appended": 1, "existing": 1}
    assert e.import_vectors(str(tmp_path / "ws"), rows.filter("n = 4"), 2) == {"existing": 1}
    e.close()


# --- rendering -------------------------------------------------------------------------------


def blk(path, start, n, score=0.0, symbol=""):
    return RN.Block(path, start, start, "x" * n, symbol, "text", score)


def test_render_budget_and_markers():
    blocks = [blk("a.go", 1, 10), blk("a.go", 9, 10), blk("b.go", 1, 10), blk("c.go", 1, 10)]
    one = len(RN.section(blocks[0]))
    r = RN.render(blocks, 3 * one + 5)
    assert [h["shown"] for h in r.hits] == [True, False, True, True] and r.truncated and (r.candidate_blocks, r.shown_blocks, r.shown_files) == (4, 3, 3)
    assert "3 of 4 blocks shown" in r.text
    r = RN.render(blocks, one)
    assert "omitted files: b.go:1-1, c.go:1-1" in r.text
    r = RN.render([RN.Block("ä.go", 1, 1, "é" * 100)], 50)
    assert r.truncated and r.text.encode()[:50].decode("utf-8", "ignore")
    assert RN.render([]).text == RN.NO_HITS
    assert RN.section(RN.Block("p.py", 3, 4, "a\nb\n", "f", "python"), True) == "## p.py:3-4 f\n```python\n     3\ta\n     4\tb\n```\n\n"


# --- evaluation ------------------------------------------------------------------------------


def test_known_metrics(spark):
    run = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate(["d1", "x", "d2", "d1", "d3"])], "qid string, rank int, doc_id string")
    qrels = spark.createDataFrame([("q", "d1", 3), ("q", "d2", 2), ("q", "d3", 1), ("q", "d4", 1)], "qid string, doc_id string, rel int")
    queries = spark.createDataFrame([("q", None), ("r", None)], "qid string, grp string")
    import math

    got = {(r["metric"], r["k"]): r["value"] for r in EV.per_query(queries, run, qrels, (("set_recall", 3), ("all_hit", 10), ("ap", 3), ("ndcg", 3), ("mrr", 10))).collect()}
    assert got["set_recall", 3] == 0.5 and got["all_hit", 10] == 0 and got["mrr", 10] == 1
    assert got["ap", 3] == pytest.approx((1 + 2 / 3) / 4)
    assert got["ndcg", 3] == pytest.approx((7 + 3 / math.log2(4)) / (7 + 3 / math.log2(3) + 1 / math.log2(4)), abs=1e-8)
    ev = EV.evaluate(queries, run, qrels, (("recall", 5),)).collect()
    assert [(r["grp"], r["value"], r["n_queries"], r["n_skipped"]) for r in ev] == [("all", 1.0, 1, 1)]


def test_bootstrap(spark):
    a = spark.createDataFrame([(str(i), 0.0) for i in range(40)], "qid string, value double")
    same = EV.paired_bootstrap(a, a, 200).first()
    assert same["delta"] == 0 and not same["significant"]
    win = EV.paired_bootstrap(a, a.withColumn("value", F.lit(1.0)), 200).first()
    assert win["delta"] == 1 and win["significant"]
    mixed = a.withColumn("value", (F.col("qid").cast("int") % 3).cast("double"))
    assert EV.paired_bootstrap(a, mixed, 100, 3).first() == EV.paired_bootstrap(a.repartition(3), mixed.repartition(2), 100, 3).first()


# --- providers, control and streams ----------------------------------------------------------


def test_batches_are_halved_and_retried():
    class Picky(PR.HashEmbedder):
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls == 1:
                raise PR.Transient("busy", 3.0)
            if len(texts) > 2:
                raise PR.TooLarge
            return super().embed(texts)

    waits = []
    p = Picky(4)
    assert PR.embed_batch(p, list("abcde"), sleep=waits.append) == PR.HashEmbedder(4).embed(list("abcde")) and waits == [3.0]

    class Short(PR.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[1:]

    with pytest.raises(ValueError):
        PR.embed_batch(Short(4), ["a", "b"])


def test_governor():
    g = RL.Governor(8, 16)
    for i in range(40):
        g.observe("success", i, 1000, 1.0)
    assert g.window > 8 and g.rate is None
    g.observe("rate_limited", 40)
    assert g.rate == RL.FLOOR_TOKENS
    g.observe("success", 41, 10, 1.0)
    assert g.rate == pytest.approx(RL.FLOOR_TOKENS * 1.02)
    w = g.window
    g.observe("overload", 42)
    assert g.window == w // 2
    b = WT.Backoff()
    assert [b.failed(0) for _ in range(7)] == [5, 10, 20, 40, 80, 120, 120]
    b.succeeded()
    assert b.failed(0) == 5


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", True, "transient", 0), ("a", "2024-01-01 00:00:10", True, "transient", 0), ("b", "2024-01-01 00:00:00", True, "auth", 0), ("b", "2024-01-01 00:00:05", False, "", 0)]
    pdf = pd.DataFrame(rows, columns=["key", "ts", "failed", "kind", "retry_after"]).assign(ts=lambda d: pd.to_datetime(d.ts), tokens=7)
    src = str(tmp_path / "in")
    spark.createDataFrame(pdf).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = WT.circuits(stream).writeStream.outputMode("update").format("memory").queryName("circuits").start()
    q.processAllAvailable()
    q.stop()
    got = {r["key"]: (r["state"], r["failures"], r["wait_s"]) for r in spark.table("circuits").collect()}
    assert got == {"a": ("backoff", 2, 60.0), "b": ("healthy", 0, 0.0)}
    q = WT.minute_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: (r["requests"], r["tokens"]) for r in spark.table("usage").collect()} == {"a": (2, 14), "b": (2, 14)}


def test_watch(spark):
    seen = []
    q = WT.watch(spark, ["r"], lambda r: not seen, seen.append, poll="0 seconds", debounce=0.0)
    end = time.time() + 30
    while not seen and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert seen == ["r"]
