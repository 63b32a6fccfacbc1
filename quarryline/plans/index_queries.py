"""Queries over snapshots of an index, embeddings, provider events and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from ..operators import fusion as FU
from ..operators import maintenance as MT
from ..operators import reliability as RL
from . import base as B


def _half(spark, sf, later: bool):
    """The newest write of each path among the even events, or among all."""
    s = B.snapshots(spark, sf)
    s = s if later else s.filter("event_id % 2 = 0")
    return MT.latest_per_key(s.select("path", "seg_ord", "deleted", "size", "mtime", "blob"), "path", ["seg_ord"])


def j1_i15_diff(spark, sf):
    cur = _half(spark, sf, True).filter("NOT deleted")
    prev = _half(spark, sf, False).filter("NOT deleted")
    return MT.diff(cur, prev)


def j2_reused_chunks(spark, sf):
    cur = _half(spark, sf, True).filter("NOT deleted").select("path", "blob")
    old = _half(spark, sf, False).select("path", "blob", "size")
    return MT.reuse_chunks(cur, old).select("path", "size")


def j3_w4_live_rows(spark, sf):
    s = B.snapshots(spark, sf)
    dead = MT.latest_per_key(s.select("path", "seg_ord", "deleted"), "path", ["seg_ord"]).filter("deleted")
    return MT.live_rows(s, tombstones=dead).select("path", "seg_ord", "size")


def _keys(spark, sf):
    v = B.vectors(spark, sf)
    return v.select(F.sha2(F.col("id").cast("string"), 256).alias("embed_key"), "v", "id", "label")


def j4_vector_priority(spark, sf):
    k = _keys(spark, sf)
    return MT.vectors_by_priority([k.filter("id % 5 = 0"), k.filter("id % 3 = 0"), k.filter("id % 2 = 0")]).select("embed_key", "priority", F.round(F.col("v")[0].cast("double"), 6).alias("first"))


def j5_pending_keys(spark, sf):
    k = _keys(spark, sf)
    return MT.pending_keys(k, k.filter("id % 3 = 0"), k.filter("id % 7 = 0"))


def j12_i10_unreferenced(spark, sf):
    """Every event is a segment and a revision that names two."""
    e = B.table(spark, sf, "events")
    s = e.select(F.concat(F.lit("seg"), F.col("event_id").cast("string")).alias("id"))
    named = lambda n: F.concat(F.lit("seg"), n.cast("string"))
    m = e.select(F.col("event_id").alias("revision"), F.array(named(F.col("user_id")), named(F.floor(F.col("event_id") * 7 / 10))).alias("segments"))
    return MT.unreferenced(s, m)


def u2_tombstones(spark, sf):
    prev = _half(spark, sf, False).filter("deleted")
    cur = _half(spark, sf, True)
    gone = cur.filter("deleted")
    rejected = cur.filter("NOT deleted AND size % 10 = 0")
    return MT.tombstones(prev, gone, rejected, cur.filter("NOT deleted"))


def a1_live_counts(spark, sf):
    f = _half(spark, sf, True).filter("NOT deleted").select("path", (F.col("size") % 9).alias("chunk_count"), F.col("size").alias("bytes"), (F.col("size") % 4).alias("covered_chunks"))
    return MT.live_counts(f)


def a2_garbage(spark, sf):
    s = B.snapshots(spark, sf).select(F.lit(1).alias("chunks"))
    live = _half(spark, sf, True).filter("NOT deleted").select(F.lit(1).alias("chunk_count"))
    return MT.garbage_ratio(s, live)


def a3_covered(spark, sf):
    k = _keys(spark, sf)
    c = k.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("path"), "embed_key")
    return MT.covered_per_file(c, k.filter("id % 4 = 1"))


def i1_build_modes(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.lit(1) + (F.col("event_id") % 7 > 0).cast("int")).alias("previous_schema"), (F.col("event_id") % 11 == 0).alias("lexical_damaged"), (F.col("event_id") % 10 == 0).alias("repair"), (F.col("event_id") % 3 > 0).alias("changed"), (F.col("event_id") % 12).alias("segments"), ((F.col("event_id") % 17) / 17).alias("garbage"))
    return MT.build_mode_column(e).select("event_id", "mode")


def s13_stat_cache(spark, sf):
    prev = _half(spark, sf, False).select("path", "size", "mtime", "blob")
    cur = _half(spark, sf, True).select("path", "size", "mtime", F.col("blob").alias("blob_if_read"), F.to_timestamp(F.lit("2030-01-01 00:00:00")).alias("now"))
    return MT.stat_cached(cur, prev).select("path", "reused", "blob")


def a10_embed_plan(spark, sf):
    k = _keys(spark, sf)
    return MT.embed_plan(k.unionByName(k.filter("id % 6 = 0")), k.filter("id % 3 = 0"), k.filter("id % 4 = 0"))


def a11_import(spark, sf):
    k = _keys(spark, sf)
    v = F.when(F.col("id") % 9 == 0, F.slice("v", 1, 10)).when(F.col("id") % 8 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    first = k.select(F.col("id").alias("n"), "embed_key", v.alias("v"))
    again = k.filter("id % 5 = 0").select((F.col("id") + 100000).alias("n"), "embed_key", "v")
    return MT.import_outcomes(first.unionByName(again), k.filter("id % 10 <> 3"), k.filter("id % 7 = 0"), 64)


def a12_outcomes(spark, sf):
    e = B.table(spark, sf, "events").select((F.col("event_type") != "error").alias("ok"), F.when(F.col("event_id") % 5 == 0, "embed-skipped").otherwise("").alias("degraded_reason"))
    return MT.workspace_outcomes(e)


def a13_rate(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", (F.col("event_id") % 50).alias("done"), (F.col("event_id") % 70).alias("pending"), (F.col("event_id") % 30).alias("elapsed_s"))
    return MT.embed_rate(e).select("event_id", "rate_per_min", "eta_s")


def a14_first_seen(spark, sf):
    return MT.first_seen(B.table(spark, sf, "events"), "user_id", "event_id")


def i5_zero_chunk_files(spark, sf):
    """Files whose content gives no chunk are deletions."""
    f = B.files(spark, sf).withColumn("content", F.when(F.col("doc_id") % 10 == 0, "  \n").otherwise(F.col("content")))
    from ..operators.chunks import line_windows

    return f.join(line_windows(f).select("path").distinct(), "path", "left_anti").select("path")


def i18_best_profile(spark, sf):
    e = B.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("vector_count"))
    return MT.best_profile(e.select(F.col("user_id").alias("identity"), F.col("event_type").alias("profile"), "vector_count"))


def i19_journal(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("embed_key"), (F.col("event_id") % 100 + 1).alias("bytes"))
    return MT.journal_kept(e, 700, 20_000)


def i21_batch(spark, sf):
    q = B.table(spark, sf, "documents").select(F.col("doc_id").alias("custom_id"))
    r = q.filter("custom_id % 50 <> 1").withColumn("ok", F.col("custom_id") % 40 != 3).unionByName(q.filter("custom_id % 90 = 5").withColumn("ok", F.lit(True)))
    return MT.batch_validation(r, q)


def t2_backoff(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") != "click").alias("failed"))
    s = RL.failure_streaks(e)
    return s.select("event_id", F.col("streak").cast("long").alias("streak"), RL.backoff_seconds(F.col("streak")).cast("long").alias("wait"))


def _circuit(spark, sf):
    e = B.table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "auth").when(F.col("event_id") % 4 == 1, "rate_limit").otherwise("transient")
    return e.select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") != "click").alias("failed"), kind.alias("kind"), (F.col("event_id") % 400).alias("retry_after"))


def t3_circuit(spark, sf):
    return RL.circuit_state(_circuit(spark, sf), F.to_timestamp(F.lit("2024-01-31 00:00:00")))


def t4_minute_budget(spark, sf):
    e = B.table(spark, sf, "events").select((F.col("user_id") % 5).alias("key"), "ts", (F.col("event_id") % 90).alias("tokens"))
    return RL.minute_budget(e, 2, 150)


def t5_ewma(spark, sf):
    e = B.table(spark, sf, "events").filter(F.col("value").isNotNull())
    g = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("s"))
    return g.select("user_id", F.round(RL.ewma(F.col("s"), RL.SHORT), 6).alias("short"), F.round(RL.ewma(F.col("s"), RL.LONG), 6).alias("long"))


def t5_governor(spark, sf):
    e = B.table(spark, sf, "events")
    out = F.when(F.col("event_type") == "error", "rate_limited").when(F.col("event_id") % 97 == 0, "overload").otherwise("success")
    return RL.governor_trace(e.select((F.col("user_id") % 50).alias("key"), "ts", "event_id", out.alias("outcome"), (F.col("event_id") % 3000).alias("tokens"), F.coalesce("value", F.lit(0.0)).alias("latency")))


def _tasks(events):
    return events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("completed").alias("state"), F.when(F.col("event_id") % 5 == 0, "shutdown").otherwise("").alias("error"), F.col("ts").alias("submitted_at"), F.lit(None).cast("timestamp").alias("completed_at"))


def t8_prunable(spark, sf):
    return MT.prunable_tasks(_tasks(B.table(spark, sf, "events")), 300, "2024-01-05 00:00:00")


# --- evaluation ------------------------------------------------------------------------------


def _run(spark, sf, salt: int = 7):
    """A run over the judged documents: each source is a query, its documents ordered by a hash."""
    d = B.table(spark, sf, "documents").select(F.col("source").alias("qid"), "doc_id")
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("qid").orderBy((F.col("doc_id") * salt) % 101, "doc_id"))
    return d.withColumn("rank", r).filter("rank <= 30")


def _judged(spark, sf):
    lab = B.table(spark, sf, "labels")
    d = B.table(spark, sf, "documents").select("doc_id", "source")
    return lab.join(d, "doc_id").select(F.col("source").alias("qid"), "doc_id", ((F.col("quality") == 0).cast("int") * 2 + F.col("toxic")).alias("rel"))


def _topics(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("source").alias("qid")).distinct().withColumn("grp", F.when(F.length("qid") == 4, "short").otherwise(""))


def e1_e7_per_query(spark, sf):
    return EV.per_query(_topics(spark, sf), _run(spark, sf), _judged(spark, sf))


def e8_grouped(spark, sf):
    return EV.evaluate(_topics(spark, sf), _run(spark, sf), _judged(spark, sf), (("recall", 5), ("mrr", 10), ("ndcg", 10)))


def e9_bootstrap(spark, sf):
    m = (("ndcg", 10),)
    a = EV.per_query(_topics(spark, sf), _run(spark, sf, 7), _judged(spark, sf), m, None)
    b = EV.per_query(_topics(spark, sf), _run(spark, sf, 13), _judged(spark, sf), m, None)
    return EV.paired_bootstrap(a, b, 500)


def e10_first_hit(spark, sf):
    return EV.first_hit_rank(_topics(spark, sf), _run(spark, sf), _judged(spark, sf))


def e11_unscored(spark, sf):
    return EV.unscored(_run(spark, sf), _run(spark, sf).filter("qid < 'src2'"))


def e12_sweep(spark, sf):
    from .retrieval_queries import _routes

    s = FU.sweep(_routes(spark, sf), [FU.Fusion(), FU.EQUAL, FU.Fusion(20, 0.5, 0.5)])
    return s.filter("rank <= 10").select("setting", "qid", "id", F.round("score", 9).alias("score"), "rank")


def j7_w2_documents(spark, sf):
    """Chunk hits of every source in path order, first occurrence per document, ten per query."""
    from pyspark.sql import Window

    c = B.chunks(spark, sf).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("qid"), "path", "id", "start")
    hits = c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("start"), "path")))
    docs = B.files(spark, sf).filter("doc_id % 2 = 0").select("path", F.col("doc_id").cast("string").alias("doc_id"))
    return EV.first_per_document(hits, docs, 10)


def j8_contained_qrels(spark, sf):
    return B.qrels(spark, sf)


QUERIES = {f.__name__: f for f in (j1_i15_diff, j2_reused_chunks, j3_w4_live_rows, j4_vector_priority, j5_pending_keys, j12_i10_unreferenced, u2_tombstones, a1_live_counts, a2_garbage, a3_covered, i1_build_modes, s13_stat_cache, a10_embed_plan, a11_import, a12_outcomes, a13_rate, a14_first_seen, i5_zero_chunk_files, i18_best_profile, i19_journal, i21_batch, t2_backoff, t3_circuit, t4_minute_budget, t5_ewma, t5_governor, t8_prunable, e1_e7_per_query, e8_grouped, e9_bootstrap, e10_first_hit, e11_unscored, e12_sweep, j7_w2_documents, j8_contained_qrels)}

_NEW = "cur AS (SELECT DISTINCT ON (path) * FROM snaps ORDER BY path, seg_ord DESC), prev AS (SELECT DISTINCT ON (path) * FROM snaps WHERE event_id % 2 = 0 ORDER BY path, seg_ord DESC)"
_S = f"WITH {B.SNAPSHOTS}, {_NEW}"
_K = "k AS (SELECT vec_id AS id, sha256(vec_id::VARCHAR) AS embed_key, embedding AS v, label FROM embeddings)"
_STREAK = "i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS g FROM e), s AS (SELECT *, sum(failed::INT) OVER (PARTITION BY key, g ORDER BY ts, event_id) AS streak FROM i)"
_EVAL = """q AS (SELECT DISTINCT source AS qid, CASE WHEN length(source) = 4 THEN 'short' ELSE 'all' END AS grp FROM documents),
j AS (SELECT source AS qid, doc_id, CASE WHEN quality = 0 THEN 2 ELSE 0 END + toxic AS rel FROM labels JOIN documents USING (doc_id)),
r AS (SELECT * FROM (SELECT source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * {salt}) % 101, doc_id) AS rank FROM documents) WHERE rank <= 30),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS i FROM j WHERE rel > 0),
h AS (SELECT r.qid, r.rank, coalesce(rel, 0) AS rel, sum((coalesce(rel, 0) > 0)::INT) OVER (PARTITION BY r.qid ORDER BY rank) AS cum FROM r LEFT JOIN j ON r.qid = j.qid AND r.doc_id = j.doc_id)""".replace("{salt}", "7")


def _metric(m: str, k: int, rounded: bool = True) -> str:
    hits = f"(SELECT count(*) FROM h WHERE h.qid = q.qid AND rank <= {k} AND rel > 0)"
    npos = "(SELECT count(*) FROM p WHERE p.qid = q.qid)"
    v = {
        "recall": f"CASE WHEN {hits} > 0 THEN 1.0 ELSE 0.0 END",
        "mrr": f"coalesce(1.0::DOUBLE / (SELECT min(rank) FROM h WHERE h.qid = q.qid AND rank <= {k} AND rel > 0), 0)",
        "set_recall": f"{hits}::DOUBLE / {npos}",
        "all_hit": f"CASE WHEN {hits} = {npos} THEN 1.0 ELSE 0.0 END",
        "ap": f"coalesce((SELECT sum(cum::DOUBLE / rank) FROM h WHERE h.qid = q.qid AND rank <= {k} AND rel > 0), 0) / {npos}",
        "ndcg": f"coalesce((SELECT sum((2.0::DOUBLE ** rel - 1) / log2(rank + 1)) FROM h WHERE h.qid = q.qid AND rank <= {k} AND rel > 0), 0) / (SELECT sum((2.0::DOUBLE ** rel - 1) / log2(i + 1)) FROM p WHERE p.qid = q.qid AND i <= {k})",
    }[m]
    return f"SELECT qid, grp, '{m}' AS metric, {k} AS k, {f"round(({v})::DOUBLE, 9)" if rounded else f"({v})::DOUBLE"} AS value FROM q WHERE qid IN (SELECT qid FROM p)"


_ALL = " UNION ALL ".join(_metric(m, k) for m, k in EV.STANDARD)
_THREE = " UNION ALL ".join(_metric(m, k, False) for m, k in (("recall", 5), ("mrr", 10), ("ndcg", 10)))

ORACLES = {
    "j1_i15_diff": f"{_S} SELECT path, CASE WHEN p.blob IS NULL THEN 'added' WHEN c.blob IS NULL THEN 'removed' WHEN c.blob <> p.blob THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT * FROM cur WHERE NOT deleted) c FULL JOIN (SELECT * FROM prev WHERE NOT deleted) p USING (path)",
    "j2_reused_chunks": f"{_S} SELECT p.path, p.size FROM prev p JOIN cur c ON p.path = c.path AND p.blob = c.blob AND NOT c.deleted",
    "j3_w4_live_rows": f"{_S} SELECT path, seg_ord, size FROM cur WHERE NOT deleted",
    "j4_vector_priority": f"WITH {_K} SELECT embed_key, (CASE WHEN id % 5 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 ELSE 2 END)::INT AS priority, round(v[1]::DOUBLE, 6) AS first FROM k WHERE id % 5 = 0 OR id % 3 = 0 OR id % 2 = 0",
    "j5_pending_keys": f"WITH {_K} SELECT embed_key FROM k WHERE id % 3 <> 0 AND id % 7 <> 0",
    "j12_i10_unreferenced": "SELECT 'seg' || event_id AS id FROM events WHERE event_id NOT IN (SELECT user_id FROM events) AND event_id NOT IN (SELECT (event_id * 7) // 10 FROM events)",
    "u2_tombstones": f"{_S}, rej AS (SELECT path FROM cur WHERE NOT deleted AND size % 10 = 0) (SELECT path FROM prev WHERE deleted AND path NOT IN (SELECT path FROM cur WHERE NOT deleted AND path NOT IN (SELECT path FROM rej))) UNION SELECT path FROM cur WHERE deleted UNION SELECT path FROM rej",
    "a1_live_counts": f"{_S} SELECT count(*) AS files, sum(size % 9)::BIGINT AS chunks, sum(size)::BIGINT AS bytes, sum(size % 4)::BIGINT AS vectors FROM cur WHERE NOT deleted",
    "a2_garbage": f"{_S}, c AS (SELECT (SELECT count(*) FROM snaps) AS total, (SELECT count(*) FROM cur WHERE NOT deleted) AS live) SELECT total, live, round((total - live)::DOUBLE / total, 9) AS garbage FROM c",
    "a3_covered": f"WITH {_K} SELECT 'p' || label AS path, count(*) AS chunk_count, count(*) FILTER (id % 4 = 1) AS covered_chunks FROM k GROUP BY 1",
    "i1_build_modes": "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'full:first-build' WHEN event_id % 11 = 0 THEN 'full:lexical-selfheal' WHEN event_id % 10 = 0 THEN 'full:vector-repair' WHEN event_id % 7 = 0 THEN 'full:schema-upgrade' WHEN event_id % 3 = 0 THEN 'noop' WHEN event_id % 12 >= 8 THEN 'full:compaction-segments' WHEN (event_id % 17) / 17.0 >= 0.5 THEN 'full:compaction-garbage' ELSE 'delta' END AS mode FROM events",
    "s13_stat_cache": f"{_S} SELECT c.path, coalesce(c.size = p.size AND c.mtime = p.mtime, false) AS reused, CASE WHEN coalesce(c.size = p.size AND c.mtime = p.mtime, false) THEN p.blob ELSE c.blob END AS blob FROM cur c LEFT JOIN prev p USING (path)",
    "a10_embed_plan": f"WITH {_K} SELECT (count(*) + count(*) FILTER (id % 6 = 0))::BIGINT AS total, count(*) AS unique_keys, count(*) FILTER (id % 3 = 0) AS reusable, count(*) FILTER (id % 3 <> 0 AND id % 4 = 0) AS rejected, count(*) FILTER (id % 3 <> 0 AND id % 4 <> 0) AS pending FROM k",
    "a11_import": f"""WITH {_K}, x AS (SELECT id AS n, id, embed_key FROM k UNION ALL SELECT id + 100000, id, embed_key FROM k WHERE id % 5 = 0)
SELECT n, embed_key, CASE WHEN id % 10 = 3 THEN 'unknown_key' WHEN id % 7 = 0 THEN 'existing' WHEN n >= 100000 THEN CASE WHEN id % 9 <> 0 AND id % 8 <> 0 THEN 'existing' ELSE 'appended' END WHEN id % 9 = 0 THEN 'wrong_dim' WHEN id % 8 = 0 THEN 'bad_vector' ELSE 'appended' END AS outcome FROM x""",
    "a12_outcomes": "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error' AND event_id % 5 = 0) AS degraded, CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' WHEN count(*) FILTER (event_type <> 'error' AND event_id % 5 = 0) > 0 THEN 'degraded' ELSE 'ok' END AS outcome FROM events",
    "a13_rate": "SELECT event_id, (CASE WHEN d > 0 AND s > 0 THEN greatest(floor(d::DOUBLE / s * 60), 1) ELSE 0 END)::BIGINT AS rate_per_min, (CASE WHEN d > 0 AND s > 0 AND p > 0 THEN floor(p / (d::DOUBLE / s) + 0.5) ELSE 0 END)::BIGINT AS eta_s FROM (SELECT event_id, event_id % 50 AS d, event_id % 70 AS p, event_id % 30 AS s FROM events)",
    "a14_first_seen": "SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id",
    "i5_zero_chunk_files": f"WITH {B.FILES} SELECT path FROM files WHERE doc_id % 10 = 0 OR NOT regexp_matches(content, '\\S')",
    "i18_best_profile": "SELECT user_id AS identity, max_by(event_type, struct_pack(c := c, t := event_type)) AS profile, max(c) AS vector_count FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY user_id",
    "i19_journal": "SELECT event_id AS ord, user_id::VARCHAR AS embed_key, event_id % 100 + 1 AS bytes FROM events QUALIFY count(*) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) <= 700 AND sum(event_id % 100 + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) <= 20000",
    "i21_batch": "SELECT count(*) AS n_requests, count(*) FILTER ((doc_id % 50 <> 1 AND doc_id % 40 <> 3) OR doc_id % 90 = 5) AS n_ok, count(*) FILTER (doc_id % 50 <> 1 AND doc_id % 90 = 5) AS n_repeated, 0::BIGINT AS n_unknown, count(*) FILTER (doc_id % 50 = 1 AND doc_id % 90 <> 5) AS n_missing, false AS complete FROM documents",
    "t2_backoff": f"WITH e AS (SELECT user_id AS key, ts, event_id, event_type <> 'click' AS failed FROM events), {_STREAK} SELECT event_id, streak::BIGINT AS streak, (CASE WHEN streak <= 0 THEN 0 ELSE least(120, 5 * 2.0 ** least(streak - 1, 30)) END)::BIGINT AS wait FROM s",
    "t3_circuit": f"""WITH e AS (SELECT user_id AS key, ts, event_id, event_type <> 'click' AS failed, CASE event_id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'rate_limit' ELSE 'transient' END AS kind, event_id % 400 AS ra FROM events), {_STREAK},
l AS (SELECT DISTINCT ON (key) * FROM s ORDER BY key, ts DESC, event_id DESC), w AS (SELECT *, (CASE WHEN streak = 0 THEN 0 WHEN kind = 'auth' THEN 900 WHEN kind = 'rate_limit' THEN least(CASE WHEN ra > 0 THEN ra ELSE 30 END, 300) ELSE least(300, 30 * 2.0 ** least(streak - 1, 4)) END)::BIGINT AS wait_s FROM l)
SELECT key, streak::BIGINT AS failures, wait_s, CASE WHEN streak = 0 THEN 'healthy' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') < floor(epoch(ts)) + wait_s THEN 'backoff' ELSE 'candidate' END AS state FROM w""",
    "t4_minute_budget": "SELECT user_id % 5 AS key, date_trunc('minute', ts) AS minute, count(*) AS requests, sum(event_id % 90)::BIGINT AS tokens, count(*) > 1 AND (count(*) > 2 OR sum(event_id % 90) > 150) AS over FROM events GROUP BY 1, 2",
    "t5_ewma": "WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS s FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, round(list_reduce(s, lambda a, x: a + 0.2::DOUBLE * (x - a)), 6) AS short, round(list_reduce(s, lambda a, x: a + 0.02::DOUBLE * (x - a)), 6) AS long FROM s",
    "t8_prunable": "WITH p AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS r FROM events WHERE event_id % 3 <> 0 AND (event_id % 5 <> 0 OR ts < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 7 DAYS)) SELECT id FROM p WHERE r <= (SELECT count(*) - 300 FROM events)",
    "e1_e7_per_query": f"WITH {_EVAL} {_ALL}",
    "e8_grouped": f"""WITH {_EVAL}, m AS ({_THREE}), n AS (SELECT grp, count(*) FILTER (qid IN (SELECT qid FROM p)) AS n_queries, count(*) FILTER (qid NOT IN (SELECT qid FROM p)) AS n_skipped FROM q GROUP BY grp),
a AS (SELECT * FROM n UNION ALL SELECT 'overall', sum(n_queries), sum(n_skipped) FROM n HAVING count(*) > 1), names(metric, k) AS (VALUES ('recall', 5), ('mrr', 10), ('ndcg', 10)),
v AS (SELECT grp, metric, k, sum(value) AS s FROM m GROUP BY ALL UNION ALL SELECT 'overall', metric, k, sum(value) FROM m GROUP BY ALL)
SELECT a.grp, names.metric, names.k, round(CASE WHEN n_queries > 0 THEN coalesce(s, 0) / n_queries ELSE 0 END, 9) AS value, n_queries::BIGINT AS n_queries, n_skipped::BIGINT AS n_skipped FROM a CROSS JOIN names LEFT JOIN v ON a.grp = v.grp AND names.metric = v.metric AND names.k = v.k""",
    "e10_first_hit": f"WITH {_EVAL} SELECT qid, coalesce((SELECT min(rank) FROM h WHERE h.qid = q.qid AND rel > 0), 0)::INT AS first_hit FROM q",
    "e11_unscored": f"WITH {_EVAL} SELECT qid, doc_id, rank::INT AS rank FROM r WHERE qid >= 'src2'",
    "e12_sweep": """WITH r AS (SELECT item_id AS qid, 'lexical' AS route, i AS rank, (item_id * 31 + i * 7) % 97 AS id FROM benchmark, range(1, 61) t(i) UNION ALL SELECT item_id, 'dense', i, (item_id * 17 + i * 11) % 89 FROM benchmark, range(1, 61) t(i)),
m AS (SELECT qid, id, min(rank) FILTER (route = 'lexical') AS l, min(rank) FILTER (route = 'dense') AS d FROM r GROUP BY qid, id), s(setting, k, a, b) AS (VALUES (0, 20, 0.15, 0.85), (1, 60, 1, 1), (2, 20, 0.5, 0.5)),
f AS (SELECT setting, qid, id, round(coalesce(a::DOUBLE / (k + l), 0) + coalesce(b::DOUBLE / (k + d), 0), 12) AS score FROM m, s)
SELECT setting, qid, id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY setting, qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "j7_w2_documents": f"""WITH {B.CHUNKS}, c AS (SELECT split_part(path, '/', 2) AS qid, path, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY "start" DESC, path) AS rank FROM chunks),
d AS (SELECT c.qid, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE c.path END AS doc_id, min(rank) AS r FROM c JOIN files USING (path) GROUP BY ALL)
SELECT qid, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, doc_id) AS rank FROM d) WHERE rank <= 10""",
    "j8_contained_qrels": f"WITH {B.QRELS} SELECT qid, doc_id, rel FROM qrels",
}
