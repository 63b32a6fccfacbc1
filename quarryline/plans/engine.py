"""The engine: workspaces indexed as immutable revisions of Parquet segments, and searched by two routes."""

from __future__ import annotations

import os
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, text
from ..operators import blocks as BL
from ..operators import dense as DN
from ..operators import fusion as FU
from ..operators import lexical as LX
from ..operators import maintenance as MT
from ..operators import providers as PR
from ..operators import splitters as SP
from ..sources import scan as SC
from ..sources import store as ST
from ..sources import tables as TB
from . import render as RN

CHUNK_COLUMNS = "path string, language string, capability string, start int, end int, symbol string, content string, content_hash string, id string, embed_key string, blob string"
MAX_WORKSPACES, MAX_BUDGET, LEXICAL_K, HYBRID_K, HEAD = 8, 1_000_000, 20, 60, 50


@dataclass
class Options:
    data_dir: str
    embedder: PR.Embedder | None = None
    reranker: PR.Reranker | None = None
    weights: LX.Weights = field(default_factory=LX.Weights)
    fusion: FU.Fusion = field(default_factory=FU.Fusion)
    fresh_seconds: float = 30.0
    max_vectors: int = 400_000
    strict: bool = False
    deny_degraded: bool = False
    fragment_gate: bool = False
    include_file: str = ".includeignore"

    def __post_init__(self):
        if self.fresh_seconds < 0:
            raise ValueError("fresh_seconds must not be negative")
        if self.max_vectors < 1:
            raise ValueError("max_vectors must be positive")

    def fingerprint(self) -> str:
        return ids.fingerprint({"profile": ids.PROFILE, "template": ids.TEMPLATE, "dim": self.embedder.dim if self.embedder else 0, "include": self.include_file})


@dataclass
class SyncResult:
    revision: str
    mode: str
    files: int
    added_chunks: int
    deleted: int
    coverage: str = ""

    def summary(self) -> str:
        return f"revision={self.revision} files={self.files} added_chunks={self.added_chunks} deleted={self.deleted} build={self.mode}" + (f" semantic_coverage={self.coverage}" if self.coverage else "")


class Workspace:
    def __init__(self, root: str, store: ST.Store):
        self.root, self.store = root, store
        self.mutex = threading.Lock()
        self.synced_at = 0.0
        self.repair = False
        self.cache: dict[str, tuple] = {}


class Engine:
    """Sync and search of workspaces. Builds of one workspace run one at a time, in this process by a mutex and
    across processes by a lock file; readers see whole revisions only."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.options = spark, options
        self.workspaces: dict[str, Workspace] = {}

    def workspace(self, directory: str) -> Workspace:
        root = SC.resolve_root(paths.expand_user(directory))
        key = ids.workspace_key(root, "posix", "linux")
        if key not in self.workspaces:
            base = os.path.join(self.options.data_dir, key, self.options.fingerprint()[:12])
            self.workspaces[key] = Workspace(root, ST.Store(base))
        return self.workspaces[key]

    # --- sync ------------------------------------------------------------------------------------

    def sync(self, directory: str) -> SyncResult:
        ws = self.workspace(directory)
        arrived = time.time()
        with ws.mutex:
            # A build that began after this call arrived answers it as well.
            if ws.synced_at > arrived and ws.store.current():
                m = ws.store.usable()
                return SyncResult(m.revision, "joined", len(m.files), 0, 0)
            began = time.time()
            lock = ST.Lock(ws.store.path("LOCK"))
            if not lock.acquire():
                raise RuntimeError("another process is building this workspace")
            try:
                out = self._build(ws)
                ws.synced_at = began
                return out
            finally:
                lock.release()

    def changed(self, directory: str) -> bool:
        ws = self.workspace(directory)
        m = ws.store.usable()
        return m is None or not MT.is_noop(self._assets(ws), self._files(m))

    def _assets(self, ws: Workspace) -> DataFrame:
        return SC.scan(self.spark, ws.root)

    def _files(self, m: ST.Manifest | None) -> DataFrame:
        rows = [(p, e.content_hash) for p, e in m.files.items()] if m else []
        return self.spark.createDataFrame(rows, "path string, blob string")

    def _build(self, ws: Workspace) -> SyncResult:
        prev = ws.store.usable()
        assets = self._assets(ws).select("path", "content", "blob", "size").persist()
        try:
            state = MT.diff(assets, self._files(prev)).persist()
            changed = {r["path"]: r["state"] for r in state.filter("state <> 'unchanged'").collect()}
            mode = MT.build_mode(None if prev is None else {"schema": prev.schema_version, "segments": len(prev.segments), "garbage": prev.garbage}, bool(changed), False, ws.repair)
            if mode == "noop" and self.options.embedder and prev.vector_count < sum(e.chunk_count for e in prev.files.values()):
                mode = "full:semantic-fill"
            if mode == "noop":
                return SyncResult(prev.revision, mode, len(prev.files), 0, 0, self._coverage(prev))
            ws.repair = False
            delta = mode == "delta"
            todo = assets.join(state.filter("state IN ('added', 'changed')").select("path"), "path", "left_semi") if delta else assets
            fresh = SP.split(todo).join(todo.select("path", "blob"), "path")
            chunks = fresh.withColumn("embed_key", ids.embed_key(F.col("path"), F.col("symbol"), F.col("language"), F.col("content_hash")))
            if not delta and prev is not None:
                old = self._chunks(ws, prev)
                kept = MT.reuse_chunks(assets, old)
                done = kept.select("path").distinct()
                todo = assets.join(done, "path", "left_anti")
                fresh = SP.split(todo).join(todo.select("path", "blob"), "path")
                chunks = fresh.withColumn("embed_key", ids.embed_key(F.col("path"), F.col("symbol"), F.col("language"), F.col("content_hash"))).unionByName(kept.select(*fresh.columns, "embed_key"))
            sid, stage = ws.store.stage()
            chunks.write.parquet(os.path.join(stage, "chunks"))
            mine = self.spark.read.parquet(os.path.join(stage, "chunks"))
            TB.write_postings(LX.postings(mine, fields=LX.FIELDS), os.path.join(stage, "postings"))
            covered = self._embed(ws, prev, mine, os.path.join(stage, "vectors"))
            seg = ws.store.add_segment(sid)
            mine = self.spark.read.parquet(ws.store.path("segments", sid, "chunks"))
            per_file = mine.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("b"), F.max("blob").alias("blob"), F.collect_set("embed_key").alias("keys")).collect()
            files = dict(prev.files) if delta else {}
            for p, s in changed.items():
                if s in ("removed", "changed"):
                    files.pop(p, None)
            n = 0
            for r in per_file:
                files[r["path"]] = ST.FileEntry(r["blob"], r["n"], sid, r["b"], len([k for k in r["keys"] if k in covered]))
                n += r["n"]
            seg.chunks, seg.vectors = n, len(covered)
            empty = {p for p, s in changed.items() if s in ("added", "changed") and p not in files}
            gone = {p for p, s in changed.items() if s == "removed"} | empty
            tombs = sorted((set(prev.tombstones if delta else []) | gone) - set(files)) if delta else []
            segments = ([*prev.segments, seg] if n or not prev.segments else prev.segments) if delta else [seg]
            m = ST.Manifest(uuid.uuid4().hex[:16], prev.revision if prev else None, ST.SCHEMA, files, segments, tombs, sum(e.covered_chunks for e in files.values()))
            ws.store.publish(m)
            ws.store.collect()
            ws.cache.clear()
            return SyncResult(m.revision, mode, len(files), sum(e.chunk_count for p, e in files.items() if e.segment_id == sid and (not delta or p in changed)), len(gone), self._coverage(m))
        finally:
            assets.unpersist()

    def _coverage(self, m: ST.Manifest) -> str:
        n = sum(e.chunk_count for e in m.files.values())
        return (f"{m.vector_count * 100 // n}%" if n else "100%") if self.options.embedder else ""

    def _embed(self, ws: Workspace, prev: ST.Manifest | None, chunks: DataFrame, out: str) -> set[str]:
        """Vectors of the chunks' keys: those of earlier segments and the journal are used again, the rest comes
        from the provider and goes to the journal first."""
        if self.options.embedder is None:
            return set()
        dim = self.options.embedder.dim
        journal = ST.Journal(self.spark, ws.store.path("journal"), dim)
        sources = [self.spark.read.parquet(p) for s in reversed(prev.segments if prev else []) if os.path.isdir(p := ws.store.path("segments", s.id, "vectors"))]
        have = MT.vectors_by_priority([*sources, journal.entries()])
        keys = chunks.select("embed_key").distinct()
        reused = have.join(keys, "embed_key", "left_semi").select("embed_key", "v")
        pending = MT.pending_keys(chunks, have, journal.rejected())
        job = chunks.select("embed_key", text.embed_text(F.col("path"), F.col("language"), F.col("symbol"), F.col("content")).alias("text"))
        made = PR.embed(job.join(pending, "embed_key", "left_semi"), self.options.embedder).persist()
        try:
            journal.append(made.filter("NOT rejected").select("embed_key", "v"))
            if made.filter("rejected").limit(1).count():
                journal.reject(made.filter("rejected"))
            TB.write_vectors(reused.unionByName(made.filter("NOT rejected").select("embed_key", "v")), out, dim)
        finally:
            made.unpersist()
        stored = TB.read_vectors(self.spark, out, dim)
        journal.compact(stored)
        return {r["embed_key"] for r in stored.select("embed_key").collect()}

    # --- reading ---------------------------------------------------------------------------------

    def _chunks(self, ws: Workspace, m: ST.Manifest) -> DataFrame:
        """Live chunks: of every file those of the segment its manifest entry names."""
        out = None
        for s in m.segments:
            d = self.spark.read.parquet(ws.store.path("segments", s.id, "chunks")).withColumn("segment_id", F.lit(s.id))
            out = d if out is None else out.unionByName(d)
        if out is None:
            return self.spark.createDataFrame([], CHUNK_COLUMNS)
        live = self.spark.createDataFrame([(p, e.segment_id) for p, e in m.files.items()], "path string, segment_id string")
        return out.join(live, ["path", "segment_id"], "left_semi").drop("segment_id")

    def _ready(self, ws: Workspace, m: ST.Manifest) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chunks, postings, field statistics) of a revision, kept in memory until the next."""
        if m.revision not in ws.cache:
            chunks = self._chunks(ws, m).persist()
            live = chunks.select("id").distinct()
            posted = TB.read_postings(self.spark, [ws.store.path("segments", s.id, "postings") for s in m.segments]).dropDuplicates(["field", "term", "id"]).join(live, "id", "left_semi").persist()
            ws.cache[m.revision] = (chunks, posted, LX.field_stats(chunks, LX.FIELDS).persist())
        return ws.cache[m.revision]

    def _revision(self, ws: Workspace, directory: str) -> ST.Manifest:
        if time.time() - ws.synced_at > self.options.fresh_seconds or not ws.store.current():
            self.sync(directory)
        m = ws.store.usable()
        if m is None:
            raise RuntimeError("no usable revision")
        return m

    def candidates(self, directory: str, queries: DataFrame, prefix: str = "", few: bool = False) -> tuple[DataFrame, str, str]:
        """(fused candidates (qid, id, score, rank), mode, reason of degradation) of a table (qid, query). few: the
        table is a question at hand, whose hits may pass through the driver."""
        ws = self.workspace(directory)
        m = self._revision(ws, directory)
        chunks, posted, stats = self._ready(ws, m)
        prefix = text.normalize_prefix(prefix)
        hybrid = self.options.embedder is not None
        lex = LX.lexical_route(queries, chunks, HYBRID_K if hybrid else LEXICAL_K, self.options.weights, prefix, few, posted=posted, stats=stats)
        if not hybrid:
            return FU.by_position(lex.select("qid", "id", "rank")), "lexical", ""
        dense, reason = self._dense(ws, m, queries, chunks, prefix)
        if dense is None:
            if self.options.deny_degraded:
                raise RuntimeError(reason)
            return FU.by_position(lex.select("qid", "id", "rank")), "lexical", reason
        if few:
            dense = LX.here(dense)
        hits = lex.select("qid", F.lit("lexical").alias("route"), "rank", "id").unionByName(dense.select("qid", F.lit("dense").alias("route"), "rank", "id"))
        fused = FU.rrf(hits, self.options.fusion).select("qid", "id", "rank")
        fused = FU.anchor(LX.here(fused) if few else fused, lex.filter("rank = 1").select("qid", "id"), HEAD)
        return FU.by_position(fused), "hybrid", reason

    def _dense(self, ws: Workspace, m: ST.Manifest, queries: DataFrame, chunks: DataFrame, prefix: str) -> tuple[DataFrame | None, str]:
        paths_ = [p for s in m.segments if os.path.isdir(p := ws.store.path("segments", s.id, "vectors"))]
        if not paths_:
            return None, "dense-skipped(no-vectors)"
        try:
            v = TB.read_vectors(self.spark, paths_[0], self.options.embedder.dim)
            for p in paths_[1:]:
                v = v.unionByName(TB.read_vectors(self.spark, p, self.options.embedder.dim))
            v = v.dropDuplicates(["embed_key"])
            if not DN.within_envelope(v, self.options.max_vectors):
                return None, "dense-skipped(envelope)"
            rows = queries.select("qid", "query").collect()  # the question at hand, not a corpus
            qv = PR.embed_batch(self.options.embedder, [r["query"] for r in rows])
        except Exception as e:
            ws.repair = "dimension" in str(e)
            return None, f"dense-skipped({type(e).__name__})"
        kind = dict(queries.dtypes)["qid"]
        q = self.spark.createDataFrame([(r["qid"], [float(x) for x in x_]) for r, x_ in zip(rows, qv)], f"qid {kind}, qv array<float>")
        own = chunks.filter(text.in_subtree(F.col("path"), prefix)) if prefix else chunks
        return DN.search(q, own.select("id", "embed_key").join(v, "embed_key").select("id", "v"), HYBRID_K), ""

    def search(self, directory: str, query: str, prefix: str = "", budget: int = 0, detail: str = "full", numbered: bool = False) -> dict:
        """Text and inventory of one question's answer."""
        if not query.strip():
            raise ValueError("empty query")
        if not 0 <= budget <= MAX_BUDGET:
            raise ValueError(f"budget must be from 0 to {MAX_BUDGET}")
        RN.parse_detail(detail)
        t0 = time.time()
        ws = self.workspace(directory)
        q = self.spark.createDataFrame([("q", query)], "qid string, query string")
        found, mode, reason = self.candidates(directory, q, prefix, few=True)
        m = ws.store.usable()
        chunks, _, _ = self._ready(ws, m)
        hits = LX.here(found).join(chunks, "id").orderBy("rank").collect()  # at most 2 * HYBRID_K rows
        sent, reranked = 0, False
        if self.options.reranker and hits:
            hits, sent, reranked, why = self._rerank(query, hits)
            reason = reason or why
        if self.options.fragment_gate:
            bad = {r["id"] for r in self.spark.createDataFrame([(h["id"], h["content"], h["capability"]) for h in hits], "id string, content string, capability string").filter(text.is_fragment_noise(F.col("content"), F.col("capability"))).collect()} if hits else set()
            hits = [h for h in hits if h["id"] not in bad]
        RN.check_strict(self.options.strict, reason, reranked, self.options.reranker is not None, len(hits))
        rows = [("q", h["path"], h["start"], h["end"], h["symbol"], 1.0 / (i + 1), h["content"], h["language"]) for i, h in enumerate(hits)]
        table = self.spark.createDataFrame(rows, "qid string, path string, start int, end int, symbol string, score double, content string, language string")
        merged = BL.ranked_blocks(BL.merge_blocks(table)).orderBy("rank").collect() if rows else []
        blocks = [RN.Block(r["path"], r["start"], r["end"], r["content"], r["symbol"], SP.language_of(r["path"]), r["score"]) for r in merged]
        out = RN.render(blocks, budget, detail, numbered)
        return {"text": RN.degraded_banner(reason) + out.text, "revision": m.revision, "mode": mode + ("+rerank" if reranked else ""), "degraded_reason": reason, "coverage": self._coverage(m), "rerank_sent": sent, "hits": out.hits, "display": {"candidate_blocks": out.candidate_blocks, "shown_blocks": out.shown_blocks, "shown_files": out.shown_files, "truncated": out.truncated}, "total_ms": int(1000 * (time.time() - t0))}

    def _rerank(self, query: str, hits: list) -> tuple[list, int, bool, str]:
        head, tail = hits[:HEAD], hits[HEAD:]
        used, sent = 0, 0
        texts = [f"{h['path']}:{h['start']}-{h['end']}" + (f" {h['symbol']}" if h["symbol"] else "") + f"\n{h['content']}" for h in head]
        for t in texts:
            used += len(query.encode()) // 4 + 1 + len(t.encode()) // 4 + 1
            if used > 200_000:
                break
            sent += 1
        try:
            scores = self.options.reranker.scores(query, texts[:sent])
            if len(scores) != sent:
                raise ValueError("a rerank answer has one score per document")
        except Exception as e:
            if self.options.deny_degraded:
                raise
            return hits, 0, False, f"rerank-skipped({type(e).__name__})"
        order = sorted(range(sent), key=lambda i: (-scores[i], i))
        return [head[i] for i in order] + head[sent:] + tail, sent, True, ""

    def search_many(self, directories: list[str], query: str, **how) -> dict:
        """One question to up to MAX_WORKSPACES workspaces, with what became of each."""
        if not 0 < len(directories) <= MAX_WORKSPACES:
            raise ValueError(f"1 to {MAX_WORKSPACES} workspaces")
        results, failed = {}, {}
        for d in directories:
            try:
                results[d] = self.search(d, query, **how)
            except Exception as e:
                failed[d] = str(e)
        degraded = [d for d, r in results.items() if r["degraded_reason"]]
        outcome = "failed" if not results else "partial" if failed else "degraded" if degraded else "ok"
        return {"outcome": outcome, "results": results, "failed": failed, "degraded": degraded}

    def repo_map(self, directory: str, budget: int = 4000, focus: str = "") -> str:
        """Files by directory with their symbols, best first, within a byte budget."""
        ws = self.workspace(directory)
        m = self._revision(ws, directory)
        chunks, _, _ = self._ready(ws, m)
        files = BL.map_files(chunks, text.normalize_prefix(focus)).withColumn("line", BL.map_line(BL.map_files(chunks)))
        total = files.count()
        title = f"# repo map: {m.revision} ({total} files" + (f", focus={focus}" if focus else "") + ")\n"
        chosen = BL.select_map(files, budget, len(title.encode()))
        rows = chosen.join(files.select("path", "line", "n_symbols"), "path").orderBy("used").collect()
        heads = {r["top_dir"]: (r["n"], r["s"]) for r in files.groupBy("top_dir").agg(F.count(F.lit(1)).alias("n"), F.sum("n_symbols").alias("s")).collect()}
        out, dirs = title, list(dict.fromkeys(r["top_dir"] for r in rows))
        for d in dirs:
            out += f"{d}/ ({heads[d][0]} files, {heads[d][1]} symbols)\n" + "".join(r["line"] + "\n" for r in rows if r["top_dir"] == d)
        if len(rows) < total:
            out += f"[map truncated: {len(rows)} of {total} files shown; raise the budget or set a focus]\n"
        return out.rstrip("\n")

    def embed_plan(self, directory: str) -> dict:
        """What a sync would still have to embed."""
        ws = self.workspace(directory)
        m = self._revision(ws, directory)
        chunks, _, _ = self._ready(ws, m)
        dim = self.options.embedder.dim if self.options.embedder else 0
        journal = ST.Journal(self.spark, ws.store.path("journal"), dim)
        have = journal.entries().select("embed_key")
        for s in m.segments:
            if os.path.isdir(p := ws.store.path("segments", s.id, "vectors")):
                have = have.union(self.spark.read.parquet(p).select("embed_key"))
        return MT.embed_plan(chunks, have, journal.rejected()).first().asDict()

    def export_jobs(self, directory: str, path: str) -> None:
        """Pending embedding jobs as JSON lines (embed_key, text)."""
        ws = self.workspace(directory)
        m = self._revision(ws, directory)
        chunks, _, _ = self._ready(ws, m)
        journal = ST.Journal(self.spark, ws.store.path("journal"), 0)
        pending = MT.pending_keys(chunks, journal.entries(), journal.rejected())
        jobs = chunks.select("embed_key", text.embed_text(F.col("path"), F.col("language"), F.col("symbol"), F.col("content")).alias("text")).dropDuplicates(["embed_key"])
        TB.write_json(jobs.join(pending, "embed_key", "left_semi"), path)

    def import_vectors(self, directory: str, rows: DataFrame, dim: int) -> dict:
        """Take rows (n, embed_key, v) into the journal and say what became of them."""
        ws = self.workspace(directory)
        m = self._revision(ws, directory)
        chunks, _, _ = self._ready(ws, m)
        journal = ST.Journal(self.spark, ws.store.path("journal"), dim)
        out = MT.import_outcomes(rows, chunks.select("embed_key"), journal.entries(), dim)
        from ..functions import vectors as V

        good = rows.join(out.filter("outcome = 'appended'").select("n"), "n", "left_semi").select("embed_key", V.normalize(F.col("v")).alias("v"))
        counts = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
        journal.append(good)
        return counts

    def status(self, directory: str) -> dict:
        ws = self.workspace(directory)
        m = ws.store.usable()
        if m is None:
            return {"state": "not-indexed", "root": ws.root}
        tops: dict[str, int] = {}
        for p in m.files:
            d = p.split("/", 1)[0] if "/" in p else "."
            tops[d] = tops.get(d, 0) + 1
        return {"state": "ready", "root": ws.root, "revision": m.revision, "files": len(m.files), "chunks": sum(e.chunk_count for e in m.files.values()), "bytes": sum(e.bytes for e in m.files.values()), "vectors": m.vector_count, "segments": len(m.segments), "garbage": m.garbage, "tombstones": len(m.tombstones), "top_level_file_counts": tops, "coverage": self._coverage(m)}

    def close(self) -> None:
        for ws in self.workspaces.values():
            for frames in ws.cache.values():
                for d in frames:
                    d.unpersist()
            ws.cache.clear()
