"""Incremental index maintenance as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SEGMENTS, MAX_GARBAGE = 8, 0.5


def diff(current: DataFrame, previous: DataFrame, path: str = "path", blob: str = "blob") -> DataFrame:
    """(path, state): added, changed, removed or unchanged."""
    c = current.select(F.col(path).alias("path"), F.col(blob).alias("_c"))
    p = previous.select(F.col(path).alias("path"), F.col(blob).alias("_p"))
    state = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_c") != F.col("_p"), "changed").otherwise("unchanged")
    return c.join(p, "path", "full_outer").select("path", state.alias("state"))


def is_noop(current: DataFrame, previous: DataFrame, path: str = "path", blob: str = "blob") -> bool:
    return not diff(current, previous, path, blob).filter("state <> 'unchanged'").limit(1).count()


def reuse_chunks(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose file has the same path and content identity now."""
    return chunks.join(assets.select("path", "blob"), ["path", "blob"], "left_semi")


def newest(rows: DataFrame, key: str = "path", order: str = "seg_ord") -> DataFrame:
    """The rows of each key's newest segment; the newest is found by a partial aggregate, not a sort."""
    top = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(top, [key, order], "left_semi")


def live_rows(rows: DataFrame, manifest_files: DataFrame | None = None, tombstones: DataFrame | None = None, key: str = "path", order: str = "seg_ord") -> DataFrame:
    out = newest(rows, key, order)
    if manifest_files is not None:
        out = out.join(manifest_files.select(key), key, "left_semi")
    return out.join(tombstones.select(key), key, "left_anti") if tombstones is not None else out


def tombstones(previous: DataFrame, removed: DataFrame, rejected: DataFrame, existing: DataFrame) -> DataFrame:
    """(path): the previous ones whose file didn't come back or was rejected, the removed and the rejected."""
    back = existing.select("path").join(rejected.select("path"), "path", "left_anti")
    return previous.select("path").join(back, "path", "left_anti").union(removed.select("path")).union(rejected.select("path")).distinct()


def live_counts(files: DataFrame) -> DataFrame:
    z = F.lit(0)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunk_count"), z).alias("chunks"), F.coalesce(F.sum("bytes"), z).alias("bytes"), F.coalesce(F.sum("covered_chunks"), z).alias("vectors"))


def garbage_ratio(segment_chunks: DataFrame, live_chunks: DataFrame) -> DataFrame:
    """One row (total, live, garbage) of segments' (chunks) and files' (chunk_count)."""
    t = segment_chunks.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("total"))
    n = live_chunks.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("live"))
    dead = F.greatest(F.col("total") - F.col("live"), F.lit(0))
    return t.join(n, F.lit(True)).withColumn("garbage", F.when(F.col("total") == 0, 0.0).otherwise(F.round(dead / F.col("total"), 9)))


def covered_per_file(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(path, chunk_count, covered_chunks) of chunks (path, embed_key)."""
    keys = vectors.select("embed_key").distinct().withColumn("_v", F.lit(1))
    return chunks.join(keys, "embed_key", "left").groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"), F.count("_v").alias("covered_chunks"))


def build_mode(previous: dict | None, content_changed: bool, lexical_damaged: bool = False, repair: bool = False, schema: int = 2) -> str:
    """delta, noop, or full with its reason. previous: schema, segments, garbage."""
    if previous is None:
        return "full:first-build"
    if lexical_damaged:
        return "full:lexical-selfheal"
    if repair:
        return "full:vector-repair"
    if previous["schema"] != schema:
        return "full:schema-upgrade"
    if not content_changed:
        return "noop"
    if previous["segments"] >= MAX_SEGMENTS:
        return "full:compaction-segments"
    if previous["garbage"] >= MAX_GARBAGE:
        return "full:compaction-garbage"
    return "delta"


def build_mode_column(states: DataFrame) -> DataFrame:
    """build_mode() over a table of states."""
    mode = (
        F.when(F.col("previous_schema").isNull(), "full:first-build")
        .when(F.col("lexical_damaged"), "full:lexical-selfheal")
        .when(F.col("repair"), "full:vector-repair")
        .when(F.col("previous_schema") != 2, "full:schema-upgrade")
        .when(~F.col("changed"), "noop")
        .when(F.col("segments") >= MAX_SEGMENTS, "full:compaction-segments")
        .when(F.col("garbage") >= MAX_GARBAGE, "full:compaction-garbage")
        .otherwise("delta")
    )
    return states.withColumn("mode", mode)


def unreferenced(segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """Segments (id) that no kept manifest (revision, segments array) names."""
    return segments.join(manifests.select(F.explode("segments").alias("id")).distinct(), "id", "left_anti")


def stat_cached(current: DataFrame, previous: DataFrame, now: str = "now", racy_seconds: int = 2) -> DataFrame:
    """Current (path, size, mtime, blob_if_read) with `blob` and `reused`: the previous identity where size and
    time are the same and the file isn't fresher than the racy window, else the one read."""
    p = previous.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_t"), F.col("blob").alias("_b"))
    same = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_t")) & (F.unix_timestamp(F.col(now)) - F.unix_timestamp("mtime") > racy_seconds)
    j = current.join(p, "path", "left").withColumn("reused", F.coalesce(same, F.lit(False)))
    return j.withColumn("blob", F.when(F.col("reused"), F.col("_b")).otherwise(F.col("blob_if_read"))).drop("_s", "_t", "_b")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a max over a struct, so it is pre-aggregated before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def vectors_by_priority(sources: list[DataFrame]) -> DataFrame:
    """(embed_key, v, priority): each key's vector from the first of the sources that has it."""
    out = None
    for i, s in enumerate(sources):
        one = s.select("embed_key", "v", F.lit(i).alias("priority"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("embed_key").agg(F.min_by("v", "priority").alias("v"), F.min("priority").alias("priority"))


def embed_plan(chunks: DataFrame, reusable: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row (total, unique_keys, reusable, rejected, pending) of chunks (embed_key)."""
    keys = chunks.groupBy("embed_key").agg(F.count(F.lit(1)).alias("n"))
    j = keys.join(reusable.select("embed_key").distinct().withColumn("_u", F.lit(True)), "embed_key", "left").join(rejected.select("embed_key").distinct().withColumn("_x", F.lit(True)), "embed_key", "left")
    use, bad = F.col("_u").isNotNull(), F.col("_x").isNotNull()
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_keys"), F.count_if(use).alias("reusable"), F.count_if(~use & bad).alias("rejected"), F.count_if(~use & ~bad).alias("pending"))


def pending_keys(chunks: DataFrame, reusable: DataFrame, rejected: DataFrame) -> DataFrame:
    known = reusable.select("embed_key").union(rejected.select("embed_key"))
    return chunks.select("embed_key").distinct().join(known, "embed_key", "left_anti")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def import_outcomes(rows: DataFrame, legal: DataFrame, existing: DataFrame, dim: int) -> DataFrame:
    """Rows (n, embed_key, v) in order n with `outcome`: unknown_key, existing, wrong_dim, bad_vector or appended.

    Only the first acceptable row of a key is appended; later ones of the same key exist already."""
    from ..functions import vectors as V

    j = rows.join(legal.select("embed_key").distinct().withColumn("_l", F.lit(True)), "embed_key", "left").join(existing.select("embed_key").distinct().withColumn("_e", F.lit(True)), "embed_key", "left")
    dim_ok = F.coalesce(F.size("v") == dim, F.lit(False))
    good = dim_ok & V.usable(F.col("v"))
    j = j.withColumn("_good", F.when(F.col("_l").isNotNull() & F.col("_e").isNull() & good, F.col("n")))
    j = j.withColumn("_first", F.min("_good").over(Window.partitionBy("embed_key")))
    outcome = F.when(F.col("_l").isNull(), "unknown_key").when(F.col("_e").isNotNull() | (F.col("n") > F.col("_first")), "existing").when(~dim_ok, "wrong_dim").when(~good, "bad_vector").otherwise("appended")
    return j.select("n", "embed_key", outcome.alias("outcome"))


def journal_kept(entries: DataFrame, most_entries: int = 400_000, most_bytes: int = 2 << 30) -> DataFrame:
    """Journal entries (ord, embed_key, bytes) that retention keeps, newest first within both limits.

    Sums are taken per block of `ord` first, so the ordered pass has a row per block; only the block in which
    a limit falls is ordered row by row."""
    size = 4096
    b = entries.withColumn("_b", F.floor(F.col("ord") / size))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_s"))
    sums = sums.withColumn("_n0", F.coalesce(F.sum("_n").over(after), F.lit(0))).withColumn("_s0", F.coalesce(F.sum("_s").over(after), F.lit(0))).filter((F.col("_n0") < most_entries) & (F.col("_s0") < most_bytes))
    w = Window.partitionBy("_b").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    j = b.join(sums.select("_b", "_n0", "_s0"), "_b").withColumn("_n", F.count(F.lit(1)).over(w) + F.col("_n0")).withColumn("_s", F.sum("bytes").over(w) + F.col("_s0"))
    return j.filter((F.col("_n") <= most_entries) & (F.col("_s") <= most_bytes)).select("ord", "embed_key", "bytes")


def best_profile(profiles: DataFrame) -> DataFrame:
    """Of (profile, identity, vector_count) the compatible profile with most vectors, per identity."""
    return profiles.groupBy("identity").agg(F.max_by("profile", F.struct("vector_count", "profile")).alias("profile"), F.max("vector_count").alias("vector_count"))


def batch_validation(results: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of a batch job's results (custom_id, ok) against its requests (custom_id): counts, and whether it
    is complete; anything short of that is a failure with its counts."""
    r = results.groupBy("custom_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("ok").cast("int")).alias("_ok"))
    j = requests.select("custom_id").distinct().withColumn("_q", F.lit(True)).join(r, "custom_id", "full_outer")
    out = j.agg(F.count_if(F.col("_q").isNotNull()).alias("n_requests"), F.count_if(F.col("_ok") == 1).alias("n_ok"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.count_if(F.col("_q").isNull()).alias("n_unknown"), F.count_if(F.col("_n").isNull()).alias("n_missing"))
    return out.withColumn("complete", (F.col("n_ok") == F.col("n_requests")) & (F.col("n_repeated") == 0) & (F.col("n_unknown") == 0))


def workspace_outcomes(results: DataFrame) -> DataFrame:
    """One row (total, succeeded, failed, degraded, outcome) of per-workspace results (ok, degraded_reason)."""
    out = results.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & (F.col("degraded_reason") != "")).alias("degraded"))
    return out.withColumn("outcome", F.when(F.col("succeeded") == 0, "failed").when(F.col("failed") > 0, "partial").when(F.col("degraded") > 0, "degraded").otherwise("ok"))


def embed_rate(progress: DataFrame) -> DataFrame:
    """(done, pending, elapsed_s) with per-minute rate and seconds left."""
    per_s = F.col("done") / F.col("elapsed_s")
    ok = (F.col("done") > 0) & (F.col("elapsed_s") > 0)
    rate = F.when(ok, F.greatest(F.floor(per_s * 60), F.lit(1))).otherwise(0).cast("long")
    eta = F.when(ok & (F.col("pending") > 0), F.floor(F.col("pending") / per_s + 0.5)).otherwise(0).cast("long")
    return progress.withColumn("rate_per_min", rate).withColumn("eta_s", eta)


def prunable_tasks(tasks: DataFrame, most: int, now: str, protect_days: int = 7) -> DataFrame:
    """(id) of the finished tasks to forget so that at most `most` stay: the oldest first; tasks that ended with
    the process are kept for protect_days.

    Counts are taken per minute first, so the ordered pass has a row per minute; only the minute in which the
    limit falls is ordered row by row."""
    guarded = F.col("error").isin("shutdown", "abandoned after daemon restart")
    old = F.coalesce("completed_at", "submitted_at") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {protect_days} DAYS")
    ok = F.col("state").isin("completed", "failed", "cancelled") & (~F.coalesce(guarded, F.lit(False)) | F.coalesce(old, F.lit(False)))
    over = tasks.agg((F.count(F.lit(1)) - most).alias("_over"))
    done = tasks.filter(ok).withColumn("_b", F.coalesce(F.floor(F.unix_micros(F.col("submitted_at").cast("timestamp")) / 60_000_000), F.lit(-(1 << 62))))  # no time sorts first
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    minutes = done.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    minutes = minutes.join(over, F.col("_n0") < F.col("_over")).withColumn("_whole", F.col("_n0") + F.col("_n") <= F.col("_over"))
    j = done.join(minutes, "_b")
    last = j.filter("NOT _whole").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("submitted_at", "id")))
    return j.filter("_whole").select("id").unionByName(last.filter(F.col("_n0") + F.col("_r") <= F.col("_over")).select("id"))
