"""Reciprocal-rank fusion and what follows it: anchor, rerank order, windows of tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fusion:
    k: float = 20
    lexical: float = 0.15
    dense: float = 0.85

    def clamped(self) -> "Fusion":
        return Fusion(self.k if self.k > 0 else 60, max(self.lexical, 0.0), max(self.dense, 0.0))


EQUAL = Fusion(60, 1, 1)


def rrf(hits: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """(qid, id, score, source, rank) of route hits (qid, route, rank, id), route being lexical or dense.

    Of an id that a route has twice the first counts, at the place it has; empty ids don't. A route of
    weight zero keeps its candidates, without a score. One shuffle by (qid, id) merges both routes."""
    f = how.clamped()
    first = hits.filter(F.col("id").isNotNull() & (F.col("id").cast("string") != "")).groupBy("qid", "id")
    ranks = first.agg(F.min(F.when(F.col("route") == "lexical", F.col("rank"))).alias("_l"), F.min(F.when(F.col("route") == "dense", F.col("rank"))).alias("_d"))
    score = F.coalesce(F.lit(f.lexical) / (F.lit(float(f.k)) + F.col("_l")), F.lit(0.0)) + F.coalesce(F.lit(f.dense) / (F.lit(float(f.k)) + F.col("_d")), F.lit(0.0))
    source = F.when(F.col("_l").isNull(), "dense").when(F.col("_d").isNull(), "lexical").otherwise("both")
    out = ranks.select("qid", "id", F.round(score, 12).alias("score"), source.alias("source"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


def anchor(ranked: DataFrame, anchors: DataFrame, window: int = 50) -> DataFrame:
    """Ranked (qid, id, rank) with each query's anchor (qid, id) moved up to the last place of the window if
    it stood below; what it passes moves down by one."""
    a = anchors.select("qid", F.col("id").alias("_a")).join(ranked.select("qid", F.col("id").alias("_a"), F.col("rank").alias("_r")), ["qid", "_a"])
    j = ranked.join(a, "qid", "left")
    moved = (
        F.when(F.col("_r").isNull() | (F.col("_r") <= window), F.col("rank"))
        .when(F.col("id") == F.col("_a"), F.lit(window))
        .when((F.col("rank") >= window) & (F.col("rank") < F.col("_r")), F.col("rank") + 1)
        .otherwise(F.col("rank"))
    )
    return j.withColumn("rank", moved.cast("int")).drop("_a", "_r")


def by_position(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.lit(1.0) / F.col("rank"))


def sent_to_rerank(ranked: DataFrame, query_tokens: str = "query_tokens", doc_tokens: str = "doc_tokens", head: int = 50, most: int = 200_000) -> DataFrame:
    """Whether each row is sent: in the head, and before the tokens, the query's again for every document,
    first go over the cap."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("rank") <= head, F.col(query_tokens) + F.col(doc_tokens))).over(w)
    return ranked.withColumn("sent", (F.col("rank") <= head) & (F.coalesce(used, F.lit(0)) <= most))


def rerank_order(ranked: DataFrame, returned: DataFrame, head: int = 50) -> DataFrame:
    """(qid, id, rank, bucket): reranked first by score, then sent but not returned, not sent, without a chunk,
    and the tail, each in its old order. Ranked has `sent` and `has_chunk`; returned is (qid, id, score)."""
    r = returned.groupBy("qid", "id").agg(F.max("score").alias("_s"))
    j = ranked.join(r, ["qid", "id"], "left")
    bucket = F.when(F.col("rank") > head, 4).when(~F.col("has_chunk"), 3).when(~F.col("sent"), 2).when(F.col("_s").isNull(), 1).otherwise(0)
    j = j.withColumn("bucket", bucket)
    score = F.when(F.col("bucket") == 0, -F.col("_s"))
    w = Window.partitionBy("qid").orderBy("bucket", score.asc_nulls_last(), "rank")
    return j.withColumn("_n", F.row_number().over(w)).select("qid", "id", F.col("_n").alias("rank"), "bucket")


def check_rerank(returned: DataFrame, sent: DataFrame) -> DataFrame:
    """(qid, n_sent, n_returned, valid): a response has every sent id exactly once and no other."""
    s = sent.groupBy("qid").agg(F.count(F.lit(1)).alias("n_sent"))
    r = returned.join(sent.select("qid", "id", F.lit(True).alias("_known")), ["qid", "id"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n_returned"), F.countDistinct("id").alias("_ids"), F.count_if(F.col("_known").isNull()).alias("_other"))
    j = s.join(r, "qid", "left").na.fill({"n_returned": 0, "_ids": 0, "_other": 0})
    return j.select("qid", "n_sent", "n_returned", ((F.col("n_sent") == F.col("n_returned")) & (F.col("_ids") == F.col("n_sent")) & (F.col("_other") == 0)).alias("valid"))


def sweep(hits: DataFrame, settings: list[Fusion]) -> DataFrame:
    """rrf() under several settings at once, as (setting, qid, id, score, rank): routes are reduced to one row
    per id before the settings multiply them."""
    first = hits.groupBy("qid", "id").agg(F.min(F.when(F.col("route") == "lexical", F.col("rank"))).alias("_l"), F.min(F.when(F.col("route") == "dense", F.col("rank"))).alias("_d"))
    rows = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(float(f.k)).alias("k"), F.lit(f.lexical).alias("a"), F.lit(f.dense).alias("b")) for i, f in enumerate(x.clamped() for x in settings)])
    many = first.withColumn("_p", F.explode(rows)).select("*", "_p.*")
    score = F.coalesce(F.col("a") / (F.col("k") + F.col("_l")), F.lit(0.0)) + F.coalesce(F.col("b") / (F.col("k") + F.col("_d")), F.lit(0.0))
    out = many.select("setting", "qid", "id", F.round(score, 12).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("setting", "qid").orderBy(F.desc("score"), "id")))
