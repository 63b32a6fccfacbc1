"""Retrieval metrics over runs and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (metric, cut-off) of the standard family.
STANDARD = tuple([(m, k) for m in ("recall", "mrr", "set_recall", "all_hit", "ap", "ndcg") for k in (5, 10)] + [("recall", 1), ("recall", 20), ("set_recall", 20), ("ndcg", 20)])


def first_per_document(hits: DataFrame, documents: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(qid, doc_id, rank) of chunk hits (qid, id, path, rank): each document at its first chunk, renumbered, up
    to k. documents maps a path to a document id; a path without one is its own id."""
    named = hits.select("qid", "rank", F.col("path").alias("_p"))
    if documents is not None:
        named = named.join(documents.select(F.col("path").alias("_p"), F.col("doc_id").alias("_d")), "_p", "left").select("qid", "rank", F.coalesce("_d", "_p").alias("doc_id"))
    else:
        named = named.withColumnRenamed("_p", "doc_id")
    first = named.groupBy("qid", "doc_id").agg(F.min("rank").alias("_r"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_r", "doc_id"))).drop("_r")
    return out.filter(F.col("rank") <= k) if k else out


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows (qid, rank, doc_id), each document once, with `rel` (0 without a judgement)."""
    once = run.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id")))
    return once.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").na.fill({"rel": 0})


def per_query(queries: DataFrame, run: DataFrame, qrels: DataFrame, metrics: tuple = STANDARD, digits: int | None = 9) -> DataFrame:
    """(qid, grp, metric, k, value) of every query that has a positive judgement; a query without a hit has 0.
    Values that are still to be averaged aren't rounded: digits is None."""
    pos = qrels.filter(F.col("rel") > 0)
    ideal = pos.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    ks = sorted({k for _, k in metrics})
    gain = lambda rel: F.pow(F.lit(2.0), rel) - 1.0
    log2 = lambda x: F.log2(x + F.lit(1.0))
    goal = ideal.groupBy("qid").agg(F.count(F.lit(1)).alias("n_pos"), *[F.sum(F.when(F.col("_i") <= k, gain(F.col("rel")) / log2(F.col("_i")))).alias(f"idcg_{k}") for k in ks])
    j = judged(run, qrels).filter(F.col("rank") <= max(ks))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("rel") > 0).cast("int")
    j = j.withColumn("_hit", hit).withColumn("_cum", F.sum(hit).over(w))
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.sum(F.when(inside, F.col("_hit"))).alias(f"hits_{k}"),
            F.min(F.when(inside & (F.col("_hit") == 1), F.col("rank"))).alias(f"first_{k}"),
            F.sum(F.when(inside & (F.col("_hit") == 1), F.col("_cum") / F.col("rank"))).alias(f"prec_{k}"),
            F.sum(F.when(inside & (F.col("_hit") == 1), gain(F.col("rel")) / log2(F.col("rank")))).alias(f"dcg_{k}"),
        ]
    base = queries.select("qid", F.coalesce(F.col("grp"), F.lit("all")).alias("grp")).withColumn("grp", F.when(F.col("grp") == "", "all").otherwise(F.col("grp")))
    g = base.join(goal, "qid").join(j.groupBy("qid").agg(*aggs), "qid", "left")
    values = []
    for m, k in metrics:
        v = {
            "recall": F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0),
            "mrr": F.coalesce(F.lit(1.0) / F.col(f"first_{k}"), F.lit(0.0)),
            "set_recall": F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.col("n_pos"),
            "all_hit": F.when(F.col(f"hits_{k}") == F.col("n_pos"), 1.0).otherwise(0.0),
            "ap": F.coalesce(F.col(f"prec_{k}"), F.lit(0.0)) / F.col("n_pos"),
            "ndcg": F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"idcg_{k}"),
        }[m]
        values.append(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), (v if digits is None else F.round(v, digits)).alias("value")))
    return g.select("qid", "grp", F.explode(F.array(*values)).alias("m")).select("qid", "grp", "m.*")


def evaluate(queries: DataFrame, run: DataFrame, qrels: DataFrame, metrics: tuple = STANDARD) -> DataFrame:
    """(grp, metric, k, value, n_queries, n_skipped): means by group, and `overall` where groups are several.
    Queries without a positive judgement are skipped and counted; a group of such alone has mean 0."""
    scored = per_query(queries, run, qrels, metrics, None)
    groups = queries.select("qid", F.when(F.coalesce("grp", F.lit("")) == "", "all").otherwise(F.col("grp")).alias("grp"))
    kept = qrels.filter(F.col("rel") > 0).select("qid").distinct().withColumn("_j", F.lit(1))
    counts = groups.join(kept, "qid", "left").groupBy("grp").agg(F.count("_j").alias("n_queries"), F.count_if(F.col("_j").isNull()).alias("n_skipped"))
    many = groups.agg(F.countDistinct("grp").alias("n")).filter("n > 1")
    total = counts.agg(F.lit("overall").alias("grp"), F.sum("n_queries").alias("n_queries"), F.sum("n_skipped").alias("n_skipped")).join(many, F.lit(True), "left_semi")
    means = scored.groupBy("grp", "metric", "k").agg(F.sum("value").alias("s"))
    both = means.unionByName(scored.groupBy("metric", "k").agg(F.sum("value").alias("s")).withColumn("grp", F.lit("overall")))
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k")) for m, k in metrics]))
    full = counts.unionByName(total).withColumn("_m", names).select("grp", "n_queries", "n_skipped", "_m.metric", "_m.k")
    out = full.join(both, ["grp", "metric", "k"], "left")
    value = F.when(F.col("n_queries") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n_queries")).otherwise(0.0)
    return out.select("grp", "metric", "k", F.round(value, 9).alias("value"), "n_queries", "n_skipped")


def first_hit_rank(queries: DataFrame, run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, first_hit): rank of the first relevant document, 0 without one."""
    hits = judged(run, qrels).filter(F.col("rel") > 0).groupBy("qid").agg(F.min("rank").alias("r"))
    return queries.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("r", F.lit(0)).alias("first_hit"))


def paired_bootstrap(a: DataFrame, b: DataFrame, iterations: int = 1000, seed: int = 1) -> DataFrame:
    """One row (n, delta, low, high, significant) of the mean difference b - a of per-query values (qid, value).

    Slot j of resample i takes the query that a hash of (seed, i, j) names, so a run repeats itself
    anywhere. Differences are numbered once and resamples meet them by that number; sums are reduced
    before they are sorted, and bounds are taken at the places 2.5 and 97.5 percent."""
    spark = a.sparkSession
    d = a.select("qid", F.col("value").alias("_a")).join(b.select("qid", F.col("value").alias("_b")), "qid").select("qid", (F.col("_b") - F.col("_a")).alias("d"))
    # One small number per evaluated query.
    d = d.withColumn("i", F.row_number().over(Window.orderBy("qid")) - 1)
    n = d.count()
    if not n:
        return spark.createDataFrame([], "n long, delta double, low double, high double, significant boolean")
    slots = spark.range(iterations * n).select((F.col("id") % n).alias("slot"), F.floor(F.col("id") / n).alias("it"))
    picked = slots.select("it", F.pmod(F.xxhash64(F.lit(seed), "it", "slot"), F.lit(n)).alias("i"))
    means = picked.groupBy("it", "i").count().join(d.select("i", "d"), "i").groupBy("it").agg((F.sum(F.col("count") * F.col("d")) / n).alias("m"))
    sorted_ = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # `iterations` numbers
    low, high = int(iterations * 0.025), min(iterations - 1, int(iterations * 0.975))
    delta = d.agg(F.avg("d").alias("delta"))
    out = sorted_.join(delta, F.lit(True)).select(F.lit(n).cast("long").alias("n"), "delta", F.col("m")[low].alias("low"), F.col("m")[high].alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def unscored(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates of queries that a previous, broken-off scoring run didn't finish."""
    return candidates.join(done.select("qid").distinct(), "qid", "left_anti")


def mean_of(col: Column) -> Column:
    return F.round(F.avg(col), 9)
