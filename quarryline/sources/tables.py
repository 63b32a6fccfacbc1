"""Readers and writers of evaluation files and vectors. Malformed rows are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with id, text and an optional group, as (qid, query, grp)."""
    d = spark.read.schema("id string, text string, `group` string").option("mode", "FAILFAST").json(path)
    return _with_id(d).select(F.col("id").alias("qid"), F.col("text").alias("query"), F.col("group").alias("grp"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("id string, text string, language string").option("mode", "FAILFAST").json(path)
    return _with_id(d)


def _with_id(d: DataFrame) -> DataFrame:
    bad = F.raise_error(F.lit("a row has no id")).cast("string")
    return d.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", bad).otherwise(F.col("id")))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query, document and grade."""
    d = spark.read.schema("qid string, doc_id string, rel int").option("sep", "\t").option("mode", "FAILFAST").csv(path)
    bad = F.raise_error(F.lit("a judgement is incomplete")).cast("int")
    return d.withColumn("rel", F.when(F.col("doc_id").isNull() | F.col("rel").isNull(), bad).otherwise(F.col("rel")))


def read_docmap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, doc_id string").option("sep", "\t").option("mode", "FAILFAST").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, dim: int) -> None:
    """(embed_key, v) as unit vectors; one that isn't usable or of another dimension fails the write."""
    bad = F.raise_error(F.lit(f"a vector isn't usable or not of dimension {dim}")).cast("array<float>")
    v = F.when(V.usable(F.col("v"), dim), V.normalize(F.col("v"))).otherwise(bad)
    df.select("embed_key", v.alias("v")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    d = spark.read.schema("embed_key string, v array<float>").parquet(path)
    bad = F.raise_error(F.lit(f"stored vectors aren't of dimension {dim}")).cast("array<float>")
    return d.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(bad))


def write_postings(df: DataFrame, path: str, n: int | None = None) -> None:
    """Postings clustered by term, so that a query's terms prune row groups."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, "field", "term").sortWithinPartitions("field", "term", "id").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Postings of several segments as one."""
    return spark.read.parquet(*paths)
