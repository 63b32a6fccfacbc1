"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks as CH
from ..operators import lexical as LX


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files (path, content)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), F.col("text").alias("content"), "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of the files; the symbol is the first word of a chunk."""
    c = CH.line_windows(files(spark, sf_dir))
    return c.withColumn("symbol", F.regexp_extract("content", r"^\s*([\p{L}\p{N}_]+)", 1))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as writes of files: (path, seg_ord, deleted, size, mtime, blob, event_id)."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".py"))
    return e.select(path.alias("path"), F.col("event_id").alias("seg_ord"), (F.col("event_type") == "error").alias("deleted"), F.floor("value").cast("long").alias("size"), F.col("ts").alias("mtime"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("blob"), "event_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, rel): documents that contain a benchmark text word for word.

    Candidates share the item's rarest term, so no query is compared with every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    terms = docs.select("doc_id", F.explode(F.array_distinct(LX.analyze(F.col("text")))).alias("term"))
    asked = items.select("qid", F.explode(F.array_distinct(LX.analyze(F.col("item")))).alias("term"))
    own = terms.join(asked.select("term").distinct(), "term", "left_semi")
    df = own.groupBy("term").count()
    rare = asked.join(df, "term").groupBy("qid").agg(F.min_by("term", F.struct("count", "term")).alias("term"))
    pairs = own.join(rare, "term").select("qid", "doc_id")
    full = pairs.join(docs, "doc_id").join(items, "qid")
    return full.filter(F.contains("text", "item")).select("qid", "doc_id", F.lit(1).alias("rel"))


STOPS = "(" + ", ".join(f"'{w}'" for w in LX.STOP_WORDS) + ")"


def analyze_sql(x: str) -> str:
    return rf"list_filter(regexp_extract_all(regexp_replace(lower({x}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN {STOPS})"


FILES = "files AS (SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, doc_id FROM documents)"
CHUNKS = (
    FILES
    + r""",
lined AS (SELECT path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM files WHERE regexp_matches(content, '\S')),
starts AS (SELECT path, ls, unnest(range(0, greatest(ceil((len(ls) - 40) / 30.0), 0)::INT + 1)) * 30 AS s FROM lined),
cut AS (SELECT path, 'text' AS language, 'fallback' AS capability, (s + 1)::INT AS "start", least(s + 40, len(ls))::INT AS "end", array_to_string(ls[s + 1:s + 40], chr(10)) AS content FROM starts),
chunks AS (SELECT *, regexp_extract(content, '^\s*([\p{L}\p{N}_]+)', 1) AS symbol, substr(sha256(content), 1, 32) AS content_hash,
  substr(sha256('line-decl@8' || chr(0) || path || chr(0) || substr(sha256(content), 1, 32) || chr(0) || "start" || '-' || "end"), 1, 32) AS id
  FROM cut WHERE regexp_matches(content, '\S'))"""
)
VECTORS = "vecs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
SNAPSHOTS = "snaps AS (SELECT 'src/' || user_id || '.py' AS path, event_id AS seg_ord, event_type = 'error' AS deleted, floor(value)::BIGINT AS size, ts AS mtime, sha256(coalesce(props, '')) AS blob, event_id FROM events)"
QRELS = "qrels AS (SELECT item_id AS qid, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def bm25_sql(terms: str, weight: str = "1.0") -> str:
    """SQL of BM25 over chunk contents: `terms` is a CTE (qid, term)."""
    return f"""
tok AS (SELECT id, unnest({analyze_sql("content")}) AS term FROM chunks),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
st AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM chunks) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT qid, tf.id, {weight} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {terms} q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY qid, tf.id)"""
