"""Line-window chunks as a plan of built-in operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text


#: Ranges that one task orders.
RANGES = 250_000


def line_windows(files: DataFrame, window: int = 60, overlap: int = 10, doc_window: int = 40, path: str = "path", content: str = "content") -> DataFrame:
    """(path, language, capability, start, end, symbol, content, content_hash, id) of every window of lines.

    Blank windows drop out and the first window that reaches the end is the last. A window lies in the row
    of its file until it is exploded, so nothing is shuffled. Files with a null content have no chunk."""
    body = text.normalize_newlines(F.col(content))
    lang = text.detect_language(F.col(path))
    sized = files.select(F.col(path).alias("path"), lang.alias("language"), text.lines_of(body).alias("_lines"), body.alias("_body")).filter(text.lines_of(body).isNotNull() & ~text.is_blank(body))
    n = F.size("_lines")
    wide = F.when(text.is_doc_language(F.col("language")), F.lit(doc_window)).otherwise(F.lit(window))
    sized = sized.withColumn("_n", n).withColumn("_w", F.greatest(wide, F.lit(1))).withColumn("_step", F.col("_w") - F.when(F.lit(overlap) >= F.col("_w"), F.floor(F.col("_w") / 2)).otherwise(F.lit(overlap)).cast("int"))
    # The last start is the first that reaches the end.
    last = F.greatest(F.ceil((F.col("_n") - F.col("_w")) / F.col("_step")), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * F.col("_step"))
    cut = sized.withColumn("_s", F.explode(starts))
    piece = F.array_join(F.slice("_lines", F.col("_s") + 1, F.col("_w")), "\n")
    cut = cut.select("path", "language", F.lit("fallback").alias("capability"), (F.col("_s") + 1).alias("start"), F.least(F.col("_s") + F.col("_w"), F.col("_n")).alias("end"), F.lit("").alias("symbol"), piece.alias("content"))
    return with_ids(cut.filter(~text.is_blank(F.col("content"))))


def with_ids(chunks: DataFrame) -> DataFrame:
    hashed = chunks.withColumn("content_hash", ids.content_hash(F.col("content")))
    return hashed.withColumn("id", ids.chunk_id(F.col("path"), F.col("content_hash"), F.col("start"), F.col("end")))


def coalesce_ranges(ranges: DataFrame, key: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """(key, start, end, n): ranges of one key that overlap, or lie within gap, as one."""
    from pyspark.sql import Window

    # Tasks follow the rows, so that one sorts no more of a larger table. AQE merges those of a default shuffle only.
    tasks = -(-ranges.count() // RANGES)
    if tasks > int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")):
        ranges = ranges.repartition(tasks, key)
    w = Window.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(far.isNull() | (F.col(start) > far + gap), 1).otherwise(0))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_i").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_i")


def capability_by_language(chunks: DataFrame) -> DataFrame:
    """(language, capability): ast or fallback where all agree, else mixed."""
    return chunks.groupBy("language").agg(F.when(F.min("capability") == F.max("capability"), F.min("capability")).otherwise("mixed").alias("capability"))


def capability_summary(by_language: DataFrame) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.concat("language", F.lit("="), "capability")))
    return by_language.agg(F.concat(F.lit("chunker["), F.array_join(pairs, " "), F.lit("]")).alias("summary"))


def file_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1)).otherwise(".")
