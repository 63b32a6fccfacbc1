"""Result blocks: merging, budgeted selection, inventory and repository maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .chunks import top_dir


def merge_blocks(hits: DataFrame) -> DataFrame:
    """(qid, path, start, end, symbol, score, content) of hit chunks: those of one file that overlap or touch
    become one, with the best score, the first symbol and each line once. Gaps are never bridged."""
    w = Window.partitionBy("qid", "path").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = hits.withColumn("_new", F.when(far.isNull() | (F.col("start") > far + 1), 1).otherwise(0))
    m = m.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "symbol", "content")))
    g = m.groupBy("qid", "path", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), rows.alias("_rows"))
    grown = F.aggregate(F.slice("_rows", 2, 1 << 30), F.struct(F.col("_rows")[0]["end"].alias("e"), F.col("_rows")[0]["content"].alias("c")), _append)
    symbol = F.coalesce(F.try_element_at(F.filter(F.transform("_rows", lambda r: r["symbol"]), lambda s: s != ""), F.lit(1)), F.lit(""))
    return g.select("qid", "path", "start", "end", symbol.alias("symbol"), "score", grown["c"].alias("content"))


def _append(acc: Column, r: Column) -> Column:
    skip = F.greatest(acc["e"] - r["start"] + 1, F.lit(0))
    tail = F.array_join(F.slice(F.split(r["content"], "\n", -1), skip + 1, F.lit(1 << 30)), "\n")
    more = r["end"] > acc["e"]
    return F.struct(F.greatest(acc["e"], r["end"]).alias("e"), F.when(more, F.concat(acc["c"], F.lit("\n"), tail)).otherwise(acc["c"]).alias("c"))


def ranked_blocks(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "path", "start")
    return blocks.withColumn("rank", F.row_number().over(w))


def select_within(blocks: DataFrame, budget: int = 20_000, size: str = "bytes") -> DataFrame:
    """Ranked blocks (qid, path, rank, bytes) with `shown`: in rank order, first a file's first block that still
    fits, then others that fit; what doesn't fit is passed over. The budget is spent by an ordered
    fold over each query's blocks, which are as many as it has hits."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "path", F.col(size).alias("b"))))
    empty = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("files"), F.array().cast("array<int>").alias("taken"))

    def step(first: bool):
        def f(acc: Column, r: Column) -> Column:
            fits = (r["b"] <= acc["left"]) & (F.array_contains(acc["files"], r["path"]) != first) & ~F.array_contains(acc["taken"], r["rank"])
            return F.struct(
                F.when(fits, acc["left"] - r["b"]).otherwise(acc["left"]).alias("left"),
                F.when(fits, F.array_append(acc["files"], r["path"])).otherwise(acc["files"]).alias("files"),
                F.when(fits, F.array_append(acc["taken"], r["rank"])).otherwise(acc["taken"]).alias("taken"),
            )

        return f

    g = blocks.groupBy("qid").agg(rows.alias("_r")).withColumn("_one", F.aggregate("_r", empty, step(True))).withColumn("_two", F.aggregate("_r", F.col("_one"), step(False)))
    taken = g.select("qid", F.col("_two.taken").alias("_t"))
    return blocks.join(taken, "qid").withColumn("shown", F.array_contains("_t", F.col("rank"))).drop("_t")


def omitted_files(selected: DataFrame, most: int = 10) -> DataFrame:
    """(qid, path, start, end, place): the best block of up to `most` files of which nothing is shown."""
    w = Window.partitionBy("qid", "path")
    best = selected.withColumn("_any", F.max(F.col("shown").cast("int")).over(w)).withColumn("_first", F.min("rank").over(w)).filter((F.col("_any") == 0) & (F.col("rank") == F.col("_first")))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("place") <= most).select("qid", "path", "start", "end", "place")


def display_stats(selected: DataFrame) -> DataFrame:
    shown = F.col("shown")
    return selected.groupBy("qid").agg(F.count(F.lit(1)).alias("candidate_blocks"), F.count_if(shown).alias("shown_blocks"), F.countDistinct(F.when(shown, F.col("path"))).alias("shown_files"), (F.count_if(~shown) > 0).alias("truncated"))


def map_files(chunks: DataFrame, focus: str = "") -> DataFrame:
    """(path, top_dir, chunks, max_line, symbols, n_symbols, score) of each file, within focus if given."""
    own = chunks.filter(text.in_subtree(F.col("path"), focus)) if focus else chunks
    g = own.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.max("end").alias("max_line"), F.array_sort(F.collect_set(F.when(F.col("symbol") != "", F.col("symbol")))).alias("symbols"))
    return g.select("path", top_dir(F.col("path")).alias("top_dir"), "chunks", "max_line", "symbols", F.size("symbols").alias("n_symbols"), (F.size("symbols") * text.path_prior(F.col("path"))).alias("score"))


def map_line(files: DataFrame, most: int = 8) -> Column:
    more = F.when(F.col("n_symbols") > most, F.concat(F.lit(", +"), (F.col("n_symbols") - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("  "), F.col("path"), F.lit(":1-"), F.col("max_line").cast("string"), F.when(F.col("n_symbols") > 0, F.concat(F.lit(" "), F.array_join(F.slice("symbols", 1, most), ", "), more)).otherwise(""))


def select_map(files: DataFrame, budget: int, title_bytes: int = 0) -> DataFrame:
    """Files of a map in the order of choice, with `used` bytes, up to the first that goes over the budget:
    every directory's best file first, then every second best, and so on; a directory's first file pays for
    its header as well. Directories are ordered by their best file.

    The order is total and the cut a running sum: bytes are first summed per round and directory, so that
    the one ordered pass has a row per (round, directory)."""
    w = Window.partitionBy("top_dir").orderBy(F.desc("score"), "path")
    r = files.withColumn("round", F.row_number().over(w)).withColumn("line_bytes", F.octet_length(map_line(files)) + 1)
    d = files.groupBy("top_dir").agg(F.max(F.struct("score", F.lit(0).alias("_"))).alias("_m"), F.count(F.lit(1)).alias("_n"), F.sum("n_symbols").alias("_s"), F.min_by("path", F.struct((-F.col("score")).alias("a"), F.col("path").alias("b"))).alias("_p"))
    d = d.select("top_dir", F.col("_m.score").alias("dir_score"), F.col("_p").alias("dir_path"), F.octet_length(F.concat("top_dir", F.lit("/ ("), F.col("_n").cast("string"), F.lit(" files, "), F.col("_s").cast("string"), F.lit(" symbols)\n"))).alias("head_bytes"))
    j = r.join(d, "top_dir").withColumn("cost", F.col("line_bytes") + F.when(F.col("round") == 1, F.col("head_bytes")).otherwise(0))
    order = ["round", F.desc("dir_score"), "dir_path"]
    used = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + title_bytes
    # Files outside the rounds that can fit at all (each costs two bytes at least) are dropped before the ordered pass.
    j = j.filter(F.col("round") <= max(1, budget // 2))
    return j.withColumn("used", used).filter(F.col("used") <= budget).select("path", "top_dir", "round", "cost", "used")
