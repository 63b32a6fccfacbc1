"""Lexical retrieval: postings, corpus statistics and BM25 over weighted clauses, for a table of queries.

Postings are built once and stored clustered by term; a batch of queries joins only its own terms. The
scores of all queries come from one job; ranks are windows by query."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import scoring as SC

STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
K1, B = 1.2, 0.75
FIELDS = ("content", "path", "symbol")


@dataclass(frozen=True)
class Weights:
    content: float = 1.0
    path: float = 1.0
    symbol: float = 0.1
    symbol_exact: float = 4.0
    latin_content: float = 4.0
    latin_path: float = 1.0
    compound_key: float = 2.0


def analyze(value: Column) -> Column:
    """Terms of a text: lower-cased runs of letters, digits and _, each Han character on its own, without
    stop words."""
    spaced = F.regexp_replace(F.lower(value), r"(\p{IsHan})", " $1 ")
    terms = F.regexp_extract_all(spaced, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.filter(terms, lambda t: ~t.isin(*STOP_WORDS))


def postings(chunks: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """(field, term, id, tf, dl): term counts are pre-aggregated within the row, so the shuffle-free plan
    explodes distinct terms only."""
    parts = []
    for f in fields:
        t = analyze(F.col(f))
        one = chunks.select(F.col(id_col).alias("id"), t.alias("_t"), F.size(t).alias("dl"))
        parts.append(one.select("id", "dl", F.explode("_t").alias("term")).groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select(F.lit(f).alias("field"), "term", "id", "tf", "dl"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_stats(chunks: DataFrame, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """(field, n, avgdl) over all chunks: one row per field."""
    aggs = []
    for f in fields:
        aggs += [F.avg(F.size(analyze(F.coalesce(F.col(f), F.lit(""))))).alias(f"a_{f}")]
    one = chunks.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n").alias("n"), F.coalesce(F.col(f"a_{f}"), F.lit(0.0)).alias("avgdl")) for f in fields]))
    return one.select(rows.alias("r")).select("r.*")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(term, df, cf) of all contents."""
    if one_row_each(chunks):
        return SC.term_counts(chunks.select(analyze(F.col("content")).alias("_t")), "_t")
    return postings(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    return idf(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _bm25_of(tf, dl, df, n, avgdl):
    """bm25() on arrays."""
    return np.log(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def one_row_each(chunks: DataFrame, id_col: str = "id") -> bool:
    """Whether no id has several rows."""
    return not chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()


def match_scores(clauses: DataFrame, posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, clause, id, score, n_terms) of clauses (qid, clause, field, term, boost).

    Only postings of the clauses' terms take part: they are selected by a semi join before document
    frequencies are counted, so common terms of no query cost nothing."""
    terms = clauses.select("field", "term").distinct()
    own = posted.join(terms, ["field", "term"], "left_semi")
    df = document_frequency(own)
    # One row per field.
    scored = clauses.join(df, ["field", "term"]).join(F.broadcast(stats), "field").join(own, ["field", "term"])
    one = F.col("boost") * bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return scored.groupBy("qid", "clause", "id").agg(F.sum(one).alias("score"), F.countDistinct("term").alias("n_terms"))


def build_clauses(queries: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """(qid, clause, kind, field, term, boost, need): one row per distinct term of every clause whose weight is
    positive. need is the number of terms that must be there (kebab keys), else 0."""
    parts = []

    def add(kind: str, field: str, terms: Column, boost: float, need: Column | None = None, where: Column | None = None) -> None:
        if boost > 0:
            q = queries.filter(where) if where is not None else queries
            t = F.array_distinct(terms)
            q = q.select("qid", F.lit(kind).alias("clause"), F.lit(field).alias("field"), F.explode(t).alias("term"), F.lit(boost).alias("boost"), (need if need is not None else F.lit(0)).alias("need"))
            parts.append(q)

    q = F.col("query")
    for f, w in (("content", weights.content), ("path", weights.path), ("symbol", weights.symbol)):
        add(f, f, analyze(q), w)
    guard = text.latin_guard_tokens(q)
    mixed = (text.han_count(q) >= 2) & (F.size(guard) > 0)
    latin = analyze(F.array_join(guard, " "))
    add("latin_content", "content", latin, weights.latin_content, where=mixed)
    add("latin_path", "path", latin, weights.latin_path, where=mixed)
    if weights.compound_key > 0:
        for i in range(3):
            key = F.try_element_at(text.compound_keys(q), F.lit(i + 1))
            seg = F.array_distinct(analyze(F.replace(key, F.lit("-"), F.lit(" "))))
            add(f"compound_{i}", "content", seg, weights.compound_key, need=F.size(seg), where=key.isNotNull())
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        return queries.sparkSession.createDataFrame([], "qid string, clause string, field string, term string, boost double, need int")
    return out


def _worded(clauses: DataFrame, chunks: DataFrame, fields: tuple[str, ...], posted: DataFrame | None, stats: DataFrame | None) -> DataFrame:
    """(qid, id, score) of clauses by postings, those of the index where it has them."""
    posted = postings(chunks, fields=fields) if posted is None else posted
    stats = field_stats(chunks, fields) if stats is None else stats
    found = match_scores(clauses.drop("need"), posted, stats)
    need = clauses.groupBy("qid", "clause").agg(F.max("need").alias("need"))
    return found.join(need, ["qid", "clause"]).filter((F.col("need") == 0) | (F.col("n_terms") == F.col("need"))).select("qid", "id", "score")


def search(queries: DataFrame, chunks: DataFrame, k: int = 20, weights: Weights = Weights(), prefix: str = "", posted: DataFrame | None = None, stats: DataFrame | None = None, clauses: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best chunks of each query (qid, query) by score, ties by id.

    Clauses are alternatives whose scores add up; a path prefix is applied to the chunks before anything is
    ranked, while statistics stay those of the whole corpus. Queries without a clause have no hit."""
    k = k if k > 0 else 10
    fields = tuple(f for f in FIELDS if f in chunks.columns)
    by_symbol = weights.symbol_exact > 0 and "symbol" in chunks.columns
    worded = clauses is not None or max(weights.content, weights.path, weights.symbol, weights.latin_content, weights.latin_path, weights.compound_key) > 0
    if clauses is None:
        clauses = build_clauses(queries, weights)
    clauses = clauses.filter(F.col("field").isin(*fields))
    if worded and not by_symbol and posted is None and stats is None and one_row_each(chunks):
        inside = text.in_subtree(F.col("path"), prefix) if prefix else None
        return top_k(SC.best(clauses, chunks, {f: analyze(F.col(f)) for f in fields}, k, inside, _bm25_of), k)
    found = _worded(clauses, chunks, fields, posted, stats) if worded else None
    if by_symbol:
        n = chunks.count()
        exact = queries.join(chunks.filter(F.col("symbol") != "").select(F.col("symbol").alias("query"), "id"), "query")
        df = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("df"))
        by_name = exact.join(df, "qid").select("qid", "id", (F.lit(weights.symbol_exact) * idf(F.col("df"), F.lit(n))).alias("score"))
        found = by_name if found is None else found.unionByName(by_name)
    if found is None:
        found = queries.select("qid").crossJoin(chunks.select("id")).withColumn("score", F.lit(0.0)).limit(0)
    if prefix:
        found = found.join(chunks.filter(text.in_subtree(F.col("path"), prefix)).select("id"), "id", "left_semi")
    total = found.groupBy("qid", "id").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_k(total, k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def here(df: DataFrame) -> DataFrame:
    """A result of a few rows as a table of its own, so that plans built on it stay small."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def lexical_route(queries: DataFrame, chunks: DataFrame, k: int = 20, weights: Weights = Weights(), prefix: str = "", few: bool = False, **ready) -> DataFrame:
    """search() with the structural form of each query; queries that find nothing so are searched as they are.
    few: the queries are a question at hand; its terms and hits (at most k) pass through the driver."""
    keep = here if few else lambda d: d
    planned = keep(queries.select("qid", text.lexical_query(F.col("query")).alias("query")))

    def ask(q: DataFrame) -> DataFrame:
        return keep(search(q, chunks, k, weights, prefix, clauses=here(build_clauses(q, weights)) if few else None, **ready))

    first = ask(planned) if few else ask(planned).persist()  # at most k rows a query, read several times
    changed = queries.join(planned.withColumnRenamed("query", "planned"), "qid").filter(F.col("query") != F.col("planned")).select("qid", "query")
    if not changed.limit(1).count():
        return first
    missed = keep(changed.join(first.select("qid").distinct(), "qid", "left_anti"))
    if not missed.limit(1).count():
        return first
    return first.unionByName(ask(missed))
