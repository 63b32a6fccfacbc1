"""Line-first cleaning: rules per line first, then documents that lose too much text go.

A line with words fails if it is short and has no closing punctuation, is navigation (many separators), boilerplate
(legal, cookie and script notices), or noise (mostly symbols, or shouted words). Failing lines are
removed; a document goes if the words of its other lines are less than `least_left` of all its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_BOILER = re.compile(r"(?i:licensed under|all rights reserved|copyright \(c\)|privacy policy|terms of (?:use|service)|use cookies|enable javascript|sign in|log in|subscribe (?:now|to)|click here|lorem ipsum|powered by)")
_CLOSED = re.compile(r"""[.!?;:…。！？]["'”’»)\]]*[ \t\r\x0b\x0c]*\Z""")
_BARS = re.compile(r"(?:^|[ \t\r\x0b\x0c])[|>»•·/–-](?=[ \t\r\x0b\x0c]|\Z)")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SHOUT = re.compile(r"!!(?=[ \t\r\x0b\x0c]|\Z)")

#: The rules in the order in which they are tried; a line's first is its reason.
RULES = ("navigation", "boilerplate", "noise", "punctuation")


def failing_rule(line: str, n_words: int) -> str | None:
    """The rule that a line with words fails, or None. 100 * bars > 20 * words is navigation; symbols over
    words, or shouted words over half of them, are noise."""
    if 100 * len(_BARS.findall(line)) > 20 * n_words and n_words > 2:
        return "navigation"
    if _BOILER.search(line):
        return "boilerplate"
    if len(_SYMBOL.findall(line)) > n_words or 2 * len(_SHOUT.findall(line)) > n_words:
        return "noise"
    if n_words < 20 and not _CLOSED.search(line):
        return "punctuation"
    return None


_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def judge_lines(text: str) -> tuple[str, int, int, dict[str, int]]:
    """(cleaned text, words left, repeated lines, failed lines by rule) of a text split at \\n."""
    kept, left, repeats, failed, seen = [], 0, 0, {}, set()
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            if line in seen:
                repeats += 1
            else:
                seen.add(line)
            rule = failing_rule(line, n)
            if rule is not None:
                failed[rule] = failed.get(rule, 0) + 1
                continue
        left += n
        kept.append(line)
    return "\n".join(kept), left, repeats, failed


def repeated_words(words: C.Words, window: int = 5) -> np.ndarray:
    """Per text: the words that lie in a window of words found twice or more in that text."""
    n_texts = len(words.of) - 1
    grams = C.gram_hash(words.hash, window)
    owner = words.text_of_word()
    inside = owner[: len(grams)] == owner[window - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(n_texts, np.int64)
    key = C.mix(grams[at] + C.mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    twice = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(owner) + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.bincount(owner[covered], minlength=n_texts)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10, most_repeated: int = 20, least_left: int = 50, with_text: bool = False) -> DataFrame:
    """A row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left,
    failed_lines, base_failed, kept[, cleaned].

    base_failed: fewer than least_words words, or over most_repeated percent of them in repeated windows.
    kept: base passed and at least least_left percent of the words lie on lines that pass. Null texts
    have no words (base fails); repeated rows and ids are judged alike, each on its own; only id and
    text are read; an empty table gives an empty one. `cleaned` is the text without its failing lines."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(1)
        w = C.Words(col)
        n_texts = batch.num_rows
        owner = np.repeat(np.arange(n_texts), np.diff(w.off))
        points = (w.data & 0xC0) != 0x80
        n_words = np.diff(w.of)
        space = C._WS[w.data]
        symbols = np.isin(w.data, np.frombuffer(b"#*$%&|<>", np.uint8))
        judged = [judge_lines(t or "") for t in col.to_pylist()]
        left = np.array([j[1] for j in judged], np.int64)
        repeat = repeated_words(w)
        failed = (n_words < least_words) | (100 * repeat > most_repeated * n_words)
        extra = {"cleaned": pa.array([j[0] for j in judged], pa.string())} if with_text else {}
        return C.pa_batch(
            doc_id=batch.column(0), n_words=n_words.astype(np.int64), word_chars=np.bincount(owner[points & ~space], minlength=n_texts).astype(np.int64),
            n_symbols=np.bincount(owner[symbols], minlength=n_texts).astype(np.int64), n_dup_lines=np.array([j[2] for j in judged], np.int64),
            n_repeat_words=repeat.astype(np.int64), words_left=left, failed_lines=np.array([sum(j[3].values()) for j in judged], np.int64),
            base_failed=failed, kept=~failed & (100 * left >= least_left * n_words), **extra,
        )

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, words_left long, failed_lines long, base_failed boolean, kept boolean" + ", cleaned string" * with_text
    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), one, schema)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **limits) -> DataFrame:
    """docs without the documents that measure() rejects, and without the failing lines of the others; all
    columns stay, chars_col (if there) is the new number of characters. No row is moved."""
    names = docs.columns
    least_words, most_repeated, least_left = (limits.get(k, d) for k, d in (("least_words", 10), ("most_repeated", 20), ("least_left", 50)))
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        col = batch.column(at)
        w = C.Words(col)
        n_words = np.diff(w.of)
        repeat = repeated_words(w)
        good = np.flatnonzero(~((n_words < least_words) | (100 * repeat > most_repeated * n_words)))
        if not len(good):
            return None
        part = batch.take(pa.array(good))
        judged = [judge_lines(t) for t in part.column(at).to_pylist()]
        keep = np.array([100 * j[1] >= least_left * n for j, n in zip(judged, n_words[good])], bool)
        part, texts = part.filter(pa.array(keep)), [j[0] for j, k in zip(judged, keep) if k]
        cols = list(part.columns)
        cols[at] = pa.array(texts, pa.string())
        if chars is not None:
            cols[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(part.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return C.arrow_map(docs, one, docs.schema, C.SMALL_STEP)


def query(spark, sf_dir: str) -> DataFrame:
    return measure(C.table(spark, sf_dir, "documents"))


_SP = r"[\x20\x09-\x0D]"
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
j AS (SELECT doc_id, line, n,
    (100 * len(regexp_extract_all(' ' || regexp_replace(line, '[ \t\r\x0b\x0c]', '  ', 'g') || ' ', '[ ][|>»•·/–-][ ]')) > 20 * n AND n > 2)
    OR regexp_matches(line, '(?i:licensed under|all rights reserved|copyright \(c\)|privacy policy|terms of (?:use|service)|use cookies|enable javascript|sign in|log in|subscribe (?:now|to)|click here|lorem ipsum|powered by)')
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) > n
    OR 2 * len(regexp_extract_all(regexp_replace(line, '[ \t\r\x0b\x0c]', '  ', 'g') || ' ', '!![ ]')) > n
    OR n < 20 AND NOT regexp_matches(line, '[.!?;:…。！？]["''”’»)\]]*[ \t\r\x0b\x0c]*$') AS bad
  FROM lw WHERE n > 0),
ls AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN bad THEN 0 ELSE n END) AS words_left, sum(bad::INT) AS failed_lines FROM j GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(words_left, 0)::BIGINT AS words_left, coalesce(failed_lines, 0)::BIGINT AS failed_lines
  FROM d LEFT JOIN ls USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * words_left >= 50 * n_words AS kept
FROM m
"""
