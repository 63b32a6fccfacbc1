"""URL filters by pattern rules that are indexed under their rarest literal token.

A rule is a regular expression with the tokens (runs of [a-z0-9]) that any matching URL must contain. It
is filed under the one of them that the fewest URLs have. A URL's own tokens fetch the rules to try, and
no other expression runs; rules without a literal are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Rules up to which the whole index goes to every task; beyond, tokens and rules meet in a shuffled join.
BROADCAST_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@dataclass(frozen=True)
class Rule:
    """regex is searched in host + path, the host's A-Z lowered; literals are tokens of its lower-cased form."""

    name: str
    action: str
    regex: str
    literals: tuple[str, ...]
    rank: int = 0


def host_rule(action: str, where: str) -> Rule:
    """`host/path`: fits the host, its subdomains, and paths that start alike; the longest rule wins."""
    host, _, path = where.partition("/")
    path = "/" + path
    whole = _TOKEN.findall(host) + _TOKEN.findall(path.lower().rpartition("/")[0])
    return Rule(where, action, r"^(?:[^/]*\.)?" + re.escape(host + path), tuple(dict.fromkeys(whole)), 1000 + len(where))


def word_rule(words: str) -> Rule:
    """Blocks URLs in which the words, parted by anything but letters and digits, stand together."""
    tokens = words.split()
    return Rule("word:" + "-".join(tokens), "block", r"(?i:(?:^|[^a-z0-9])" + "[^a-z0-9]+".join(tokens) + r"(?:[^a-z0-9]|$))", tuple(tokens))


CONTRACT_RULES = (host_rule("allow", "org/"), host_rule("block", "example.org/es/"), host_rule("block", "example.org/en/1"), host_rule("allow", "com/fr/"), host_rule("block", "com/de/"))
_WORDS_BLOCKED = """cheap pills|spam farm|free bets|casino|porn|viagra|xxx|torrent|warez|payday loans|adult|escort|slots|betting|poker|roulette|blackjack|jackpot|
bookmaker|sex|sexcam|webcam girls|nude|nudes|milf|hentai|erotic|fetish|hookup|cialis|levitra|tramadol|xanax|online pharmacy|steroids|weight loss pills|keygen|crack download|
serial keys|pirated|nulled|cracked|free iphone|click here|make money fast|work from home|get rich|binary options|forex signals|crypto giveaway|double your bitcoin|mlm|
replica watches|fake ids|buy followers|buy likes|link farm|seo backlinks|doorway|parked domain|malware|phishing|ransomware|stresser|booter|gore|swingers|camgirls|onlyfans leaks|loan shark"""
PATTERN_RULES = tuple(word_rule(w) for w in dict.fromkeys(_WORDS_BLOCKED.replace("\n", "").split("|")))


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty where the host ends otherwise."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(/[^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rarest_tokens(places: DataFrame, rules: list[Rule]) -> dict[str, str | None]:
    """Rule name to the literal that the fewest rows of `places` (a column `place`) have; None without one."""
    spark = places.sparkSession
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {r.name: None for r in rules}
    own = spark.createDataFrame([(t,) for t in literals], "token string")
    tokens = places.select(F.explode(_tokens("place")).alias("token"))
    counted = tokens.join(F.broadcast(own) if len(literals) <= BROADCAST_RULES else own, "token").groupBy("token").count()
    # One row per literal of the rule set, which the driver holds already.
    seen = {r["token"]: r["count"] for r in counted.collect()}
    return {r.name: min(r.literals, key=lambda t: (seen.get(t, 0), t)) if r.literals else None for r in rules}


def classify(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row per input row; rule is the name of the matching rule of
    the highest rank (ties: the least name) or null, verdict its action or the default.

    A null url, or one without ://, has an empty host and path, which only rules without literals can
    match. Repeated rows and ids are judged alike; other columns aren't read or carried."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    split = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rarest = rarest_tokens(split.select(F.concat("host", "path").alias("place")), rules)
    if len(rules) > broadcast_rules:
        return _joined(split, rules, rarest, default)
    index: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: (-r.rank, r.name)):
        index.setdefault(rarest[r.name] or "", []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: [(re.compile(r.regex), r) for r in v] for k, v in index.items()}
        always = ready.get("", [])
        for batch in batches:
            names, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                place = host + path
                tries = list(always)
                for token in set(_TOKEN.findall(place.translate(_UPPER))):
                    tries += ready.get(token, ())
                if len(tries) > 1:
                    tries.sort(key=lambda x: (-x[1].rank, x[1].name))
                hit = next((r for regex, r in tries if regex.search(place)), None)
                names.append(hit and hit.name)
                verdicts.append(hit.action if hit else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    schema = T.StructType([T.StructField("page_id", kind), *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))])
    return split.mapInArrow(run, schema)


def _lower(text: str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(text: str) -> Column:
    return F.array_distinct(F.split(_lower(text), "[^a-z0-9]+"))


def _joined(split: DataFrame, rules: list[Rule], rarest: dict[str, str | None], default: str) -> DataFrame:
    """The same for any number of rules: distinct places meet the rules filed under their tokens. Rules without
    a literal are tried where the places lie."""
    spark = split.sparkSession
    filed: dict[str, list[tuple]] = {}
    for r in rules:
        if rarest[r.name] is not None:
            filed.setdefault(rarest[r.name], []).append((r.name, r.action, r.regex, r.rank))
    one = "struct<rule:string,action:string,regex:string,rank:int>"
    index = C.stored(spark.createDataFrame(list(filed.items()), f"token string, rules array<{one}>"), "url-rules")
    places = C.stored(split.groupBy(F.concat("host", "path").alias("place")).agg(F.count(F.lit(1)).alias("n")), "url-places")
    tokens = places.select("place", F.explode(_tokens("place")).alias("token"))
    uses = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    found = C.stored(index.join(uses, "token"), "url-rules-used")
    fetched = C.lookup(tokens, found, "token", "uses").select("place", F.explode("rules").alias("r")).select("place", "r.*")
    fits = fetched.filter(F.expr("place RLIKE regex")).select("place", "rule", "action", "rank")
    general = [(re.compile(r.regex), r) for r in sorted(rules, key=lambda r: (-r.rank, r.name)) if rarest[r.name] is None]
    if general:
        def always(batch: pa.RecordBatch) -> pa.RecordBatch:
            hits = [(p, r) for p in batch.column(0).to_pylist() for r in [next((r for regex, r in general if regex.search(p)), None)] if r]
            return C.pa_batch(place=pa.array([p for p, _ in hits], pa.string()), rule=pa.array([r.name for _, r in hits], pa.string()), action=pa.array([r.action for _, r in hits], pa.string()), rank=pa.array([r.rank for _, r in hits], pa.int32()))

        fits = fits.unionByName(C.arrow_map(places.select("place"), always, "place string, rule string, action string, rank int"))
    best = fits.groupBy("place").agg(F.min_by(F.struct("rule", "action"), F.struct(-F.col("rank"), F.col("rule"))).alias("b"))
    every = C.stored(places.join(best, "place", "left").select("place", "n", "b"), "url-verdicts")
    got = C.lookup(split.withColumn("place", F.concat("host", "path")), every, "place", "n")
    return got.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    out = classify(C.table(spark, sf_dir, "pages"), [*CONTRACT_RULES, *PATTERN_RULES])
    own = F.when(F.col("rule").startswith("word:"), F.lit(None).cast("string")).otherwise(F.col("rule"))
    return out.select("page_id", "host", "path", own.alias("rule"), "verdict", F.when(own.isNull(), F.col("rule")).alias("pattern"))


_VALUES = ", ".join(f"('{r.name}', '{r.action}', {len(r.name)}, '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for r in CONTRACT_RULES)
_WORDS = ", ".join(f"('{r.name}', '{r.regex}')" for r in PATTERN_RULES)
ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r(rule, action, n, rh, rp) AS (VALUES {_VALUES}),
k(name, regex) AS (VALUES {_WORDS}),
f AS (SELECT i, max_by(struct_pack(rule := rule, action := action), n) AS b FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i),
p AS (SELECT i, min(name) AS name FROM s JOIN k ON regexp_matches(host || path, regex) GROUP BY i)
SELECT page_id, host, path, b.rule AS rule, CASE WHEN b IS NOT NULL THEN b.action WHEN p.name IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN b IS NULL THEN p.name END AS pattern
FROM s LEFT JOIN f USING (i) LEFT JOIN p USING (i)
"""
