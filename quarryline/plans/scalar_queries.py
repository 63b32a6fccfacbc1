"""Queries over scalar functions and file selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from . import base as B

LANG_SQL = "CASE " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in text.LANGUAGES.items()) + " ELSE 'text' END"
EXT_SQL = r"lower(regexp_extract(url, '\.([^./]*)$', 1))"


def s3_content_gate(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", text.indexable(F.col("text"), F.octet_length("text")).alias("gate"))


def s5_s6_denied_paths(spark, sf):
    u = F.col("url")
    return B.table(spark, sf, "pages").select("page_id", text.in_vcs_dir(u).alias("vcs"), text.is_secret(u).alias("secret"))


def s14_blob_name(spark, sf):
    f = B.files(spark, sf)
    return f.select("path", ids.blob_name(F.col("path"), F.col("content")).alias("blob"))


def p1_p2_language(spark, sf):
    lang = text.detect_language(F.col("url"))
    return B.table(spark, sf, "pages").select("page_id", text.extension(F.col("url")).alias("ext"), lang.alias("language"), text.is_doc_language(lang).alias("is_doc"))


def p3_p4_lines(spark, sf):
    t = text.normalize_newlines(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", F.size(text.lines_of(t)).alias("n_lines"), text.has_oversized_line(t).alias("oversized"), F.octet_length(t).alias("n_bytes"))


def p5_identities(spark, sf):
    c = B.chunks(spark, sf)
    return c.select("path", "start", "content_hash", "id", ids.embed_key(F.col("path"), F.col("symbol"), F.col("language"), F.col("content_hash")).alias("embed_key"))


def p6_p7_document_texts(spark, sf):
    c = B.chunks(spark, sf)
    e = text.embed_text(F.col("path"), F.col("language"), F.col("symbol"), F.col("content"))
    r = text.rerank_text(F.col("path"), F.col("start"), F.col("end"), F.col("symbol"), F.col("content"))
    return c.select("id", F.md5(F.encode(e, "UTF-8")).alias("embed_md5"), F.md5(F.encode(r, "UTF-8")).alias("rerank_md5"))


def p8_structural_tokens(spark, sf):
    q = B.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(text.fields(F.col("text")))).alias("token"))
    u = B.table(spark, sf, "pages").select(F.col("page_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.explode(F.array_distinct(F.split(F.col("url"), "[:?#]"))).alias("token"))
    return q.unionByName(u).filter(text.is_structural(F.col("token")))


def p9_p11_scripts(spark, sf):
    t = F.col("text")
    return B.table(spark, sf, "conversations").select("conv_id", "turn", text.contains_cjk(t).alias("cjk"), text.han_count(t).alias("han"))


def p10_query_plan(spark, sf):
    t = F.concat(F.col("text"), F.lit(" see src/app.py and maxOutputLength v1.2.3 HTTP"))
    return B.table(spark, sf, "benchmark").select("item_id", text.lexical_query(t).alias("lexical_query"), text.lexical_query(F.col("text")).alias("plain"))


def p12_p13_query_tokens(spark, sf):
    u = F.replace(F.col("url"), F.lit("/"), F.lit(" "))
    return B.table(spark, sf, "pages").select("page_id", F.array_join(text.latin_guard_tokens(u), "|").alias("latin"), F.array_join(text.compound_keys(u), "|").alias("compound"))


def p15_subtree(spark, sf):
    f = B.files(spark, sf)
    return f.filter(text.in_subtree(F.col("path"), "docs/src1/en")).select("path", F.octet_length("content").alias("n_bytes"))


def p17_p18_fragments(spark, sf):
    c = B.chunks(spark, sf)
    return c.select("path", "start", text.is_fragment_noise(F.col("content"), F.col("capability")).alias("noise"), text.is_date_only(F.col("content")).alias("date_only"))


def p19_path_prior(spark, sf):
    p = F.regexp_replace(F.col("url"), "^https?://", "")
    return B.table(spark, sf, "pages").select("page_id", text.path_prior(p).alias("prior"), text.path_prior(F.concat(F.lit("docs/"), p)).alias("docs_prior"))


def p20_tokens(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


def p22_coverage(spark, sf):
    g = B.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("n_chars") > 500).alias("vectors"))
    return g.select("source", text.coverage_percent(F.col("vectors"), F.col("chunks")).alias("coverage"))


def p23_sanitize(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(F.encode(text.sanitize_message(F.col("text")), "UTF-8")).alias("md5"), F.octet_length(text.sanitize_message(F.col("text"))).alias("n_bytes"))


STATUSES = (200, 400, 401, 402, 403, 404, 408, 413, 429, 500, 503)


def p25_http_class(spark, sf):
    e = B.table(spark, sf, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("event_id") % len(STATUSES) + 1).cast("int"))
    body = F.when(F.col("event_id") % 3 == 0, "max token limit exceeded").when(F.col("event_id") % 3 == 1, "insufficient balance").otherwise(F.coalesce("props", F.lit("")))
    return e.select("event_id", status.alias("status"), text.classify_http(status, body).alias("kind"))


def p29_keys(spark, sf):
    u = F.col("url")
    return B.table(spark, sf, "pages").select("page_id", text.sanitize_key(u).alias("key"), text.sanitize_namespace(u).alias("namespace"))


def p30_summary(spark, sf):
    g = B.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    deg = F.when(F.col("n") % 2 == 0, "embed-skipped").otherwise("")
    return g.select("source", text.sync_summary(F.col("source"), F.col("n"), F.col("c"), F.lit(0), F.lit("delta"), F.lit("50%"), deg).alias("summary"))


QUERIES = {f.__name__: f for f in (s3_content_gate, s5_s6_denied_paths, s14_blob_name, p1_p2_language, p3_p4_lines, p5_identities, p6_p7_document_texts, p8_structural_tokens, p9_p11_scripts, p10_query_plan, p12_p13_query_tokens, p15_subtree, p17_p18_fragments, p19_path_prior, p20_tokens, p22_coverage, p23_sanitize, p25_http_class, p29_keys, p30_summary)}

_T = "trim(x, '.,;:!?()[]{}\"''`')"
_STRUCT = rf"(CASE WHEN regexp_matches({_T}, '[._/-]') THEN regexp_replace({_T}, '[^\p{{L}}]', '', 'g') NOT IN ('', 'v', 'V') ELSE regexp_matches({_T}, '\p{{Ll}}\p{{Lu}}') END)"
_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _plan(q: str) -> str:
    tokens = rf"regexp_extract_all({q}, '\S+')"
    found = f"list_filter({tokens}, lambda x: {_STRUCT})"
    return f"CASE WHEN NOT regexp_matches({q}, '{_CJK}') AND len({tokens}) >= 4 AND len({found}) > 0 THEN array_to_string({found}, ' ') ELSE {q} END"


def _prior(p: str) -> str:
    has = lambda *xs: "(" + " OR ".join(f"contains(lower({p}), '{x}')" for x in xs) + ")"
    return f"CASE WHEN {has('vendor/', 'node_modules/', 'generated', '.min.')} THEN 0.1 WHEN {has('_test.', 'test_', '/tests/', '/testdata/')} OR starts_with(lower({p}), 'tests/') OR starts_with(lower({p}), 'testdata/') THEN 0.25 WHEN starts_with(lower({p}), 'docs/') OR contains(lower({p}), '/docs/') THEN 0.6 ELSE 1.0 END::DOUBLE"


_BODY = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
_COUNTS = rf"list_filter(list_transform(string_split({_BODY}, chr(10)), lambda l: length(regexp_replace(l, '[^\p{{L}}\p{{Nd}}]', '', 'g'))), lambda n: n > 0)"


def _date(c: str) -> str:
    return rf"(NOT regexp_matches({c}, '[^\p{{Nd}}\s\p{{P}}\p{{S}}年月日号时分秒]') AND regexp_matches({c}, '\p{{Nd}}') AND (regexp_matches({c}, '[年月日号时分秒]') OR len(list_filter(string_split({c}, chr(10)), lambda l: regexp_matches(l, '\S'))) >= 3))"


NOISE = rf"""({_BODY} = '' OR {_date(_BODY)} OR coalesce(list_sum({_COUNTS}), 0) = 0 OR (len({_COUNTS}) >= 4 AND list_sum({_COUNTS}) <= 32 AND list_max({_COUNTS}) <= 4 AND NOT regexp_matches({_BODY}, '[A-Za-z0-9_]{{3}}')))"""


_ONE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_MESSAGE = "CASE WHEN strlen(one) > 512 THEN left(head, list_max(list_filter(range(0, 513), lambda i: strlen(left(head, i)) <= 512))) || '…' ELSE one END"

ORACLES = {
    "s3_content_gate": r"SELECT doc_id, CASE WHEN text IS NULL OR strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 4194304 THEN 'oversize' WHEN contains(text, chr(0)) THEN 'binary' WHEN NOT regexp_matches(text, '\S') THEN 'blank' ELSE 'ok' END AS gate FROM documents",
    "s5_s6_denied_paths": rf"SELECT page_id, regexp_matches(url, '(^|/)\.(git|hg|jj|svn)/') AS vcs, starts_with(n, '.env') OR n IN ({', '.join(repr(x) for x in text.SECRET_NAMES)}) OR regexp_extract(n, '\.([^./]*)$', 1) IN ({', '.join(repr(x) for x in text.SECRET_EXTENSIONS)}) AS secret FROM (SELECT *, lower(trim(regexp_extract(url, '([^/]*)$', 1))) AS n FROM pages)",
    "s14_blob_name": f"WITH {B.FILES} SELECT path, sha256(strlen(path) || chr(0) || path || chr(0) || content) AS blob FROM files",
    "p1_p2_language": f"SELECT page_id, e AS ext, {LANG_SQL} AS language, {LANG_SQL} IN {text.DOC_LANGUAGES} AS is_doc FROM (SELECT page_id, {EXT_SQL} AS e FROM pages)",
    "p3_p4_lines": "SELECT doc_id, len(string_split(t, chr(10)))::INT AS n_lines, len(list_filter(string_split(t, chr(10)), lambda x: strlen(x) > 4096)) > 0 AS oversized, strlen(t)::INT AS n_bytes FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents)",
    "p5_identities": f"""WITH {B.CHUNKS} SELECT path, "start", content_hash, id, sha256('a2p-v1' || chr(0) || path || chr(0) || symbol || chr(0) || language || chr(0) || content_hash) AS embed_key FROM chunks""",
    "p6_p7_document_texts": f"""WITH {B.CHUNKS}, s AS (SELECT *, CASE WHEN symbol <> '' THEN symbol END AS y FROM chunks)
SELECT id, md5('This chunk is from ' || path || ', ' || language || coalesce(', defining ' || y, '') || '.' || chr(10) || content) AS embed_md5, md5(path || ':' || "start" || '-' || "end" || coalesce(' ' || y, '') || chr(10) || content) AS rerank_md5 FROM s""",
    "p8_structural_tokens": rf"""WITH t AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '\S+'))) AS token FROM conversations UNION ALL SELECT page_id, -1, unnest(list_distinct(regexp_split_to_array(url, '[:?#]'))) FROM pages)
SELECT * FROM (SELECT conv_id, turn::BIGINT AS turn, token, token AS x FROM t) WHERE {_STRUCT}""".replace("SELECT * FROM (", "SELECT conv_id, turn, token FROM ("),
    "p9_p11_scripts": rf"SELECT conv_id, turn, regexp_matches(text, '{_CJK}') AS cjk, len(regexp_extract_all(text, '\p{{Han}}'))::INT AS han FROM conversations",
    "p10_query_plan": f"SELECT item_id, {_plan('t')} AS lexical_query, {_plan('text')} AS plain FROM (SELECT item_id, text, text || ' see src/app.py and maxOutputLength v1.2.3 HTTP' AS t FROM benchmark)",
    "p12_p13_query_tokens": r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(u, '[A-Za-z0-9_.-]+'), lambda t: trim(t, '._-')), lambda t: length(t) >= 4 AND regexp_matches(t, '^[A-Za-z]')), '|') AS latin,
array_to_string(list_filter(list_transform(regexp_extract_all(u, '\S+'), lambda x: trim(x, '"''`()[]{}<>,;:!?')), lambda x: strlen(x) >= 6 AND regexp_matches(x, '^-*[A-Za-z0-9]+(-+[A-Za-z0-9]+)+-*$') AND NOT regexp_matches(x, '(^|-)[0-9]+(-|$)'))[1:3], '|') AS compound FROM (SELECT page_id, replace(url, '/', ' ') AS u FROM pages)""",
    "p15_subtree": f"WITH {B.FILES} SELECT path, strlen(content)::INT AS n_bytes FROM files WHERE path = 'docs/src1/en' OR starts_with(path, 'docs/src1/en/')",
    "p17_p18_fragments": f"""WITH {B.CHUNKS} SELECT path, "start", {NOISE} AS noise, {_date("content")} AS date_only FROM chunks""",
    "p19_path_prior": f"SELECT page_id, {_prior('p')} AS prior, {_prior(chr(39) + 'docs/' + chr(39) + ' || p')} AS docs_prior FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)",
    "p20_tokens": "SELECT doc_id, strlen(text) // 4 + 1 AS tokens FROM documents",
    "p22_coverage": "SELECT source, (count(*) FILTER (n_chars > 500) * 100 // count(*)) || '%' AS coverage FROM documents GROUP BY source",
    "p23_sanitize": f"SELECT doc_id, md5(m) AS md5, strlen(m)::INT AS n_bytes FROM (SELECT doc_id, {_MESSAGE} AS m FROM (SELECT doc_id, one, left(one, 512) AS head FROM (SELECT doc_id, {_ONE} AS one FROM documents)))",
    "p25_http_class": f"""SELECT event_id, status, CASE WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) THEN CASE WHEN regexp_matches(b, 'balance|billing|payment|quota') THEN 'quota' ELSE 'auth' END WHEN status = 402 THEN 'quota' WHEN status = 413 THEN 'batch_too_large'
WHEN status = 400 AND contains(b, 'token') AND regexp_matches(b, 'max|limit|exceed|too') THEN 'batch_too_large' WHEN status = 408 OR status >= 500 THEN 'transient' ELSE 'permanent' END AS kind
FROM (SELECT event_id, {list(STATUSES)}[event_id % {len(STATUSES)} + 1] AS status, lower(CASE event_id % 3 WHEN 0 THEN 'max token limit exceeded' WHEN 1 THEN 'insufficient balance' ELSE coalesce(props, '') END) AS b FROM events)""",
    "p29_keys": "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 32) AS key, trim(regexp_replace(trim(url), '[^A-Za-z0-9_.-]', '-', 'g'), '.-') AS namespace FROM pages",
    "p30_summary": "SELECT source, 'revision=' || source || ' files=' || count(*) || ' added_chunks=' || sum(n_chars) || ' deleted=0 build=delta semantic_coverage=50%' || CASE WHEN count(*) % 2 = 0 THEN ' degraded=embed-skipped' ELSE '' END AS summary FROM documents GROUP BY source",
}
