"""Scalar column functions over paths, queries, contents and provider messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "bash": "shell", "c": "c", "cc": "cpp", "cjs": "javascript", "cpp": "cpp", "cs": "csharp", "css": "css", "go": "go", "h": "c", "hpp": "cpp",
    "html": "html", "java": "java", "js": "javascript", "json": "json", "jsx": "javascript", "kt": "kotlin", "lua": "lua", "md": "markdown",
    "mdx": "markdown", "mjs": "javascript", "php": "php", "proto": "proto", "py": "python", "rb": "ruby", "rs": "rust", "rst": "restructuredtext",
    "scala": "scala", "sh": "shell", "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescript", "txt": "text",
    "xml": "xml", "yaml": "yaml", "yml": "yaml", "zsh": "shell",
}
DOC_LANGUAGES = ("json", "markdown", "restructuredtext", "text", "toml", "xml", "yaml")
VCS_DIRS = (".git", ".hg", ".jj", ".svn")
SECRET_NAMES = (
    ".dockercfg", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa", "secret.json",
    "secrets.json", "service-account.json", "session.json", "token", "tokens.json",
)
SECRET_EXTENSIONS = ("cer", "crt", "csr", "der", "jks", "kdb", "key", "p12", "p7b", "p7c", "pem", "pfx")
#: Characters that may stand around a token of a query.
AROUND = ".,;:!?()[]{}\"'`"
MIB = 1 << 20
SPACE, SOME = r"\s", r"\S"


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def detect_language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


def is_doc_language(language: Column) -> Column:
    return language.isin(*DOC_LANGUAGES)


def normalize_newlines(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def has_oversized_line(content: Column, most: int = 4096) -> Column:
    return F.exists(lines_of(content), lambda x: F.octet_length(x) > most)


def is_blank(content: Column) -> Column:
    return ~content.rlike(SOME)


def indexable(content: Column, size: Column, most_text: int = 4 * MIB) -> Column:
    """Why a file's content is in or out: ok, empty, blank, binary or oversize. Text may be as large as
    most_text; content that isn't text is out at any size."""
    return (
        F.when(content.isNull() | (size == 0), "empty")
        .when(size > most_text, "oversize")
        .when(F.instr(content, "\x00") > 0, "binary")
        .when(is_blank(content), "blank")
        .otherwise("ok")
    )


def in_vcs_dir(path: Column) -> Column:
    return path.rlike(r"(^|/)\.(git|hg|jj|svn)/")


def is_secret(path: Column) -> Column:
    name = F.lower(F.trim(base_name(path)))
    return name.startswith(".env") | name.isin(*SECRET_NAMES) | F.regexp_extract(name, r"\.([^./]*)$", 1).isin(*SECRET_EXTENSIONS)


def trimmed(token: Column, chars: str) -> Column:
    return F.btrim(token, F.lit(chars))


def fields(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)


def is_structural(token: Column) -> Column:
    """A token that looks like code: a separated identifier with a letter other than a bare version mark, or
    a camel hump."""
    t = trimmed(token, AROUND)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    return F.when(t.rlike(r"[._/-]"), (letters != "") & ~letters.isin("v", "V")).otherwise(t.rlike(r"\p{Ll}\p{Lu}"))


def contains_cjk(text: Column) -> Column:
    return text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def lexical_query(query: Column) -> Column:
    """What the lexical route searches: the structural tokens of a long enough query outside CJK, or the
    query itself."""
    t = fields(query)
    s = F.filter(t, is_structural)
    return F.when(~contains_cjk(query) & (F.size(t) >= 4) & (F.size(s) > 0), F.array_join(s, " ")).otherwise(query)


def han_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\p{IsHan})"), 1))


def latin_guard_tokens(query: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9_.-]+)"), 1), lambda t: trimmed(t, "._-"))
    return F.filter(runs, lambda t: (F.length(t) >= 4) & t.rlike("^[A-Za-z]"))


def compound_keys(query: Column, most: int = 3) -> Column:
    """Kebab keys of a query: at least six bytes, two segments, each of letters and digits with a letter."""
    t = F.transform(fields(query), lambda x: trimmed(x, "\"'`()[]{}<>,;:!?"))
    good = F.filter(t, lambda x: (F.octet_length(x) >= 6) & x.rlike(r"^-*[A-Za-z0-9]+(-+[A-Za-z0-9]+)+-*$") & ~x.rlike(r"(^|-)[0-9]+(-|$)"))
    return F.slice(good, 1, most)


def effective(line: Column) -> Column:
    """Letters and digits of a line."""
    return F.length(F.regexp_replace(line, r"[^\p{L}\p{Nd}]", ""))


def is_date_only(content: Column) -> Column:
    filled = F.size(F.filter(lines_of(content), lambda x: x.rlike(SOME)))
    only = ~content.rlike(r"[^\p{Nd}\s\p{P}\p{S}年月日号时分秒]")
    return only & content.rlike(r"\p{Nd}") & (content.rlike("[年月日号时分秒]") | (filled >= 3))


def is_fragment_noise(content: Column, capability: Column) -> Column:
    body = F.regexp_replace(content, r"^\s+|\s+$", "")
    counts = F.filter(F.transform(lines_of(body), effective), lambda n: n > 0)
    total = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    thin = (F.size(counts) >= 4) & (total <= 32) & (F.coalesce(F.array_max(counts), F.lit(0)) <= 4) & ~body.rlike("[A-Za-z0-9_]{3}")
    return (capability == "fallback") & ((body == "") | is_date_only(body) | (total == 0) | thin)


def path_prior(path: Column) -> Column:
    p = F.lower(path)

    def has(*parts: str) -> Column:
        return reduce(lambda a, b: a | b, [p.contains(x) for x in parts])

    return (
        F.when(has("vendor/", "node_modules/", "generated", ".min."), 0.1)
        .when(has("_test.", "test_", "/tests/", "/testdata/") | p.startswith("tests/") | p.startswith("testdata/"), 0.25)
        .when(p.startswith("docs/") | has("/docs/"), 0.6)
        .otherwise(1.0)
    )


def in_subtree(path: Column, prefix: str) -> Column:
    """path is prefix or lies under it; both parts push down to a scan."""
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)


def normalize_prefix(prefix: str) -> str:
    """A path prefix with / between segments; absolute, drive and parent paths are errors."""
    p = prefix.strip().replace("\\", "/")
    if p.startswith("/") or (len(p) > 1 and p[1] == ":"):
        raise ValueError(f"path prefix must be relative: {prefix!r}")
    parts = [x for x in p.split("/") if x not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"path prefix leaves the workspace: {prefix!r}")
    return "/".join(parts)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long") + 1


def coverage_percent(vectors: Column, chunks: Column) -> Column:
    return F.when(chunks == 0, "100%").otherwise(F.concat(F.floor(vectors * 100 / chunks).cast("long").cast("string"), F.lit("%")))


def sanitize_message(text: Column, most: int = 512) -> Column:
    """One line of at most `most` bytes, cut between characters."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    raw = F.encode(one, "UTF-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(one) > most, F.concat(cut, F.lit("…"))).otherwise(one)


def classify_http(status: Column, body: Column) -> Column:
    b = F.lower(sanitize_message(body))
    money = b.rlike("balance|billing|payment|quota")
    return (
        F.when(status == 429, "rate_limit")
        .when(status.isin(401, 403), F.when(money, "quota").otherwise("auth"))
        .when(status == 402, "quota")
        .when(status == 413, "batch_too_large")
        .when((status == 400) & b.contains("token") & b.rlike("max|limit|exceed|too"), "batch_too_large")
        .when((status == 408) | (status >= 500), "transient")
        .otherwise("permanent")
    )


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait that a Retry-After header asks for: a number, or an HTTP date after now; else 0."""
    h = F.trim(header)
    number = F.when(h.rlike("^[+-]?[0-9]{1,9}$"), h.cast("long"))
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(h, r"^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.coalesce(number, F.unix_timestamp(at) - F.unix_timestamp(now), F.lit(0)), F.lit(0))


def sanitize_key(name: Column, most: int = 32) -> Column:
    key = F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), 1, most)
    return F.when(key == "", "ws").otherwise(key)


def sanitize_namespace(name: Column) -> Column:
    key = trimmed(F.regexp_replace(F.trim(name), "[^A-Za-z0-9_.-]", "-"), ".-")
    return F.when(F.coalesce(key, F.lit("")) == "", "default").otherwise(key)


def sync_summary(revision, files, added, deleted, build=None, coverage=None, degraded=None) -> Column:
    parts = [F.concat(F.lit("revision="), revision), F.concat(F.lit("files="), files.cast("string")), F.concat(F.lit("added_chunks="), added.cast("string")), F.concat(F.lit("deleted="), deleted.cast("string"))]
    for label, col in (("build=", build), ("semantic_coverage=", coverage), ("degraded=", degraded)):
        if col is not None:
            parts.append(F.when(col != "", F.concat(F.lit(label), col)))
    return F.concat_ws(" ", *parts)


def block_header(path, start, end, symbol) -> Column:
    return F.concat(F.lit("## "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.when(symbol != "", F.concat(F.lit(" "), symbol)).otherwise(""))


def embed_text(path, language, symbol, content) -> Column:
    head = F.concat(F.lit("This chunk is from "), path, F.lit(", "), language, F.when(symbol != "", F.concat(F.lit(", defining "), symbol)).otherwise(""))
    return F.concat(head, F.lit(".\n"), content)


def rerank_text(path, start, end, symbol, content) -> Column:
    return F.concat(F.substring(block_header(path, start, end, symbol), 4, 1 << 30), F.lit("\n"), content)
