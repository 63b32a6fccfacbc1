"""File splitters: declarations where they can be told, line windows elsewhere; 2,048 bytes at most per chunk.

Python is split by its own parser. Brace languages are split by a scanner that blanks comments and
strings, keeps bracket depth and cuts at declaration ends; Ruby by indented `end`s. A file is reported
as `ast` only where declarations were found, as `fallback` otherwise."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import DOC_LANGUAGES, LANGUAGES
from .chunks import with_ids

MOST_BYTES, SMALL_BYTES, WINDOW, OVERLAP, DOC_WINDOW, LONG_LINE = 2048, 512, 60, 10, 40, 4096


@dataclass
class Span:
    start: int
    end: int
    symbol: str = ""
    func: bool = False


@dataclass
class Chunk:
    start: int
    end: int
    content: str
    symbol: str = ""
    capability: str = "fallback"


def language_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return LANGUAGES.get(name.rpartition(".")[2].lower(), "text") if "." in name else "text"


# --- windows and the byte limit ----------------------------------------------------------------


def byte_cuts(text: str, most: int = MOST_BYTES) -> Iterator[tuple[int, str]]:
    """(line breaks before, part) of at most `most` bytes each, cut between characters."""
    raw, at, line = text.encode("utf-8"), 0, 0
    while at < len(raw):
        end = min(at + most, len(raw))
        while at < end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        part = raw[at:end]
        yield line, part.decode("utf-8")
        line += part.count(b"\n")
        at = end


def bounded(start: int, end: int, content: str, symbol: str, capability: str) -> Iterator[Chunk]:
    """Chunks of a span within the byte limit: by lines of average width, a single line by bytes."""
    if len(content.encode("utf-8")) <= MOST_BYTES:
        if content.strip():
            yield Chunk(start, end, content, symbol, capability)
        return
    lines = content.split("\n")
    if len(lines) == 1:
        for _, part in byte_cuts(content):
            if part.strip():
                yield Chunk(start, start, part, symbol, capability)
        return
    step = max(1, MOST_BYTES // (len(content.encode("utf-8")) // len(lines) + 1))
    for at in range(0, len(lines), step):
        part = lines[at : at + step]
        yield from bounded(start + at, start + at + len(part) - 1, "\n".join(part), symbol, capability)


def windows(content: str, language: str, window: int = WINDOW, overlap: int = OVERLAP, doc_window: int = DOC_WINDOW) -> list[Chunk]:
    if not content.strip():
        return []
    lines = content.split("\n")
    if any(len(x.encode("utf-8")) > LONG_LINE for x in lines):
        out = []
        for before, part in byte_cuts(content):
            if part.strip():
                out.append(Chunk(before + 1, before + 1 + part.rstrip("\n").count("\n"), part))
        return out
    size = max(1, doc_window if language in DOC_LANGUAGES else window)
    step = size - (overlap if overlap < size else size // 2)
    out = []
    for at in range(0, len(lines), step):
        end = min(at + size, len(lines))
        out += bounded(at + 1, end, "\n".join(lines[at:end]), "", "fallback")
        if end == len(lines):
            break
    return out


def merge_small(spans: list[Span], lines: list[str]) -> list[Span]:
    """Neighbouring small declarations as one span up to the byte limit, named after its largest; functions
    stay on their own."""
    out: list[Span] = []
    size = largest = 0
    open_ = False
    for s in spans:
        n = sum(len(x.encode("utf-8")) + 1 for x in lines[s.start - 1 : s.end]) - 1
        if s.func or n >= SMALL_BYTES:
            out.append(s)
            open_ = False
        elif not open_ or size + n > MOST_BYTES:
            out.append(Span(s.start, s.end, s.symbol, False))
            size = largest = n
            open_ = True
        else:
            top = out[-1]
            top.end = max(top.end, s.end)
            if s.symbol and (not top.symbol or n > largest):
                top.symbol, largest = s.symbol, n
            size += n
    return out


# --- Python --------------------------------------------------------------------------------------


def python_spans(content: str) -> list[Span] | None:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = content.split("\n")
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)

    def first(node) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])

    def spans(body: list, prefix: str, floor: int) -> list[Span]:
        out, at = [], floor
        for node in body:
            start = _with_comments(lines, first(node), at, "#")
            end = node.end_lineno
            if isinstance(node, defs):
                out.append(Span(start, end, prefix + node.name, True))
            elif isinstance(node, ast.ClassDef):
                out += container(node, prefix, start)
            else:
                name = ""
                if isinstance(node, (ast.Assign, ast.AnnAssign)):
                    t = node.targets[0] if isinstance(node, ast.Assign) else node.target
                    name = t.id if isinstance(t, ast.Name) else ""
                out.append(Span(start, end, prefix + name if name and prefix else name))
            at = end + 1
        return out

    def container(node: ast.ClassDef, prefix: str, start: int) -> list[Span]:
        name, end = prefix + node.name, node.end_lineno
        if len("\n".join(lines[start - 1 : end]).encode("utf-8")) <= MOST_BYTES:
            return [Span(start, end, name, True)]
        members = [n for n in node.body if isinstance(n, (*defs, ast.ClassDef))]
        if not members:
            return [Span(start, end, name, True)]
        inner = spans(members, name + ".", node.lineno + 1)
        return [Span(start, max(start, inner[0].start - 1), name, True), *inner]

    return spans(tree.body, "", 1)


def _with_comments(lines: list[str], start: int, floor: int, *marks: str) -> int:
    while start > floor and lines[start - 2].strip().startswith(marks):
        start -= 1
    return start


# --- brace languages -----------------------------------------------------------------------------

_NAME = r"[A-Za-z_$][\w$]*"
_C_FUNC = rf"(?:^|[\s*&])(~?(?:{_NAME}::)*~?{_NAME}|operator\s*\S+)\s*\([^;{{}}]*\)[^;{{}}=]*$"
_METHOD = rf"({_NAME})\s*(?:<[^()]*>)?\s*\([^;{{}}]*\)[^;{{}}=]*$"
#: language: (containers, functions, other names, joint of member names)
GRAMMARS: dict[str, tuple[list[str], list[str], list[str], str]] = {
    "go": ([], [rf"^func\s+\(\s*(?:{_NAME}\s+)?\*?({_NAME})[^)]*\)\s*({_NAME})", rf"^func\s+({_NAME})"], [rf"^(?:type|var|const)\s+({_NAME})", r"^(?:type|var|const)\s*\(\s*(\w+)"], "."),
    "java": ([rf"\b(?:class|interface|enum|record|@interface)\s+({_NAME})"], [_METHOD], [], "."),
    "csharp": ([rf"\b(?:class|interface|enum|record|struct|namespace)\s+({_NAME}(?:\.{_NAME})*)"], [_METHOD], [rf"\bdelegate\s+\S+\s+({_NAME})", rf"({_NAME})\s*$"], "."),
    "kotlin": ([rf"\b(?:class|interface|object)\s+({_NAME})", r"\b(companion)\s+object"], [rf"\bfun\s+(?:<[^>]*>\s*)?(?:{_NAME}\.)?({_NAME})"], [rf"\b(?:val|var|typealias)\s+({_NAME})"], "."),
    "rust": ([rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:impl(?:<[^>]*>)?\s+)((?:[\w:]+(?:<[^>]*>)?\s+for\s+)?[\w:]+)", rf"\b(?:trait|mod)\s+({_NAME})"], [rf"\bfn\s+({_NAME})", rf"\bmacro_rules!\s*({_NAME})"], [rf"\b(?:struct|enum|union|type|const|static)\s+(?:mut\s+)?({_NAME})"], "::"),
    "c": ([r'(extern)\s+""'], [_C_FUNC], [rf"\b(?:struct|enum|union)\s+({_NAME})", rf"\btypedef\b.*?({_NAME})\s*$", rf"^#\s*define\s+({_NAME})"], "::"),
    "cpp": ([rf"\b(?:class|struct)\s+({_NAME})\s*(?:final\s*)?(?::[^;]*)?$", rf"\bnamespace\s+({_NAME}(?:::{_NAME})*)"], [_C_FUNC], [rf"\b(?:enum(?:\s+class)?|union|using)\s+({_NAME})", rf"\btypedef\b.*?({_NAME})\s*$"], "::"),
    "javascript": ([rf"\b(?:class|interface|namespace|module)\s+({_NAME})"], [rf"\bfunction\s*\*?\s*({_NAME})", rf"^(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+({_NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|{_NAME})\s*(?::[^=]+)?=>)", rf"^(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*({_NAME})\s*\([^;{{}}]*\)[^;{{}}=]*$"], [rf"\b(?:type|enum|const|let|var)\s+({_NAME})"], "."),
    "php": ([rf"\b(?:class|interface|trait|enum|namespace)\s+({_NAME}(?:\\{_NAME})*)"], [rf"\bfunction\s+&?\s*({_NAME})"], [rf"\bconst\s+({_NAME})"], "."),
}
GRAMMARS["typescript"] = GRAMMARS["javascript"]
#: Languages in which a line's end closes a declaration; a broken file of TOLERANT may still have some.
LINE_ENDS, TOLERANT = {"go", "kotlin", "javascript", "typescript"}, {"c", "cpp", "csharp", "kotlin"}
_TRANSPARENT = re.compile(r"\bnamespace\b|^\s*extern\b|\bmod\s")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "using", "lock", "synchronized"}


def blanked(text: str, language: str) -> str:
    """text with comments and strings blanked, of the same length and lines."""
    quotes = r'"(?:\\.|[^"\\\n])*"'
    single = r"|'(?:\\.|[^'\\\n])*'" if language not in ("rust",) else r"|'(?:\\.[^']*|[^'\\\n])'"
    extra = {"go": r"|`[^`]*`", "javascript": r"|`(?:\\.|[^`\\])*`", "typescript": r"|`(?:\\.|[^`\\])*`", "kotlin": r'|"""[\s\S]*?"""', "rust": r'|r(#*)"[\s\S]*?"\1', "csharp": r'|@"(?:""|[^"])*"', "php": r"|\#(?!\[)[^\n]*"}.get(language, "")
    head = extra[1:] + "|" if language in ("kotlin", "csharp", "rust") else ""
    tail = "" if head else extra
    token = re.compile(head + r"//[^\n]*|/\*[\s\S]*?\*/|" + quotes + single + tail)

    def blank(m: re.Match) -> str:
        s = m.group()
        inner = re.sub(r"[^\n]", " ", s)
        return '""' + inner[2:] if s[0] == '"' and len(s) >= 2 and "\n" not in s[:2] else inner

    return token.sub(blank, text)


def brace_spans(content: str, language: str) -> list[Span] | None:
    grammar = GRAMMARS[language]
    code = blanked(content, language)
    raw, lines = content.split("\n"), code.split("\n")
    depth = 0
    for c in code:
        depth += c in "{" and 1 or (c in "}" and -1 or 0)
        if depth < 0:
            break
    if depth != 0 and language not in TOLERANT:
        return None
    spans = _items(raw, lines, 1, len(lines), language, grammar, "")
    return spans if any(s.symbol for s in spans) else None


def _items(raw: list[str], lines: list[str], lo: int, hi: int, language: str, grammar, prefix: str) -> list[Span]:
    """Declarations in lines lo to hi, of which containers over the byte limit are opened."""
    out: list[Span] = []
    at = lo
    while at <= hi:
        if not lines[at - 1].strip() and not raw[at - 1].strip():
            at += 1
            continue
        start, depth, opened, first_open = at, 0, False, None
        code_seen = False
        while at <= hi:
            line = lines[at - 1]
            if line.strip().startswith("#") and language in ("c", "cpp", "csharp") and not code_seen:
                code_seen = True
                while line.rstrip().endswith("\\") and at < hi:
                    at += 1
                    line = lines[at - 1]
                break
            for c in line:
                if c in "{([":
                    depth += 1
                    if c == "{" and depth == 1 and not opened:
                        opened, first_open = True, at
                elif c in "})]":
                    depth -= 1
            code_seen = code_seen or bool(line.strip())
            body = line.rstrip()
            if depth <= 0 and code_seen and (body.endswith(";") or (opened and "}" in body) or (language in LINE_ENDS and not body.endswith((",", "=", "=>", "&&", "||", "+", ".", "(")) and not (at < hi and lines[at].strip().startswith(("{", ".", "?")))) or (language == "php" and not opened and body.strip() in ("<?php", "?>"))):
                break
            if not code_seen and at < hi and not raw[at].strip():
                break  # a comment of its own
            at += 1
        end = min(at, hi)
        out += _item(raw, lines, start, end, first_open, language, grammar, prefix)
        at = end + 1
    return out


def _item(raw, lines, start, end, first_open, language, grammar, prefix) -> list[Span]:
    containers, functions, others, joint = grammar
    text = "\n".join(lines[start - 1 : end])
    head = text[: text.find("{")] if first_open else text.rstrip().rstrip(";")
    head = re.sub(r"^\s*(?:#\[[^\]]*\]|@\w+(?:\([^)]*\))?)\s*", "", " ".join(head.split()))
    for p in containers:
        m = re.search(p, head)
        if m and first_open:
            name = m.group(1)
            clear = bool(_TRANSPARENT.search(head))
            full = prefix if name in ("extern",) else (prefix + name)
            if len("\n".join(raw[start - 1 : end]).encode("utf-8")) <= MOST_BYTES and not clear:
                return [Span(start, end, full, True)]
            inner = _items(raw, lines, first_open + 1, end - 1, language, grammar, "" if clear and language != "rust" else full + joint) if end - 1 > first_open else []
            if not inner:
                return [Span(start, end, full, True)]
            inner[-1].end = end
            return [Span(start, max(first_open, inner[0].start - 1), full, not clear), *inner]
    for p in functions:
        m = re.search(p, head)
        if m and m.groups()[-1] not in _NOT_CALLS:
            name = ".".join(g for g in m.groups() if g)
            return [Span(start, end, prefix + name, bool(first_open) or language in ("kotlin", "javascript", "typescript"))]
    for p in others:
        m = re.search(p, head)
        if m:
            return [Span(start, end, prefix + m.group(1))]
    return [Span(start, end)]


def ruby_spans(content: str) -> list[Span] | None:
    lines = content.split("\n")
    opens = re.compile(r"^(\s*)(class|module|def)\s+(?:(self)\.)?([\w:.?!=<]+)")

    def spans(lo: int, hi: int, prefix: str) -> list[Span] | None:
        out, at = [], lo
        while at <= hi:
            m = opens.match(lines[at - 1])
            if not m:
                if lines[at - 1].strip():
                    start = at
                    while at < hi and lines[at].strip() and not opens.match(lines[at]) and not lines[at].strip().startswith("#"):
                        at += 1
                    out.append(Span(start, at))
                at += 1
                continue
            start = _with_comments(lines, at, lo, "#")
            while out and out[-1].start >= start:
                out.pop()
            if out and out[-1].end >= start:
                out[-1].end = start - 1
            name = prefix + m.group(4)
            if re.search(r"\bend\s*$", lines[at - 1]):
                end = at
            else:
                end = next((i for i in range(at + 1, hi + 1) if re.match(rf"^{m.group(1)}end\b", lines[i - 1])), None)
                if end is None:
                    return None
            if m.group(2) == "def":
                out.append(Span(start, end, name, True))
            elif len("\n".join(lines[start - 1 : end]).encode("utf-8")) <= MOST_BYTES:
                out.append(Span(start, end, name, True))
            else:
                inner = spans(at + 1, end - 1, name + ("." if m.group(2) == "class" else "::"))
                if inner is None:
                    return None
                if inner:
                    inner[-1].end = end
                    out.append(Span(start, max(at, inner[0].start - 1), name, True))
                    out += inner
                else:
                    out.append(Span(start, end, name, True))
            at = end + 1
        return out

    found = spans(1, len(lines), "")
    return found if found and any(s.symbol for s in found) else None


def disjoint(spans: list[Span]) -> list[Span]:
    """Spans in order, those that overlap as one."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if s.end < s.start:
            continue
        if out and s.start <= out[-1].end:
            out[-1].end = max(out[-1].end, s.end)
            out[-1].symbol = out[-1].symbol or s.symbol
        else:
            out.append(s)
    return out


def split_file(path: str, content: str) -> list[Chunk]:
    """The chunks of a file; the same input always gives the same chunks."""
    language, content = language_of(path), content.replace("\r\n", "\n")
    if not content.strip():
        return []
    lines = content.split("\n")
    found = None
    if not any(len(x.encode("utf-8")) > LONG_LINE for x in lines):
        if language == "python":
            found = python_spans(content)
        elif language == "ruby":
            found = ruby_spans(content)
        elif language in GRAMMARS:
            found = brace_spans(content, language)
    if not found:
        return windows(content, language)
    out: list[Chunk] = []
    for s in merge_small(disjoint(found), lines):
        out += bounded(s.start, s.end, "\n".join(lines[s.start - 1 : s.end]), s.symbol, "ast")
    return out or windows(content, language)


def split(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, language, capability, start, end, symbol, content, content_hash, id) of all files. Rows stay in
    their partitions; a file with a null content has no chunk."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p is not None and c is not None:
                    rows += [(p, language_of(p), x.capability, x.start, x.end, x.symbol, x.content) for x in split_file(p, c)]
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return with_ids(files.select(path, content).mapInArrow(run, "path string, language string, capability string, start int, end int, symbol string, content string"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "language", "capability", "start", "end", "symbol", "content"]
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
