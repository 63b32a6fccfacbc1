"""Rendering of a query's merged blocks (at most a few dozen rows) within a byte budget."""

from __future__ import annotations

from dataclasses import dataclass, field

NO_HITS = "No matching code found."
DEFAULT_BUDGET = 20_000


@dataclass
class Block:
    path: str
    start: int
    end: int
    content: str
    symbol: str = ""
    language: str = "text"
    score: float = 0.0


@dataclass
class Rendered:
    text: str
    hits: list[dict] = field(default_factory=list)
    candidate_blocks: int = 0
    shown_blocks: int = 0
    shown_files: int = 0
    truncated: bool = False


def parse_detail(value: str | None) -> str:
    v = (value or "").strip() or "full"
    if v not in ("full", "paths"):
        raise ValueError(f"detail must be full or paths, not {value!r}")
    return v


def header(b: Block) -> str:
    return f"## {b.path}:{b.start}-{b.end}" + (f" {b.symbol}" if b.symbol else "")


def section(b: Block, numbered: bool = False) -> str:
    body = b.content.rstrip("\n")
    if numbered:
        body = "\n".join(f"{b.start + i:6d}\t{x}" for i, x in enumerate(body.split("\n")))
    fence = "" if b.language in ("", "text") else b.language
    return f"{header(b)}\n```{fence}\n{body}\n```\n\n"


def marker(shown: int, total: int) -> str:
    return f"\n[output truncated by the budget: {shown} of {total} blocks shown; raise or omit it for all of them]\n"


def _size(s: str) -> int:
    return len(s.encode("utf-8"))


def render(blocks: list[Block], budget: int = 0, detail: str = "full", numbered: bool = False) -> Rendered:
    """Blocks in rank order. Every file's first block that fits comes before any file's second; the text keeps
    the rank order. A first block over the whole budget is cut between characters."""
    if not blocks:
        return Rendered(NO_HITS)
    budget = budget if budget > 0 else DEFAULT_BUDGET
    hits = [{"path": b.path, "start": b.start, "end": b.end, "symbol": b.symbol, "rank": i + 1, "shown": False} for i, b in enumerate(blocks)]
    parts = [header(b) + "\n" for b in blocks] if parse_detail(detail) == "paths" else [section(b, numbered) for b in blocks]
    truncated, left = False, budget
    if detail == "paths":
        for h, p in zip(hits, parts):
            if _size(p) > left:
                truncated = True
                break
            left -= _size(p)
            h["shown"] = True
    elif _size(parts[0]) > budget:
        hits[0]["shown"] = truncated = True
        parts[0] = parts[0].encode("utf-8")[:budget].decode("utf-8", "ignore")
    else:
        seen: set[str] = set()
        for first in (True, False):
            for b, h, p in zip(blocks, hits, parts):
                if h["shown"] or (b.path not in seen) != first:
                    continue
                if _size(p) > left:
                    truncated = True
                    continue
                left -= _size(p)
                h["shown"] = True
                seen.add(b.path)
    shown = [h["path"] for h in hits if h["shown"]]
    text = "".join(p for p, h in zip(parts, hits) if h["shown"])
    if truncated:
        text += marker(len(shown), len(blocks))
        if detail == "full":
            text += omitted(hits)
    return Rendered(text.rstrip("\n"), hits, len(blocks), len(shown), len(set(shown)), truncated)


def omitted(hits: list[dict], most: int = 10) -> str:
    shown, refs = {h["path"] for h in hits if h["shown"]}, {}
    for h in hits:
        if h["path"] not in shown:
            refs.setdefault(h["path"], f"{h['path']}:{h['start']}-{h['end']}")
    return "omitted files: " + ", ".join(list(refs.values())[:most]) + "\n" if refs else ""


def degraded_banner(reason: str) -> str:
    return f"[degraded: {reason}]\n\n" if reason else ""


def mode(dense: bool, reranked: bool) -> str:
    return ("hybrid" if dense else "lexical") + ("+rerank" if reranked else "")


def check_strict(strict: bool, reason: str, reranked: bool, rerank_expected: bool, candidates: int) -> None:
    if strict and (reason or (rerank_expected and not reranked and candidates)):
        raise RuntimeError(f"quality is strict and the answer is degraded: {reason or 'not reranked'}")
