"""Byte-level BPE ids of whole texts, made fast by remembering the ids of space-separated units.

The pre-tokenizer of the vocabulary always breaks before a single space that stands between two
characters that aren't white space, and around single newlines, so the ids of a text are those of its
units put together. Texts where that could fail (runs of spaces, other white space, three newlines)
are encoded in one piece. The ids equal those of the `tokenizers` file of the same vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOD = 50256
_RISKY = re.compile(r"  | \n|\n |\n\n\n|\n\n$|^ |^\n| $|[^\S \n]|<\|endoftext\|>|[\ud800-\udfff]")
#: Units that a Python worker remembers; those met later are encoded each time.
REMEMBERED = 300_000
_MADE: dict[tuple[str, bool], "FastBpe"] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class FastBpe:
    """encode(text) gives the ids as uint32. special: the end-of-text marker's own string becomes its id
    (as the tokenizers file does by default); otherwise it is ordinary text."""

    def __init__(self, path: str, special: bool):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": EOD})
        self.special = special
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str, special: bool) -> "FastBpe":
        if (path, special) not in _MADE:
            _MADE[path, special] = cls(path, special)
        return _MADE[path, special]

    def _whole(self, text: str) -> bytes:
        ids = self.enc.encode(text, allowed_special="all") if self.special else self.enc.encode_ordinary(text)
        return np.array(ids, dtype=np.uint32).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _RISKY.search(text):
            return self._whole(text)
        units = text.replace("\n", " \n").split(" ")
        found = list(map(self.known.get, units))
        found[0] = self._whole(units[0])  # the only unit without a space before it
        if None in found:
            plain, room = self.enc.encode_ordinary, REMEMBERED - len(self.known)
            for i, ids in enumerate(found):
                if ids is None:
                    u = units[i]
                    ids = self.known.get(u)
                    if ids is None:
                        ids = np.array(plain(u if u[0] == "\n" else " " + u), dtype=np.uint32).tobytes()
                        if room > 0:
                            self.known[u] = ids
                            room -= 1
                    found[i] = ids
        return b"".join(found)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")
