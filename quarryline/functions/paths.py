"""Workspace roots as they are given on different systems."""

from __future__ import annotations

import os
import re


def expand_user(path: str, env: dict | None = None) -> str:
    """~ and $NAME, ${NAME} or %NAME% by the environment; unknown names stay."""
    env = os.environ if env is None else env
    if path == "~" or path.startswith(("~/", "~\\")):
        path = env.get("HOME", "~") + path[1:]
    sub = lambda m: env.get(next(g for g in m.groups() if g), m.group())
    return re.sub(r"\$\{(\w+)\}|\$(\w+)|%(\w+)%", sub, path)


def resolve_root(path: str, os_name: str = "linux") -> tuple[str, str]:
    """(canonical path, kind) of an absolute root: posix, wsl or windows. A drive of Windows seen from Linux is
    /mnt/<drive>; /mnt/<drive> seen from Windows is the drive; a path relative to a drive is an error."""
    p = path.strip()
    if not p:
        raise ValueError("empty workspace root")
    drive = re.match(r"^([A-Za-z]):(.*)$", p, re.S)
    if drive:
        rest = drive.group(2).replace("\\", "/")
        if not rest.startswith("/"):
            raise ValueError(f"path relative to a drive: {path!r}")
        rest = _clean(rest)
        if os_name == "windows":
            return f"{drive.group(1).upper()}:{rest.replace('/', chr(92))}", "windows"
        return _clean(f"/mnt/{drive.group(1).lower()}{rest}"), "wsl"
    mounted = re.match(r"^/mnt/([A-Za-z])(/.*)?$", p)
    if mounted:
        rest = _clean(mounted.group(2) or "/")
        if os_name == "windows":
            return f"{mounted.group(1).upper()}:{rest.replace('/', chr(92))}", "windows"
        return _clean(f"/mnt/{mounted.group(1).lower()}{rest}"), "wsl"
    if not p.startswith("/"):
        raise ValueError(f"workspace root must be absolute: {path!r}")
    return _clean(p), "posix"


def _clean(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)
