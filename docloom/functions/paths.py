"""Path dialects and glob matching, resolved on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .semantics import UNSAFE_KEYS, is_unsafe


@dataclass(frozen=True)
class Index:
    """An array position in a path."""

    at: int


Segment = str | Index


def parse_extract(path: str) -> list[Segment]:
    """``a.b[0]["c.d"]``: dotted numbers are keys, bracketed ones positions."""
    out: list[Segment] = []
    for m in re.finditer(r"\[(\d+)\]|\[\"((?:[^\"\\]|\\.)*)\"\]|\['((?:[^'\\]|\\.)*)'\]|([^.\[\]]+)", path):
        position, double, single, bare = m.groups()
        out.append(Index(int(position)) if position is not None else next(x for x in (double, single, bare) if x is not None))
    return out


def split_path(path: str) -> list[str]:
    """Join dialect: dots between segments, ``[a.b]`` for a key with dots."""
    out, now, inside = [], "", False
    for c in path:
        if c == "[" and not inside:
            inside = True
            if now:
                out.append(now)
                now = ""
        elif c == "]" and inside:
            inside = False
            out.append(now)
            now = ""
        elif c == "." and not inside:
            if now:
                out.append(now)
                now = ""
        else:
            now += c
    return out + ([now] if now else [])


def join_path(*segments: str) -> str:
    return ".".join(f"[{s}]" if "." in s else s for s in segments if s != "")


def parent_path(path: str) -> str:
    return join_path(*split_path(path)[:-1])


def leaf_key(path: str) -> str:
    parts = split_path(path)
    return parts[-1] if parts else ""


def has_unsafe(path: str) -> bool:
    return any(is_unsafe(s) for s in split_path(path))


def is_valid(path: str) -> bool:
    return isinstance(path, str) and bool(path.strip()) and bool(split_path(path)) and not has_unsafe(path)


@dataclass(frozen=True)
class Star:
    """One child, any."""


@dataclass(frozen=True)
class Deep:
    """This node and all below."""


def parse_query(path: str) -> list[str | Index | Star | Deep]:
    """Query dialect: keys, ``[0]``, ``["k"]``, ``*``, ``[*]`` and ``**``. Unsafe keys are left out.

    A bracket that is not closed is an error.
    """
    out: list[str | Index | Star | Deep] = []
    i, n = 0, len(path)
    while i < n:
        if path[i] == ".":
            i += 1
        elif path[i] == "[":
            end = path.find("]", i)
            if end < 0:
                raise ValueError(f"unclosed bracket in path {path!r}")
            body = path[i + 1 : end].strip()
            if body == "*":
                out.append(Star())
            elif re.fullmatch(r"\d+", body):
                out.append(Index(int(body)))
            else:
                out.append(body.strip("\"'"))
            i = end + 1
        else:
            m = re.compile(r"[^.\[]+").match(path, i)
            word = m.group(0)
            i = m.end()
            out.append(Deep() if word == "**" else Star() if word == "*" and path[i : i + 1] != "[" else word)
    return [s for s in out if not (isinstance(s, str) and s in UNSAFE_KEYS)]


class Glob:
    """A compiled pattern: exact segments, ``*`` or ``[*]`` for one, ``**`` for none or more.

    A segment of ``None`` in a path stands for an array position not yet known;
    wildcards match it, names don't.
    """

    def __init__(self, pattern: str, ignore_case: bool = False):
        if not pattern or not pattern.strip():
            raise ValueError("empty pattern")
        self.pattern, self.fold = pattern, (str.lower if ignore_case else str)
        self.parts = tuple("*" if s == "*" else s if s == "**" else self.fold(s) for s in split_path(pattern))
        if any(is_unsafe(s) for s in self.parts):
            raise ValueError(f"unsafe pattern {pattern!r}")

    def matches(self, path: tuple[str | None, ...]) -> bool:
        reach = {0}
        for s in path:
            reach = self._closed(reach)
            nxt = set()
            for i in reach:
                if i < len(self.parts):
                    p = self.parts[i]
                    if p == "**":
                        nxt.add(i)
                    elif p == "*" or (s is not None and p == self.fold(s)):
                        nxt.add(i + 1)
            reach = nxt
        return len(self.parts) in self._closed(reach)

    def leads_to(self, path: tuple[str | None, ...]) -> bool:
        """Whether something below the path could match."""
        reach = {0}
        for s in path:
            reach = self._closed(reach)
            reach = {j for i in reach if i < len(self.parts) for j in ([i] if self.parts[i] == "**" else [i + 1] if self.parts[i] == "*" or (s is not None and self.parts[i] == self.fold(s)) else [])}
        return any(i < len(self.parts) for i in self._closed(reach))

    def _closed(self, reach: set[int]) -> set[int]:
        out = set(reach)
        for i in reach:
            while i < len(self.parts) and self.parts[i] == "**":
                i += 1
                out.add(i)
        return out

    @property
    def bare(self) -> bool:
        return len(self.parts) == 1


@lru_cache(maxsize=1024)
def glob(pattern: str, ignore_case: bool = False) -> Glob:
    return Glob(pattern, ignore_case)


def globs(patterns: list[str] | tuple[str, ...], ignore_case: bool = False) -> list[Glob]:
    """All patterns that compile; others are passed over with a warning."""
    import warnings

    out = []
    for p in patterns:
        try:
            out.append(glob(p, ignore_case))
        except ValueError as e:
            warnings.warn(str(e), stacklevel=2)
    return out


def any_matches(patterns: list[Glob], path: tuple[str | None, ...], key: str | None = None) -> bool:
    """Against the full path and, as bare names, the key."""
    return any(g.matches(path) or (key is not None and g.matches((key,))) for g in patterns)
