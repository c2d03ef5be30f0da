"""Ignore patterns, compiled to regular expressions that Java and Python read alike."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Always ignored.
ALWAYS = (".git", ".git/**")


@dataclass(frozen=True)
class Pattern:
    regex: str
    ignores: bool


def _segment(text: str) -> str:
    """A path segment with wildcards, as a regular expression."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out += re.escape(text[i + 1])
            i += 2
            continue
        end = text.find("]", i + 2 + (text[i + 1 : i + 2] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
            while text[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            inner = text[i + 1 : end]
            negated = inner[0] in "!^"
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", inner[1:] if negated else inner)
            out += f"[^/{body}]" if negated else f"[{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_pattern(line: str) -> Pattern | None:
    """A line of an ignore file; None for a blank line, a comment or a lone slash."""
    text = line.rstrip("\r\n")
    while text.endswith((" ", "\t")) and not text.endswith(("\\ ", "\\\t")):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    ignores = not text.startswith("!")
    if not ignores:
        text = text[1:]
    parts = text.split("/")
    if not any(parts):
        return None
    if parts[0] == "":
        parts = parts[1:]
    elif len([p for p in parts if p]) == 1 and "/" not in text.rstrip("/"):
        parts = ["**", *parts]
    if parts[-1] == "":
        parts[-1] = "**"  # a directory pattern: what is below it
    out = ""
    for i, part in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        if part == "**":
            if first and last:
                out = ".+"
            elif first:
                out = "(?:.+/)?"
            elif last:
                out += "/.*"
            else:
                out += "(?:/.+)?"
            continue
        before = "" if first or (i == 1 and parts[0] == "**") else "/"
        out += before + _segment(part)
        if last:
            out += "(?:/.*)?"
    return Pattern(f"^{out}$", ignores)


class IgnoreRules:
    """The last pattern that fits a path decides; paths are relative, with slashes and none at the end.

    So a pattern for a directory alone, such as `build/`, fits what is below the
    directory and not the directory itself.
    """

    def __init__(self, lines: Iterable[str] = (), custom: Sequence[str] | None = None) -> None:
        self.patterns = [p for line in (*ALWAYS, *lines, *(custom or ())) if (p := compile_pattern(line))]

    @classmethod
    def of_repository(cls, root: str | Path, custom: Sequence[str] | None = None) -> IgnoreRules:
        """Reads the ignore file at the root; those below are not read."""
        file = Path(root) / ".gitignore"
        return cls(file.read_text(encoding="utf-8", errors="replace").splitlines() if file.is_file() else (), custom)

    @cached_property
    def _compiled(self) -> list[tuple[re.Pattern[str], bool]]:
        return [(re.compile(p.regex, re.DOTALL), p.ignores) for p in self.patterns]

    def ignores(self, path: str) -> bool:
        return next((ignores for regex, ignores in reversed(self._compiled) if regex.match(path)), False)

    def column(self, path: Column) -> Column:
        """The same for a column of paths."""
        out = F.lit(False)
        for p in self.patterns:  # later patterns stand outside, so they decide
            out = F.when(path.rlike(f"(?s){p.regex}"), F.lit(p.ignores)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def to_json(self) -> str:
        return json.dumps([(p.regex, p.ignores) for p in self.patterns])

    @classmethod
    def of_json(cls, text: str) -> IgnoreRules:
        own = cls.__new__(cls)
        own.patterns = [Pattern(regex, ignores) for regex, ignores in json.loads(text)]
        return own

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns}
