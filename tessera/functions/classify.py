"""Projections of a file row: binary, large, category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import file_name
from tessera.rules import CLASSIFICATION, rule_part

#: Bytes that tell whether a file is binary.
HEAD_BYTES = 8192


def is_binary(head: Column) -> Column:
    """Whether there is a NUL in the first bytes; false for empty or unreadable files."""
    return F.coalesce(F.contains(F.substring(head, 1, HEAD_BYTES), F.lit(b"\x00")), F.lit(False))


def is_large(size: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(size > F.lit(limit), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def matches(path: Column, category: str, rules: Mapping[str, Mapping[str, Sequence[str]]] = CLASSIFICATION) -> Column:
    """Whether a path fits any rule of a category.  The file's own name counts as a directory too."""
    low = F.lower(path)
    name = file_name(low)
    values = {p: rule_part(rules, category, p) for p in ("filenames", "directories", "filename_contains", "filename_prefixes", "filename_suffixes")}
    tests = []
    if values["filenames"]:
        tests.append(name.isin(values["filenames"]))
    if values["directories"]:
        tests.append(F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, values["directories"]))))
    tests += [F.contains(name, F.lit(v)) for v in values["filename_contains"]]
    tests += [F.startswith(name, F.lit(v)) for v in values["filename_prefixes"]]
    tests += [F.endswith(name, F.lit(v)) for v in values["filename_suffixes"]]
    return _any(tests)


def category(path: Column, language: Column, binary: Column, rules: Mapping[str, Mapping[str, Sequence[str]]] = CLASSIFICATION) -> Column:
    """The first that fits: generated, build, asset (binary), documentation, test, configuration, source (has a language), unknown."""
    out = F.when(matches(path, "generated", rules), "generated").when(matches(path, "build", rules), "build").when(binary, "asset")
    for name in ("documentation", "test", "configuration"):
        out = out.when(matches(path, name, rules), name)
    return out.when(language.isNotNull(), "source").otherwise("unknown")
