"""Manifest parsers as columns: text to an array of distinct dependency names.

A text that can't be parsed has none.  JSON, requirements, Gradle and go.mod
texts are parsed by built-in functions; TOML and XML, which have none that
tolerate errors, by Arrow-batched functions.
"""

from __future__ import annotations

import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import split_lines, split_space, strip

Parser = Callable[[Column], Column]
_NONE = "array<string>"


def _names(c: Column) -> Column:
    return F.coalesce(F.array_distinct(c), F.array().cast(_NONE))


def normalize_python(c: Column) -> Column:
    """The name before an extra or a version."""
    bare = F.split(strip(c), r"\[")[0]
    return F.lower(strip(F.split(bare, "[<>=!~]")[0]))


def parse_json(c: Column) -> Column:
    """Keys of the four dependency sections; a section that isn't an object has none."""
    # A text without a closing is no JSON, though a path into it may still be found.
    sections = [F.json_object_keys(F.get_json_object(c, f"$.{k}")) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    whole = F.json_object_keys(c).isNotNull()
    return _names(F.when(whole, F.transform(F.flatten(F.array_compact(F.array(*sections))), F.lower)))


def parse_requirements(c: Column) -> Column:
    lines = F.transform(split_lines(c), strip)
    kept = F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("-r")))
    return _names(F.transform(kept, normalize_python))


def parse_gradle(c: Column) -> Column:
    """The part before the last of each quoted coordinate, from lower-cased text."""
    # Of the configuration names only these can occur in lower-cased text; longer ones end with them.
    found = F.regexp_extract_all(F.lower(c), F.lit(r"""(?:implementation|api)\s+["']([^"']+)"""), 1)
    parts = F.filter(F.transform(found, lambda s: F.split(s, ":")), lambda p: F.size(p) >= 2)
    return _names(F.transform(parts, lambda p: F.element_at(p, -2)))


def parse_gomod(c: Column) -> Column:
    """First words of the lines in `require (` blocks."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast(_NONE).alias("names"))

    def step(acc: Column, line: Column) -> Column:
        opens, closes = line == "require (", acc["inside"] & (line == ")")
        word = F.lower(F.try_element_at(split_space(line), F.lit(1)))
        takes = acc["inside"] & ~opens & ~closes & word.isNotNull()
        return F.struct((opens | (acc["inside"] & ~closes)).alias("inside"), F.when(takes, F.concat(acc["names"], F.array(word))).otherwise(acc["names"]).alias("names"))

    return _names(F.aggregate(F.transform(split_lines(c), strip), start, step)["names"])


def _by_python(read: Callable[[str], list[str]]) -> Parser:
    @F.pandas_udf(_NONE)
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else read(t))

    return lambda c: F.array_distinct(of(c))


def _pyproject(text: str) -> list[str]:
    try:
        project = tomllib.loads(text).get("project", {})
        listed = project.get("dependencies", []) if isinstance(project, dict) else []
    except tomllib.TOMLDecodeError:
        return []
    return [d for d in listed if isinstance(d, str)] if isinstance(listed, list) else []


def _cargo(text: str) -> list[str]:
    try:
        listed = tomllib.loads(text).get("dependencies", {})
    except tomllib.TOMLDecodeError:
        return []
    return [str(name).lower() for name in listed] if isinstance(listed, dict) else []


def _maven(text: str) -> list[str]:
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return []
    return [e.text.strip().lower() for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("artifactId") and e.text]


def parse_pyproject(c: Column) -> Column:
    return _names(F.transform(_by_python(_pyproject)(c), normalize_python))


def parse_cargo(c: Column) -> Column:
    return _by_python(_cargo)(c)


def parse_maven(c: Column) -> Column:
    return _by_python(_maven)(c)


class ParserRegistry:
    """Parsers by name; registering a name again replaces its parser."""

    def __init__(self) -> None:
        self._parsers: dict[str, Parser] = {"json": parse_json, "pyproject": parse_pyproject, "requirements": parse_requirements, "maven": parse_maven, "gradle": parse_gradle, "cargo": parse_cargo, "gomod": parse_gomod}

    def register(self, name: str, parser: Parser) -> None:
        """parser: from the column of texts to a column of arrays of names."""
        self._parsers[name] = parser

    def get(self, name: str) -> Parser | None:
        return self._parsers.get(name)

    def names(self) -> list[str]:
        return list(self._parsers)
