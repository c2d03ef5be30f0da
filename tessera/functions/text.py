"""String and path functions whose results equal those of the Python functions of the same purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.splitlines() splits at.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: What str.strip() strips.
_SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def split_lines(c: Column) -> Column:
    """One empty element more at the end than splitlines() when the text ends with a break."""
    return F.split(c, LINE_BREAK)


def split_space(c: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(c, rf"{_SPACE}+"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """The last suffix with its dot; empty for names like `.env`, and for a trailing dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def relative_to(path: Column, root: str) -> Column:
    return F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)


def decoded(content: Column) -> Column:
    """The text of UTF-8 bytes; null if they are none."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)
