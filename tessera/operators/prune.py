"""Ignore rules on tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.ignore import IgnoreRules


def kept(paths: DataFrame, rules: IgnoreRules, path_col: str = "relative_path") -> DataFrame:
    """Rows whose own path no rule ignores."""
    return paths.where(~rules.column(F.col(path_col)))


def ancestors(path: Column) -> Column:
    """Paths of the directories above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def pruned(paths: DataFrame, rules: IgnoreRules, path_col: str = "relative_path") -> DataFrame:
    """Rows that a walk reaches: neither they nor a directory above them is ignored, whatever a later pattern says of the row."""
    path = F.col(path_col)
    above = F.when(F.contains(path, F.lit("/")), F.exists(ancestors(path), lambda p: rules.column(p))).otherwise(F.lit(False))
    return paths.where(~rules.column(path) & ~above)
