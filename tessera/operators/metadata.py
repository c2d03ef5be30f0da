"""Counts over a repository's files and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import FILE_CATEGORIES

FLAGS = ("binary", "large", "hidden", "symlink")


def category_counts(files: DataFrame) -> DataFrame:
    """One row: a count for each category."""
    return files.agg(*(F.count_if(F.col("category") == c).alias(f"{c}_files") for c in FILE_CATEGORIES))


def flag_counts(files: DataFrame) -> DataFrame:
    """One row: binary, large, hidden and symlink files."""
    return files.agg(*(F.count_if(F.col(f"is_{f}")).alias(f"{f}_files") for f in FLAGS))


def language_histogram(files: DataFrame) -> DataFrame:
    """Files of each language; null and empty languages don't count."""
    return files.where(F.coalesce("language", F.lit("")) != "").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def repository_metadata(files: DataFrame, directories: DataFrame) -> DataFrame:
    """One row: totals, counts of categories and flags, and the map of languages."""
    counts = files.agg(
        F.count(F.lit(1)).alias("total_files"),
        *(F.count_if(F.col("category") == c).alias(f"{c}_files") for c in FILE_CATEGORIES),
        *(F.count_if(F.col(f"is_{f}")).alias(f"{f}_files") for f in FLAGS),
    )
    total = directories.agg(F.count(F.lit(1)).alias("total_directories"))
    languages = language_histogram(files).agg(F.map_from_entries(F.collect_list(F.struct("language", "files"))).alias("languages"))
    return counts.crossJoin(total).crossJoin(languages)  # one row each
