"""Dependencies from manifests, and the frameworks that they tell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.manifests import ParserRegistry
from tessera.rules import FRAMEWORKS, MANIFESTS, Framework, framework_table, manifest_table


def manifests_of(files: DataFrame, manifests: Sequence[Mapping[str, str]] = MANIFESTS, name_col: str = "name") -> DataFrame:
    """Rows of files whose name is a manifest's, case and all, with ecosystem and parser.  The definitions are rule data, a few rows."""
    defs = F.broadcast(manifest_table(files.sparkSession, manifests))
    return files.join(defs, F.col(name_col) == F.col("filename")).drop("filename")


def extract(manifests: DataFrame, registry: ParserRegistry | None = None, source_col: str = "path", content_col: str = "content") -> DataFrame:
    """name, ecosystem and source_file of each dependency: distinct within a manifest, all kept across them.

    Rows with an unknown parser or without content have none.
    """
    registry = registry or ParserRegistry()
    parts = []
    for name in registry.names():
        own = manifests.where((F.col("parser") == name) & F.col(content_col).isNotNull())
        names = registry.get(name)(F.col(content_col))
        parts.append(own.select(F.explode(names).alias("name"), "ecosystem", F.col(source_col).alias("source_file")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def matched_frameworks(dependencies: DataFrame, frameworks: Sequence[Framework] | DataFrame = FRAMEWORKS) -> DataFrame:
    """name of each framework that some dependency of its ecosystem tells, sorted.

    The definitions are the streamed side's small partner: distinct (ecosystem,
    name) pairs shrink the dependencies before the semi-join.
    """
    defs = frameworks if isinstance(frameworks, DataFrame) else framework_table(dependencies.sparkSession, frameworks)
    defs = defs.withColumnRenamed("ecosystem", "of_ecosystem")
    own = dependencies.select("ecosystem", F.lower("name").alias("dependency")).distinct()
    exact = F.array_contains("dependencies", F.col("dependency"))
    prefix = F.exists("dependency_prefixes", lambda p: F.startswith(F.col("dependency"), p))
    # Joined from the dependencies' side, so that what is broadcast is the rules.
    hit = own.join(F.broadcast(defs), (F.col("ecosystem") == F.col("of_ecosystem")) & (exact | prefix))
    return hit.select(F.col("name")).distinct().orderBy("name")
