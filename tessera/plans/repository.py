"""A repository's model: files, directories, metadata, dependencies and frameworks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.manifests import ParserRegistry
from tessera.model import Repository, RepositorySource
from tessera.operators import code_graph
from tessera.operators.ast_facts import facts
from tessera.operators.dependencies import extract, manifests_of, matched_frameworks
from tessera.operators.metadata import language_histogram, repository_metadata
from tessera.rules import FRAMEWORKS, MANIFESTS, Framework
from tessera.sources.ingest import ingest
from tessera.sources.java_ast import ast_nodes
from tessera.sources.scan import RepositoryScanner, read_texts


@dataclass
class RepositoryModel:
    name: str
    path: str
    files: DataFrame
    directories: DataFrame
    metadata: DataFrame
    languages: DataFrame
    dependencies: DataFrame
    frameworks: DataFrame


@dataclass
class FrameworkDetector:
    """Frameworks of a file table; reads only the files that are manifests."""

    manifests: Sequence[Mapping[str, str]] = tuple(MANIFESTS)
    frameworks: Sequence[Framework] = tuple(FRAMEWORKS)
    registry: ParserRegistry | None = None

    def dependencies(self, files: DataFrame) -> DataFrame:
        """files: with path and name, and content where the texts are there already."""
        # The join by name stands before the read, so no other file is opened.
        texts = [c for c in ("content",) if c in files.columns]
        found = manifests_of(files.select("path", "name", *texts), self.manifests)
        return extract(found if texts else read_texts(found), self.registry)

    def detect(self, files: DataFrame) -> DataFrame:
        return matched_frameworks(self.dependencies(files), self.frameworks)


class RepositoryBuilder:
    def __init__(self, analyzer: Callable[[DataFrame, DataFrame], DataFrame] = repository_metadata, detector: FrameworkDetector | None = None) -> None:
        self.analyzer, self.detector = analyzer, detector or FrameworkDetector()

    def build(self, name: str, path: str, files: DataFrame, directories: DataFrame) -> RepositoryModel:
        files = files.cache()  # metadata, languages and manifests read it
        dependencies = self.detector.dependencies(files)
        return RepositoryModel(name, path, files, directories, self.analyzer(files, directories), language_histogram(files), dependencies, matched_frameworks(dependencies, self.detector.frameworks))


def discover(spark: SparkSession, source: RepositorySource | Repository, scanner: RepositoryScanner | None = None, builder: RepositoryBuilder | None = None) -> RepositoryModel:
    """From a source to its model; lazily, but for opening or cloning."""
    repository = source if isinstance(source, Repository) else ingest(source)
    files, directories = (scanner or RepositoryScanner(spark)).scan(repository)
    return (builder or RepositoryBuilder()).build(repository.name, repository.path, files, directories)


@dataclass
class CodeGraph:
    """facts by name; nodes: label and key; edges: type, src and dst."""

    facts: dict[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame


def graph_of(sources: DataFrame) -> CodeGraph:
    """The code graph of Java sources (path, content)."""
    found = facts(ast_nodes(sources), cache=True)
    return CodeGraph(found, code_graph.nodes(found), code_graph.EdgeBuilder(found).all())


def graph(spark: SparkSession, source: RepositorySource | Repository, scanner: RepositoryScanner | None = None) -> CodeGraph:
    """From a source to the graph of its Java files."""
    repository = source if isinstance(source, Repository) else ingest(source)
    files, _ = (scanner or RepositoryScanner(spark)).scan(repository)
    return graph_of(read_texts(files.where("extension = '.java' and not is_binary").select("path")))
