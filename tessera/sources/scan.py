"""Scan of a repository as a data source: a row for each directory, file and error.

A directory is listed with its entries sorted by name: its directories first,
then its files, then what is below each directory.  Ignored directories are
never opened.  Without limits each directory at the top is a partition of its
own; with limits one task walks in order, and stops at the first event that
goes beyond one.

Directories that can't be read and files without metadata become error rows.
Linked directories are skipped unless they are to be followed; then those that
lead to a directory that is open already are skipped, with a row of kind cycle.
Where a limit ends a scan, a row of kind limit says which.  Linked files are kept,
with the link's own size.  Hidden and empty files are kept.
"""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.classify import HEAD_BYTES, category, is_binary, is_large
from tessera.functions.language import detect, with_language
from tessera.functions.text import extension, is_hidden
from tessera.model import DIRECTORIES, FILES, Repository, ScanLimits
from tessera.rules import CLASSIFICATION
from tessera.sources.ignore import IgnoreRules

logger = logging.getLogger("tessera")

_SCHEMA = "kind string, path string, relative_path string, name string, size long, is_symlink boolean, head binary, message string"


class _Stop(Exception):
    """A limit is reached: its name, and the path that would go beyond it."""


class _Walk:
    def __init__(self, root: str, rules: IgnoreRules, follow: bool, limits: ScanLimits, heads: bool = True) -> None:
        self.root, self.rules, self.follow, self.limits, self.heads = root, rules, follow, limits, heads
        self.files = self.directories = self.bytes = 0

    def _relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _notice(self, kind: str, path: str, message: str) -> tuple:
        return (kind, path, self._relative(path), os.path.basename(path), None, None, None, message)

    def _error(self, path: str, error: OSError) -> tuple:
        return self._notice("error", path, str(error))

    def _head(self, path: str) -> bytes | None:
        if not self.heads:
            return None
        try:
            with open(path, "rb") as f:
                return f.read(HEAD_BYTES)
        except OSError:
            return None

    def _enters(self, path: str, real_above: frozenset[str]) -> bool | None:
        """Whether a directory is listed and walked; None if it leads back to one that is open."""
        if self.rules.ignores(self._relative(path)):
            return False
        if not os.path.islink(path):
            return True
        if not self.follow:
            return False
        try:
            return None if os.path.realpath(path, strict=True) in real_above else True
        except OSError:
            return False

    def listed(self, path: str, real_above: frozenset[str]) -> tuple[list[str], list[str], list[tuple]]:
        """Directories to walk and file paths of a directory, and rows for its error and for links that lead back."""
        try:
            with os.scandir(path) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            return [], [], [self._error(path, e)]
        is_dir = {e.path: _is_dir(e) for e in found}
        enters = {p: self._enters(p, real_above) for p, directory in is_dir.items() if directory}
        notices = [self._notice("cycle", p, f"leads to {os.path.realpath(p)}") for p, x in enters.items() if x is None]
        return [p for p, x in enters.items() if x], [e.path for e in found if not is_dir[e.path] and not self.rules.ignores(self._relative(e.path))], notices

    def rows(self, top: str, below: bool, real_above: frozenset[str]) -> Iterator[tuple]:
        todo = [(top, real_above)]
        try:
            while todo:
                path, above = todo.pop()
                inside = above | {os.path.realpath(path)}
                dirs, files, notices = self.listed(path, inside)
                yield from notices
                for d in dirs:
                    if self.limits.max_directories is not None and self.directories >= self.limits.max_directories:
                        raise _Stop("max_directories", d)
                    self.directories += 1
                    yield ("directory", d, self._relative(d), os.path.basename(d), None, os.path.islink(d), None, None)
                for f in files:
                    yield from self._file(f)
                if below:
                    todo += [(d, inside) for d in reversed(dirs)]
        except _Stop as stop:
            limit, path = stop.args
            logger.warning("scan of %s ends at %s: %s", self.root, path, limit)
            yield self._notice("limit", path, f"{limit}={getattr(self.limits, limit)}")

    def _file(self, path: str) -> Iterator[tuple]:
        try:
            own = os.lstat(path)
        except OSError as e:
            yield self._error(path, e)
            return
        if self.limits.max_files is not None and self.files >= self.limits.max_files:
            raise _Stop("max_files", path)
        if self.limits.max_total_size is not None and self.bytes + own.st_size > self.limits.max_total_size:
            raise _Stop("max_total_size", path)
        self.files += 1
        self.bytes += own.st_size
        yield ("file", path, self._relative(path), os.path.basename(path), own.st_size, stat.S_ISLNK(own.st_mode), self._head(path), None)


def _is_dir(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir()
    except OSError:
        return False


class _Part(InputPartition):
    def __init__(self, top: str, below: bool) -> None:
        self.top, self.below = top, below


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        number = lambda k: int(options[k]) if options.get(k) else None
        self.root = os.path.abspath(options["path"])
        self.rules = IgnoreRules.of_json(options["rules"]) if options.get("rules") else IgnoreRules(options.get("ignore", "").split("\n"))
        self.heads = options.get("heads", "true").lower() == "true"
        self.follow = options.get("followSymlinks", "false").lower() == "true"
        self.limits = ScanLimits(None, number("maxFiles"), number("maxDirectories"), number("maxTotalSize"))

    def _walk(self) -> _Walk:
        return _Walk(self.root, self.rules, self.follow, self.limits, self.heads)

    def partitions(self) -> Sequence[InputPartition]:
        if any(x is not None for x in (self.limits.max_files, self.limits.max_directories, self.limits.max_total_size)):
            return [_Part(self.root, True)]
        above = frozenset({os.path.realpath(self.root)})
        return [_Part(self.root, False), *(_Part(d, True) for d in self._walk().listed(self.root, above)[0])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        above = frozenset() if partition.top == self.root else frozenset({os.path.realpath(self.root)})
        return self._walk().rows(partition.top, partition.below, above)


class RepositoryDataSource(DataSource):
    """Format `repository`; options: path, ignore (lines) or rules (of IgnoreRules.to_json), followSymlinks, heads (false: files aren't opened), maxFiles, maxDirectories, maxTotalSize."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class RepositoryScanner:
    """Scans repositories into files, directories and errors; each part can be replaced."""

    def __init__(
        self,
        spark: SparkSession,
        ignore_patterns: Sequence[str] = (),
        follow_symlinks: bool = False,
        detector: Callable[[str], str | None] = detect,
        rules: Mapping[str, Mapping[str, Sequence[str]]] = CLASSIFICATION,
        limits: ScanLimits | None = None,
        classify_absolute: bool = False,
        classifier: Callable[[Column, Column, Column], Column] | None = None,
        ignore_rules: IgnoreRules | None = None,
    ) -> None:
        """classify_absolute: directories above the repository tell categories too.

        classifier: from path, language and binary flag to the category, in place of the rules.
        ignore_rules: in place of the repository's ignore file and ignore_patterns.
        """
        self.classifier = classifier or (lambda path, language, binary: category(path, language, binary, rules))
        self.ignore_rules = ignore_rules
        self.spark, self.ignore_patterns, self.follow, self.detector = spark, list(ignore_patterns), follow_symlinks, detector
        self.limits, self.classify_absolute = limits or ScanLimits(), classify_absolute

    def events(self, repository: Repository, heads: bool = True) -> DataFrame:
        """Rows of kind file, directory, error, cycle and limit.  Without heads no file is opened, and none is known to be binary."""
        self.spark.dataSource.register(RepositoryDataSource)
        rules = self.ignore_rules or IgnoreRules.of_repository(repository.path, self.ignore_patterns)
        reader = self.spark.read.format("repository").option("path", str(repository.path)).option("rules", rules.to_json()).option("followSymlinks", str(self.follow).lower()).option("heads", str(heads).lower())
        for name, value in (("maxFiles", self.limits.max_files), ("maxDirectories", self.limits.max_directories), ("maxTotalSize", self.limits.max_total_size)):
            if value is not None:
                reader = reader.option(name, str(value))
        return reader.load()

    def scan(self, repository: Repository) -> tuple[DataFrame, DataFrame]:
        """files and directories."""
        return self.files(self.events(repository)), self.directories(self.events(repository, heads=False))

    def files(self, events: DataFrame) -> DataFrame:
        found = events.where("kind = 'file'").withColumns({"extension": extension(F.col("name")), "is_hidden": is_hidden(F.col("name")), "is_binary": is_binary(F.col("head")), "is_large": is_large(F.col("size"), self.limits.max_file_size)}).drop("head")
        found = with_language(found, self.detector)
        judged = F.col("path" if self.classify_absolute else "relative_path")
        return found.withColumn("category", self.classifier(judged, F.col("language"), F.col("is_binary"))).select(*FILES.names)

    def directories(self, events: DataFrame) -> DataFrame:
        return events.where("kind = 'directory'").withColumn("is_hidden", is_hidden(F.col("name"))).select(*DIRECTORIES.names)

    def errors(self, events: DataFrame) -> DataFrame:
        """What could not be read, and why."""
        return events.where("kind = 'error'").select("path", "relative_path", "message")

    def notices(self, events: DataFrame) -> DataFrame:
        """What cut the scan: links that lead back (cycle) and the limit that ended it."""
        return events.where("kind in ('cycle', 'limit')").select("kind", "path", "relative_path", "message")


def read_texts(files: DataFrame) -> DataFrame:
    """files with the column content: each file's text, null if it can't be read or isn't UTF-8.

    Files are read by path where the tasks run; filter the rows first.
    """

    @F.pandas_udf("string")
    def of(paths: pd.Series) -> pd.Series:
        def read(path: str) -> str | None:
            try:
                return Path(path).read_text(encoding="utf-8")
            except (OSError, UnicodeDecodeError) as e:
                logger.warning("unreadable file %s: %s", path, e)
                return None

        return paths.map(read).astype(object)

    return files.withColumn("content", of(F.col("path")))
