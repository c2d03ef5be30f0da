"""Schemas and domains of the tables that the engine reads and returns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

_field = T.StructField
_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


class SourceType(str, Enum):
    LOCAL = "local"
    GIT = "git"


@dataclass(frozen=True)
class RepositorySource:
    """Where a repository comes from; a driver-side option object."""

    source_type: SourceType | str
    location: str
    branch: str | None = None
    shallow: bool = False


@dataclass(frozen=True)
class Repository:
    name: str
    path: str
    source: RepositorySource


@dataclass(frozen=True)
class ScanLimits:
    """None is unlimited."""

    max_file_size: int | None = None
    max_files: int | None = None
    max_directories: int | None = None
    max_total_size: int | None = None


#: The categories of files.
FILE_CATEGORIES = ("source", "configuration", "documentation", "test", "asset", "generated", "build", "unknown")

#: The kinds of the generic code model.
ENTITY_KINDS = tuple(
    "repository package module class interface struct trait enum function method constructor field variable parameter "
    "import export component endpoint database_model orm_relationship configuration annotation decorator".split()
)
RELATIONSHIP_KINDS = tuple(
    "contains imports exports inherits implements extends composes uses depends_on calls has_field has_method has_parameter "
    "returns accepts decorated_by annotated_with exposes handled_by maps_to relates_to configures".split()
)

FILES = T.StructType(
    [*(_field(c, _S) for c in ("path", "relative_path", "name", "extension")), _field("size", _L), *(_field(c, _B) for c in ("is_hidden", "is_symlink", "is_binary", "is_large")), _field("language", _S), _field("category", _S)]
)
DIRECTORIES = T.StructType([_field("path", _S), _field("relative_path", _S), _field("name", _S), _field("is_hidden", _B)])
DEPENDENCIES = T.StructType([_field("name", _S), _field("ecosystem", _S), _field("source_file", _S)])
AST_NODES = T.StructType([_field("file", _S), _field("pre", _L), _field("type", _S), _field("name", _S), _field("superclass", _S), _field("interfaces", T.ArrayType(_S))])
SOURCE_LOCATION = T.StructType([_field("file", _S), _field("start_line", T.IntegerType()), _field("end_line", T.IntegerType()), _field("start_column", T.IntegerType()), _field("end_column", T.IntegerType())])
ENTITIES = T.StructType([*(_field(c, _S) for c in ("id", "kind", "name", "qualified_name")), _field("location", SOURCE_LOCATION), _field("language", _S), _field("metadata", T.MapType(_S, _S))])
RELATIONSHIPS = T.StructType([*(_field(c, _S) for c in ("source_id", "target_id", "kind")), _field("metadata", T.MapType(_S, _S))])
