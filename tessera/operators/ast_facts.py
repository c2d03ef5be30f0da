"""Facts from syntax nodes.

An enclosing declaration is the last one seen before in the file, and is not
left again where it ends: members after a nested class belong to the nested one.
Facts share one window specification, so one sort by file and place serves all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_seen(value: Column, *types: str) -> Column:
    """The last value up to here in the file at a node of these types that has one."""
    before = Window.partitionBy("file").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(F.col("type").isin(*types), value), ignorenulls=True).over(before)


def scoped(nodes: DataFrame) -> DataFrame:
    """nodes with package, class, type (class or interface) and method in scope; as they are, if they have these."""
    if "in_package" in nodes.columns:
        return nodes
    name = F.col("name")
    return nodes.withColumns(
        {
            "in_package": last_seen(name, "package_declaration"),
            "in_class": last_seen(name, "class_declaration"),
            "in_type": last_seen(name, "class_declaration", "interface_declaration"),
            "in_method": last_seen(name, "method_declaration"),
        }
    )


def _named(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where((F.col("type") == kind) & F.col("name").isNotNull())


def packages(nodes: DataFrame) -> DataFrame:
    return _named(nodes, "package_declaration").select("file", "pre", "name")


def imports(nodes: DataFrame) -> DataFrame:
    return _named(nodes, "import_declaration").select("file", "pre", "name")


def classes(nodes: DataFrame) -> DataFrame:
    return _named(scoped(nodes), "class_declaration").select("file", "pre", F.col("in_package").alias("package"), "name")


def interfaces(nodes: DataFrame) -> DataFrame:
    return _named(scoped(nodes), "interface_declaration").select("file", "pre", F.col("in_package").alias("package"), "name")


def methods(nodes: DataFrame) -> DataFrame:
    return _named(scoped(nodes), "method_declaration").select("file", "pre", F.col("in_type").alias("parent"), "name")


def fields(nodes: DataFrame) -> DataFrame:
    return _named(scoped(nodes), "field_declaration").select("file", "pre", F.col("in_class").alias("parent"), "name")


def calls(nodes: DataFrame) -> DataFrame:
    return _named(scoped(nodes), "method_invocation").select("file", "pre", F.col("in_class").alias("caller_parent"), F.col("in_method").alias("caller"), F.lit(None).cast("string").alias("callee_parent"), F.col("name").alias("callee"))


def creations(nodes: DataFrame) -> DataFrame:
    """The owner is the last method of the file, if there is one, else the class."""
    inside = F.col("in_method").isNotNull()
    return _named(scoped(nodes), "object_creation_expression").select(
        "file",
        "pre",
        F.col("in_class").alias("owner_parent"),
        F.coalesce("in_method", "in_class").alias("owner_name"),
        F.when(inside, "method").otherwise("class").alias("owner_type"),
        F.col("name").alias("object_type"),
    )


def extends(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "class_declaration") & F.col("superclass").isNotNull()).select("file", "pre", F.col("name").alias("child_class"), F.col("superclass").alias("parent_class"))


def implements(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "class_declaration") & F.col("name").isNotNull()).select("file", "pre", F.col("name").alias("class_name"), F.explode("interfaces").alias("interface_name"))


#: Fact tables by name; a user may add builders of their own.
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "packages": packages,
    "imports": imports,
    "classes": classes,
    "interfaces": interfaces,
    "methods": methods,
    "fields": fields,
    "calls": calls,
    "creations": creations,
    "extends": extends,
    "implements": implements,
}


def register_builder(name: str, builder: Callable[[DataFrame], DataFrame]) -> None:
    BUILDERS[name] = builder


def facts(nodes: DataFrame, cache: bool = False) -> dict[str, DataFrame]:
    """All fact tables.  With cache, scopes are found once for all of them, as a whole graph wants."""
    if cache:
        nodes = scoped(nodes).cache()
    return {name: builder(nodes) for name, builder in BUILDERS.items()}
