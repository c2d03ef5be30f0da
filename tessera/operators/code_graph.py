"""Nodes and edges of the code graph, from fact tables.

Nodes are the distinct keys.  Edges join by bare names, as facts know no
packages: a name that several classes share ties to all of them.  A null never
joins.  Both sides of a join are distinct first, so an edge's multiplicity in
the sources makes no rows; hot names are left to adaptive skew handling.

By default edges are made over all files at once.  With incremental=True a fact
sees only what its own and earlier files declare (columns file_idx of the facts).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Facts = Mapping[str, DataFrame]

NODE_KEYS = {"Package": ("packages", ("name",)), "Class": ("classes", ("package", "name")), "Interface": ("interfaces", ("package", "name")), "Method": ("methods", ("parent", "name")), "Field": ("fields", ("parent", "name"))}


def node_keys(facts: Facts, label: str, strict_null_keys: bool = False) -> DataFrame:
    """Distinct keys of a label.  With strict_null_keys a null in one fails the job; else such a node stays and joins nothing."""
    table, keys = NODE_KEYS[label]
    out = facts[table].select(*keys).distinct()
    if strict_null_keys:
        has_null = F.lit(False)
        for k in keys:
            has_null = has_null | F.col(k).isNull()
        checked = F.when(has_null, F.raise_error(F.lit(f"null in the key of a {label} node"))).otherwise(F.col(keys[-1]))
        out = out.select(*(F.col(k) for k in keys[:-1]), checked.alias(keys[-1]))
    return out


def nodes(facts: Facts, strict_null_keys: bool = False) -> DataFrame:
    """label and key (scope, name); a package has no scope."""
    out = None
    for label, (_, keys) in NODE_KEYS.items():
        own = node_keys(facts, label, strict_null_keys)
        scope = F.col(keys[0]) if len(keys) == 2 else F.lit(None).cast("string")
        own = own.select(F.lit(label).alias("label"), F.struct(scope.alias("scope"), F.col("name")).alias("key"))
        out = own if out is None else out.unionByName(own)
    return out


class EdgeBuilder:
    """Edge tables with flat key columns; all() gives them in one shape."""

    def __init__(self, facts: Facts, incremental: bool = False) -> None:
        self.facts, self.incremental = facts, incremental

    def _nodes(self, label: str, prefix: str) -> DataFrame:
        """Keys of a label as <prefix>_<key>; incremental: with the first file that has each."""
        table, keys = NODE_KEYS[label]
        named = [F.col(k).alias(f"{prefix}_{k}") for k in keys]
        own = self.facts[table]
        if not self.incremental:
            return own.select(*named).distinct()
        return own.groupBy(*named).agg(F.min("file_idx").alias(f"{prefix}_seen"))

    def _facts(self, table: str, *columns: str) -> DataFrame:
        return self.facts[table].select(*columns, *(["file_idx"] if self.incremental else [])).distinct()

    def _seen(self, *prefixes: str) -> Column:
        out = F.lit(True)
        for p in prefixes if self.incremental else ():
            out = out & (F.col(f"{p}_seen") <= F.col("file_idx"))
        return out

    def _contains(self, label: str, prefix: str) -> DataFrame:
        # Packages and types of a file meet where the type's package is the package.
        file = ["file", "file_idx"] if self.incremental else ["file"]
        packages = self.facts["packages"].select(F.col("name").alias("package_name"), *file).distinct()
        own = self.facts[NODE_KEYS[label][0]].select(F.col("package").alias(f"{prefix}_package"), F.col("name").alias(f"{prefix}_name"), F.col("file").alias("of_file")).distinct()
        # Any type of that name in the file is tied to the node that the package names.
        names = own.select("of_file", F.col(f"{prefix}_name").alias("wanted")).distinct()
        met = packages.join(names, F.col("file") == F.col("of_file"))
        made = self._nodes(label, prefix)
        joined = met.join(made, (F.col("package_name") == F.col(f"{prefix}_package")) & (F.col("wanted") == F.col(f"{prefix}_name")) & self._seen(prefix))
        return joined.select("package_name", f"{prefix}_package", f"{prefix}_name").distinct()

    def contains_class(self) -> DataFrame:
        return self._contains("Class", "class")

    def contains_interface(self) -> DataFrame:
        return self._contains("Interface", "interface")

    def _member(self, owner: str, prefix: str, table: str, member: str) -> DataFrame:
        own = self._facts(table, "parent", "name").withColumnsRenamed({"parent": f"{member}_parent", "name": f"{member}_name"})
        joined = self._nodes(owner, prefix).join(own, (F.col(f"{prefix}_name") == F.col(f"{member}_parent")) & self._seen(prefix))
        return joined.select(f"{prefix}_package", f"{prefix}_name", f"{member}_parent", f"{member}_name").distinct()

    def class_declares(self) -> DataFrame:
        return self._member("Class", "class", "methods", "method")

    def interface_declares(self) -> DataFrame:
        return self._member("Interface", "interface", "methods", "method")

    def has_field(self) -> DataFrame:
        return self._member("Class", "class", "fields", "field")

    def extends(self) -> DataFrame:
        own = self._facts("extends", "child_class", "parent_class")
        joined = own.join(self._nodes("Class", "child"), F.col("child_class") == F.col("child_name")).join(self._nodes("Class", "parent"), F.col("parent_class") == F.col("parent_name"))
        return joined.where(self._seen("child", "parent")).select("child_package", "child_name", "parent_package", "parent_name").distinct()

    def implements(self) -> DataFrame:
        own = self._facts("implements", "class_name", "interface_name").withColumnsRenamed({"class_name": "by", "interface_name": "what"})
        joined = own.join(self._nodes("Class", "class"), F.col("by") == F.col("class_name")).join(self._nodes("Interface", "interface"), F.col("what") == F.col("interface_name"))
        return joined.where(self._seen("class", "interface")).select("class_package", "class_name", "interface_package", "interface_name").distinct()

    def calls(self) -> DataFrame:
        """From the caller to every method of the callee's name."""
        own = self._facts("calls", "caller_parent", "caller", "callee").withColumnsRenamed({"caller_parent": "by_parent", "caller": "by", "callee": "what"})
        joined = own.join(self._nodes("Method", "caller"), (F.col("by_parent") == F.col("caller_parent")) & (F.col("by") == F.col("caller_name")))
        joined = joined.join(self._nodes("Method", "callee"), F.col("what") == F.col("callee_name"))
        return joined.where(self._seen("caller", "callee")).select("caller_parent", "caller_name", "callee_parent", "callee_name").distinct()

    def creates(self) -> DataFrame:
        """From the owning method to every class of the type's name; an owner that is no method has no edge."""
        own = self._facts("creations", "owner_parent", "owner_name", "object_type")
        joined = own.join(self._nodes("Method", "method"), (F.col("owner_parent") == F.col("method_parent")) & (F.col("owner_name") == F.col("method_name")))
        joined = joined.join(self._nodes("Class", "class"), F.col("object_type") == F.col("class_name"))
        return joined.where(self._seen("method", "class")).select("method_parent", "method_name", "class_package", "class_name").distinct()

    #: Method, edge type, labels at both ends.
    KINDS = (
        ("contains_class", "CONTAINS", "Package", "Class"),
        ("contains_interface", "CONTAINS", "Package", "Interface"),
        ("class_declares", "DECLARES", "Class", "Method"),
        ("interface_declares", "DECLARES", "Interface", "Method"),
        ("has_field", "HAS_FIELD", "Class", "Field"),
        ("extends", "EXTENDS", "Class", "Class"),
        ("implements", "IMPLEMENTS", "Class", "Interface"),
        ("calls", "CALLS", "Method", "Method"),
        ("creates", "CREATES", "Method", "Class"),
    )

    def all(self) -> DataFrame:
        """type, src and dst, each end with label, scope and name."""
        out = None
        for method, kind, source, target in self.KINDS:
            own = getattr(self, method)()
            columns = own.columns

            def end(label: str, names: list[str]) -> Column:
                scope = F.col(names[0]) if len(names) == 2 else F.lit(None).cast("string")
                return F.struct(F.lit(label).alias("label"), scope.alias("scope"), F.col(names[-1]).alias("name"))

            first = 1 if source == "Package" else 2
            own = own.select(F.lit(kind).alias("type"), end(source, columns[:first]).alias("src"), end(target, columns[first:]).alias("dst"))
            out = own if out is None else out.unionByName(own)
        return out
