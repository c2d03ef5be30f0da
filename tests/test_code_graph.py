"""Java sources to nodes, facts and graph; generic model; sinks."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.model import AST_NODES, ENTITY_KINDS, RELATIONSHIP_KINDS
from tessera.operators import ast_facts, code_graph
from tessera.operators.code_model import code_model
from tessera.model import RepositorySource
from tessera.plans.repository import graph
from tessera.sinks import health, merge_edges, merge_nodes, retried, write_edges, write_nodes
from tessera.sources.java_ast import ast_nodes, parse

# A file with the shape of the golden graph: 16 nodes and 23 edges.
GOLDEN = """
package org.sample.shop;
import java.util.List;

public class Client extends Person {
    public Ledger ledger = new Ledger();
    public final int size = 0;
    public void open() {
        int n = 0;
        Ledger local = new Ledger();
        Gate gate = new Gate();
        System.out.println("x");
        check();
        proofs();
    }
    public void check() { proofs(); }
    public void proofs() { }
}

class Person implements Saved, Copied {
    void save() { }
    void copy() { }
}
public interface Saved { void save(); }
public interface Copied { void copy(); }
public class Ledger {}
public class Gate {}
"""


def _facts(spark, *sources):
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sources)], "path string, content string")
    return ast_facts.facts(ast_nodes(df), cache=True)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_golden_facts(spark):
    f = _facts(spark, GOLDEN)
    assert _rows(f["packages"], "name") == [("org.sample.shop",)]
    assert _rows(f["imports"], "name") == [("java.util.List",)]
    assert {r[1] for r in _rows(f["classes"], "package", "name")} == {"Client", "Person", "Ledger", "Gate"}
    assert {r[0] for r in _rows(f["classes"], "package", "name")} == {"org.sample.shop"}
    assert {r[0] for r in _rows(f["interfaces"], "name")} == {"Saved", "Copied"}
    assert set(_rows(f["methods"], "parent", "name")) == {("Client", "open"), ("Client", "check"), ("Client", "proofs"), ("Person", "save"), ("Person", "copy"), ("Saved", "save"), ("Copied", "copy")}
    assert _rows(f["fields"], "parent", "name") == [("Client", "ledger"), ("Client", "size")]
    assert set(_rows(f["calls"], "caller_parent", "caller", "callee")) == {("Client", "open", "println"), ("Client", "open", "check"), ("Client", "open", "proofs"), ("Client", "check", "proofs")}
    assert _rows(f["creations"], "owner_parent", "owner_name", "owner_type", "object_type") == [("Client", "Client", "class", "Ledger"), ("Client", "open", "method", "Gate"), ("Client", "open", "method", "Ledger")]
    assert _rows(f["extends"], "child_class", "parent_class") == [("Client", "Person")]
    assert _rows(f["implements"], "class_name", "interface_name") == [("Person", "Copied"), ("Person", "Saved")]


def test_golden_graph(spark, tmp_path):
    f = _facts(spark, GOLDEN)
    nodes, edges = code_graph.nodes(f), code_graph.EdgeBuilder(f).all()
    assert nodes.count() == 16
    counts = {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()}
    assert counts == {"CONTAINS": 6, "DECLARES": 7, "HAS_FIELD": 2, "EXTENDS": 1, "IMPLEMENTS": 2, "CALLS": 3, "CREATES": 2}
    for _ in range(2):  # writing again changes nothing
        write_nodes(nodes, str(tmp_path / "nodes"))
        write_edges(edges, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 16
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 23


def _named(source):
    return [(t, n) for t, n, _, _ in parse(source)]


def test_chains_are_in_pre_order():
    source = "class A { void m() { x.foo(bar()).baz(new B(q())).end(); int v = (int) get()[at()]; new C().run(); } }"
    assert [n for t, n in _named(source) if t != "class_declaration"] == ["m", "end", "baz", "foo", "bar", "B", "q", "get", "at", "run", "C"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("class A<T extends B<T>> extends C<D> implements E, F<G> {}", [("class_declaration", "A")]),
        ("interface I extends J { int X = f(); void m(); default int d() { return g(); } }", [("interface_declaration", "I"), ("constant_declaration", "X"), ("method_invocation", "f"), ("method_declaration", "m"), ("method_declaration", "d"), ("method_invocation", "g")]),
        ("enum E { A(f()), B { void x() {} }; int n; E(int i) { g(); } void m() {} }", [("enum_declaration", "E"), ("method_invocation", "f"), ("method_declaration", "x"), ("field_declaration", "n"), ("method_invocation", "g"), ("method_declaration", "m")]),
        ("record R(int a) { R { f(); } int b() { return a; } }", [("record_declaration", "R"), ("method_invocation", "f"), ("method_declaration", "b")]),
        ("class A { int a, b = f(); int[] c = {g()}; static { h(); } { i(); } }", [("class_declaration", "A"), ("field_declaration", "a"), ("method_invocation", "f"), ("field_declaration", "c"), ("method_invocation", "g"), ("method_invocation", "h"), ("method_invocation", "i")]),
        ("class A { A() { super(f()); } <T> T m(List<? super T> x) throws Q { return x.<T>g(); } }", [("class_declaration", "A"), ("method_invocation", "f"), ("method_declaration", "m"), ("method_invocation", "g")]),
        ("class A { void m() { r(() -> { s(); }); new B() { void n() { t(); } }; class L { void k() {} } } }", [("class_declaration", "A"), ("method_declaration", "m"), ("method_invocation", "r"), ("method_invocation", "s"), ("object_creation_expression", "B"), ("method_declaration", "n"), ("method_invocation", "t"), ("class_declaration", "L"), ("method_declaration", "k")]),
        ('@interface N { String v() default "x"; } // class Z\n/* class Y {} */ class A { String s = "class X { f(); }"; char c = \'{\'; }', [("annotation_type_declaration", "N"), ("class_declaration", "A"), ("field_declaration", "s"), ("field_declaration", "c")]),
        ("import static a.b.C.*; import a.D; @X(f = 1) public final class A { @Y(\"q\") private static final Map<String, List<Integer>> m = new HashMap<>(); }", [("import_declaration", "a.b.C"), ("import_declaration", "a.D"), ("class_declaration", "A"), ("field_declaration", "m"), ("object_creation_expression", "HashMap<>")]),
        ("class A { Object o = A.class; Runnable r = A::m; int x = y < z ? f() : new int[g()].length; }", [("class_declaration", "A"), ("field_declaration", "o"), ("field_declaration", "r"), ("field_declaration", "x"), ("method_invocation", "f"), ("method_invocation", "g")]),
        ("", []),
        ("class {", []),
        ("class A { void m( { f() ", [("class_declaration", "A"), ("method_declaration", "m")]),
    ],
)
def test_declarations(source, want):
    got = _named(source)
    assert got[: len(want)] == want if "( {" in source else got == want


def test_supertypes_keep_their_text():
    node = parse("class A<T> extends C<D, E> implements F<G>, h.I {}")[0]
    assert node == ("class_declaration", "A", "C<D, E>", ["F<G>", "h.I"])


def test_deep_nesting_does_not_recurse():
    source = "class A { void m() { " + "f(" * 5000 + ")" * 5000 + "; " + "{" * 5000 + "g();" + "}" * 5000 + "} }"
    assert [n for t, n in _named(source) if t == "method_invocation"] == ["f"] * 5000 + ["g"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("class interface A b ( ) { } [ ] < > ; . , = new @ :: -> \" ' extends import package enum record".split()), max_size=30).map(" ".join))
def test_any_text_parses(source):
    parse(source)


def test_scopes_are_never_left(spark):
    f = _facts(spark, "class A { void m() {} class B {} int late; void n() { new C(); } }  class D { E e = new E(); }")
    assert set(_rows(f["methods"], "parent", "name")) == {("A", "m"), ("B", "n")}
    assert _rows(f["fields"], "parent", "name") == [("B", "late"), ("D", "e")]
    assert ("D", "n", "method", "E") in _rows(f["creations"], "owner_parent", "owner_name", "owner_type", "object_type")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["f", "g"]), st.sampled_from(["class_declaration", "interface_declaration", "method_declaration", "method_invocation", "field_declaration"]), st.sampled_from(["x", "y", None])), max_size=15))
def test_scope_window_equals_a_loop(spark, rows):
    nodes = spark.createDataFrame([(f, i, t, n, None, None) for i, (f, t, n) in enumerate(rows)], AST_NODES)
    got = {r.pre: (r.in_class, r.in_type, r.in_method) for r in ast_facts.scoped(nodes).collect()}
    for file in ("f", "g"):
        cls = typ = method = None
        for i, (f, t, n) in enumerate(rows):
            if f == file:
                if n is not None:
                    cls = n if t == "class_declaration" else cls
                    typ = n if t in ("class_declaration", "interface_declaration") else typ
                    method = n if t == "method_declaration" else method
                assert got[i] == (cls, typ, method)


def test_default_package_joins_nothing_or_fails_on_request(spark):
    f = _facts(spark, "class A { void m() {} }")
    assert _rows(code_graph.node_keys(f, "Class"), "package", "name") == [(None, "A")]
    assert code_graph.EdgeBuilder(f).contains_class().count() == 0
    assert code_graph.EdgeBuilder(f).class_declares().count() == 1
    with pytest.raises(Exception, match="null in the key"):
        code_graph.node_keys(f, "Class", strict_null_keys=True).collect()


def test_incremental_edges_see_earlier_files_only(spark):
    f = _facts(spark, "package p; class A extends B {}", "package p; class B extends A {}")
    numbered = {k: v.withColumn("file_idx", F.substring("file", 2, 9).cast("long")) for k, v in f.items()}
    both = code_graph.EdgeBuilder(f).extends()
    later = code_graph.EdgeBuilder(numbered, incremental=True)
    assert both.count() == 2
    assert _rows(later.extends(), "child_name", "parent_name") == [("B", "A")]
    assert later.all().count() == 3


def test_builders_can_be_added(spark):
    ast_facts.register_builder("enums", lambda nodes: nodes.where("type = 'enum_declaration'").select("file", "name"))
    try:
        assert _rows(_facts(spark, "enum E {}")["enums"], "name") == [("E",)]
    finally:
        del ast_facts.BUILDERS["enums"]


def test_generic_model(spark):
    assert (len(ENTITY_KINDS), len(RELATIONSHIP_KINDS)) == (23, 22)
    model = code_model(spark, "m", [{"id": "1", "kind": "class", "name": "A", "location": ("a.py", 1, 2, None, None)}, {"id": "2", "kind": "method", "name": "f", "metadata": {"k": "v"}}], [{"source_id": "1", "target_id": "2", "kind": "contains"}])
    rows = {r.id: r for r in model.entities.collect()}
    assert (rows["1"].location.start_line, rows["1"].metadata, rows["2"].metadata, rows["2"].language) == (1, {}, {"k": "v"}, None)
    assert model.relationships.first().kind == "contains"
    with pytest.raises(Exception, match="unknown kind"):
        code_model(spark, "m", [{"id": "1", "kind": "planet", "name": "x"}]).entities.collect()


def test_health(spark):
    def broken():
        raise OSError("down")

    assert health(spark, {"a": lambda: 1}).first().status == "healthy"
    row = health(spark, {"a": lambda: 1, "b": broken}).first()
    assert (row.status, row.services) == ("degraded", {"a": "healthy", "b": "unhealthy"})
    waits = []
    assert not retried(broken, 10, 2.0, waits.append)
    assert waits == [2.0] * 9


def test_graph_of_a_repository(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "A.java").write_text("package p; class A extends B { int f; void m() { n(); new B(); } }")
    (tmp_path / "B.java").write_text("package p; class B { void n() { } }")
    (tmp_path / "c.py").write_text("class C: pass")
    (tmp_path / "Broken.java").write_bytes(b"\xff\xfe")
    got = graph(spark, RepositorySource("local", str(tmp_path)))
    assert {(r.label, r.key["scope"], r.key["name"]) for r in got.nodes.collect()} == {("Package", None, "p"), ("Class", "p", "A"), ("Class", "p", "B"), ("Method", "A", "m"), ("Method", "B", "n"), ("Field", "A", "f")}
    edges = {(r.type, r.src["name"], r.dst["name"]) for r in got.edges.collect()}
    assert edges == {("CONTAINS", "p", "A"), ("CONTAINS", "p", "B"), ("DECLARES", "A", "m"), ("DECLARES", "B", "n"), ("HAS_FIELD", "A", "f"), ("EXTENDS", "A", "B"), ("CALLS", "m", "n"), ("CREATES", "m", "B")}


def test_merging_keeps_what_is_stored(spark, tmp_path):
    key = "label string, key struct<scope:string,name:string>"
    end = "struct<label:string,scope:string,name:string>"
    nodes = lambda *rows: spark.createDataFrame([(label, (scope, name)) for label, scope, name in rows], key)
    a, b, c = ("Class", "p", "A"), ("Class", None, "B"), ("Method", "A", "m")
    path = str(tmp_path / "nodes")
    for rows in ((a, b), (b, b, c), (), (a,)):
        merge_nodes(nodes(*rows), path)
    stored = spark.read.schema(key).parquet(path).collect()
    assert sorted((str(r.label), str(r.key["scope"]), r.key["name"]) for r in stored) == sorted((x, str(y), z) for x, y, z in (a, b, c))
    edges = lambda *rows: spark.createDataFrame([(t, x, y) for t, x, y in rows], f"type string, src {end}, dst {end}")
    path = str(tmp_path / "edges")
    merge_edges(edges(("DECLARES", a, c)), path)
    merge_edges(edges(("DECLARES", a, c), ("CALLS", c, c)), path)
    assert spark.read.parquet(path).count() == 2

