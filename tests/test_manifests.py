"""Manifest parsers, dependencies and frameworks."""

import json
import re
import tomllib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions.manifests import ParserRegistry
from tessera.operators.dependencies import extract, manifests_of, matched_frameworks

CASES = [
    ("json", '{"dependencies":{"React":"1"},"devDependencies":{"vite":"5"}}', {"react", "vite"}),
    ("json", "not json", set()),
    ("json", '{"dependencies": null}', set()),
    ("json", '{"dependencies": [1]}', set()),
    ("json", '{"dependencies":{"a":"1"}', set()),
    ("json", '{"peerDependencies":{"A":{}},"optionalDependencies":{"b":1,"a":2}}', {"a", "b"}),
    ("pyproject", '[project]\ndependencies = ["FastAPI[all]>=0.1"]\n', {"fastapi"}),
    ("pyproject", "[project", set()),
    ("pyproject", '[tool.poetry.dependencies]\nx = "1"\n', set()),
    ("requirements", 'Flask==2\n# c\n-r x.txt\n-e .\na; python_version<"3"', {"flask", "-e .", "a; python_version"}),
    ("requirements", "\t django ~= 3 \r\n\r\nA!=1", {"django", "a"}),
    ("maven", "<project><artifactId>Root</artifactId><dependency><artifactId> Spring-Boot </artifactId></dependency></project>", {"root", "spring-boot"}),
    ("maven", '<p xmlns="http://x"><artifactId> </artifactId></p>', {""}),
    ("maven", "<a><b></a>", set()),
    ("gradle", 'implementation "org.s:spring-boot:3"\ntestImplementation \'a:b:c\'\ncompileOnly "x:y:z"\nimplementation("k:l:m")\napi "grp:art"', {"spring-boot", "b", "grp"}),
    ("gradle", 'implementation "a:b:1:sources"\napi "alone"', {"1"}),
    ("cargo", '[dependencies]\nAxum = "0.7"\n[dev-dependencies]\ntokio = "1"', {"axum"}),
    ("cargo", "dependencies = 3", set()),
    ("gomod", "require (\n\tgithub.com/Gin-gonic/gin v1\n\t// note\n)\nrequire a/b v2", {"github.com/gin-gonic/gin", "//"}),
    ("gomod", "require(\n\ta v1\n)", set()),
]


@pytest.mark.parametrize("parser", ["json", "pyproject", "requirements", "maven", "gradle", "cargo", "gomod"])
def test_parser(spark, parser):
    cases = [(c, sorted(want)) for p, c, want in CASES if p == parser]
    df = spark.createDataFrame([(c,) for c, _ in cases], "content string")
    got = [sorted(r[0]) for r in df.select(ParserRegistry().get(parser)(F.col("content"))).collect()]
    assert got == [want for _, want in cases]


def test_registry_takes_and_replaces_parsers(spark):
    registry = ParserRegistry()
    assert registry.get("nothing") is None
    registry.register("words", lambda c: F.split(c, " "))
    registry.register("json", lambda c: F.array(F.lit("fixed")))
    rows = spark.createDataFrame([("p", "words", "e", "x y"), ("q", "json", "e", "{}"), ("r", "other", "e", "z"), ("s", "json", "e", None)], "path string, parser string, ecosystem string, content string")
    got = sorted((r.source_file, r.name) for r in extract(rows, registry).collect())
    assert got == [("p", "x"), ("p", "y"), ("q", "fixed")]


def test_manifest_lookup_is_case_sensitive_and_first_wins(spark):
    files = spark.createDataFrame([("Cargo.toml",), ("cargo.toml",), ("package.json",), ("x",)], "name string")
    assert sorted(r.name for r in manifests_of(files).collect()) == ["Cargo.toml", "package.json"]
    twice = [{"filename": "x", "ecosystem": "a", "parser": "json"}, {"filename": "x", "ecosystem": "b", "parser": "json"}]
    assert [r.ecosystem for r in manifests_of(files, twice).collect()] == ["a"]


def _frameworks(spark, rows):
    return [r.name for r in matched_frameworks(spark.createDataFrame(rows, "name string, ecosystem string")).collect()]


def test_framework_cases(spark):
    assert _frameworks(spark, [("React", "javascript"), ("fastapi", "python"), ("@angular/core", "javascript")]) == ["Angular", "FastAPI", "React"]
    assert _frameworks(spark, [("react", "python"), ("some-random-package", "javascript"), ("spring-boot-starter-web", "java"), ("github.com/labstack/echo/v4", "go")]) == []


def test_every_framework_is_detectable(spark):
    rows = [(f.dependencies[0] if f.dependencies else f.dependency_prefixes[0] + "example", f.ecosystem) for f in rules.FRAMEWORKS]
    assert len(rules.FRAMEWORKS) == 26
    assert _frameworks(spark, rows) == sorted(f.name for f in rules.FRAMEWORKS)


def test_rules_load_from_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"name": "N", "ecosystem": "e", "dependencies": ["Dep"]}]))
    loaded = rules.load_frameworks(tmp_path / "f.json")
    deps = spark.createDataFrame([("DEP", "e")], "name string, ecosystem string")
    assert [r.name for r in matched_frameworks(deps, loaded).collect()] == ["N"]
    (tmp_path / "m.json").write_text(json.dumps(rules.MANIFESTS))
    assert rules.load_manifests(tmp_path / "m.json") == rules.MANIFESTS


_word = st.text("abXY19_-", min_size=1, max_size=6)
_members = st.dictionaries(_word, st.sampled_from(["1", "^2.0", ""]), max_size=4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "scripts"]), _members, max_size=4), min_size=1, max_size=8))
def test_json_manifests_equal_the_standard_parser(spark, manifests):
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    texts = [json.dumps(m, indent=i % 3 or None) for i, m in enumerate(manifests)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = {r.i: set(r.names) for r in df.select("i", ParserRegistry().get("json")(F.col("content")).alias("names")).collect()}
    assert got == {i: {name.lower() for k in sections for name in json.loads(t).get(k, {})} for i, t in enumerate(texts)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(_word, st.sampled_from(["", "==1", ">=2,<3", "[all]", "[x]~=1"])), max_size=5), min_size=1, max_size=8))
def test_pyproject_manifests_equal_the_standard_parser(spark, manifests):
    texts = ["[project]\ndependencies = " + json.dumps([n + v for n, v in m]) + "\n" for m in manifests]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = {r.i: set(r.names) for r in df.select("i", ParserRegistry().get("pyproject")(F.col("content")).alias("names")).collect()}
    assert got == {i: {re.split(r"[\[<>=!~]", d)[0].strip().lower() for d in tomllib.loads(t)["project"]["dependencies"]} for i, t in enumerate(texts)}

