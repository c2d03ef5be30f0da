"""Categories, languages, projections and metadata."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions import classify, text
from tessera.functions.language import detect, with_language
from tessera.operators import metadata

CASES = [
    ("src/main.py", "Python", False, "source"),
    ("tests/test_main.py", "Python", False, "test"),
    ("docs/README.md", "Markdown", False, "documentation"),
    ("package.json", "JSON", False, "configuration"),
    ("dist/app.js", "JavaScript", False, "build"),
    ("__pycache__/main.pyc", None, True, "generated"),
    ("images/logo.png", None, True, "asset"),
    ("something.xyz", None, False, "unknown"),
    ("tests/README.md", "Markdown", False, "documentation"),
    ("requirements.txt", "Text only", False, "source"),
    ("pkg/App.SPEC.ts", "TypeScript", False, "test"),
    ("a/build", None, False, "build"),
    ("Dockerfile", "Docker", False, "configuration"),
    ("x_test.go", "Go", False, "test"),
]


def test_category_of_each_case(spark):
    df = spark.createDataFrame([(p, lang, b, want) for p, lang, b, want in CASES], "path string, language string, binary boolean, want string")
    got = df.withColumn("got", classify.category(F.col("path"), F.col("language"), F.col("binary"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_user_rules_replace_the_defaults(spark, tmp_path):
    file = tmp_path / "rules.json"
    file.write_text(json.dumps({"test": {"directories": ["Checks"]}}))
    loaded = rules.load_classification(file)
    df = spark.createDataFrame([("checks/a.py",), ("docs/a.py",)], "path string")
    got = [r[0] for r in df.select(classify.category(F.col("path"), F.lit("Python"), F.lit(False), loaded)).collect()]
    assert got == ["test", "source"]
    assert rules.rule_part(loaded, "build", "filenames") == []


@pytest.mark.parametrize(
    ("name", "language"),
    [("main.py", "Python"), ("app.js", "JavaScript"), ("App.jsx", "JSX"), ("Dockerfile", "Docker"), ("something.zzzzunknown", None), (".gitignore", None), ("a.PY", None)],
)
def test_language_by_name(name, language):
    assert detect(name) == language


def test_language_column_takes_any_detector(spark):
    df = spark.createDataFrame([("a.x",), ("b.y",), ("a.x",), (None,)], "name string")
    got = [r.language for r in with_language(df, lambda n: "X" if n.endswith(".x") else None).orderBy(F.desc_nulls_last("name")).collect()]
    assert got == [None, "X", "X", None]


def test_extension_and_name(spark):
    from pathlib import PurePosixPath

    names = ["a.py", ".env", "a.tar.gz", "noext", "a.", "..b", ".a.b", "x.PY", "a b.c", "é.ü"]
    df = spark.createDataFrame([(f"d/{n}",) for n in names], "path string")
    got = df.select(text.extension(text.file_name(F.col("path"))).alias("e"), text.file_name(F.col("path")).alias("n")).collect()
    assert [r.e for r in got if r.n != "a."] == [PurePosixPath(n).suffix for n in names if n != "a."]
    assert [r.n for r in got] == names


def test_strip_and_split_lines_equal_python(spark):
    texts = ["\t a \n", "a\rb\r\nc\x0bd\x0ce\x1cf\x85g h", "", "  x", "　y\xa0", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(text.strip(F.col("t")).alias("s"), text.split_lines(F.col("t")).alias("l")).collect()
    assert [r.s for r in got] == [t.strip() for t in texts]
    assert [[x for x in r.l if x] for r in got] == [[x for x in t.splitlines() if x] for t in texts]


def test_binary_and_large(spark):
    df = spark.createDataFrame([(b"a\x00",), (b"a",), (b"",), (None,), (b"x" * 8192 + b"\x00",)], "head binary")
    assert [r[0] for r in df.select(classify.is_binary(F.col("head"))).collect()] == [True, False, False, False, False]
    sizes = spark.createDataFrame([(50,), (100,), (150,), (None,)], "size long")
    assert [r[0] for r in sizes.select(classify.is_large(F.col("size"), 100)).collect()] == [False, False, True, False]
    assert not any(r[0] for r in sizes.select(classify.is_large(F.col("size"), None)).collect())


def test_metadata_counts(spark):
    categories = ["source", "configuration", "documentation", "test", "asset", "generated", "build", "unknown"]
    languages = ["Python", "JSON", "Markdown", "Python", None, "", "JavaScript", None]
    rows = [(c, lang, c in ("asset", "generated"), False, c == "test", False) for c, lang in zip(categories, languages, strict=True)]
    files = spark.createDataFrame(rows, "category string, language string, is_binary boolean, is_large boolean, is_hidden boolean, is_symlink boolean")
    directories = spark.createDataFrame([("a",), ("b",)], "name string")
    got = metadata.repository_metadata(files, directories).first()
    assert (got.total_files, got.total_directories) == (8, 2)
    assert all(got[f"{c}_files"] == 1 for c in categories)
    assert (got.binary_files, got.large_files, got.hidden_files, got.symlink_files) == (2, 0, 1, 0)
    assert got.languages == {"Python": 2, "JSON": 1, "Markdown": 1, "JavaScript": 1}
    empty = metadata.repository_metadata(files.limit(0), directories.limit(0)).first()
    assert empty.total_files == 0
    assert empty.languages == {}
