"""Ingestion, ignore rules, scans, limits and whole repositories."""

import os
import subprocess
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.model import Repository, RepositorySource, ScanLimits
from tessera.operators.limits import within_limits
from tessera.operators.prune import kept, pruned
from tessera.plans.repository import discover
from tessera.sources.ignore import IgnoreRules
from tessera.sources.ingest import ingest
from tessera.sources.scan import RepositoryScanner


def local(path) -> Repository:
    return Repository(Path(path).name, str(path), RepositorySource("local", str(path)))


def tree(root: Path, **files: str | bytes) -> None:
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def scanned(spark, root, **options):
    files, directories = RepositoryScanner(spark, **options).scan(local(root))
    return sorted(r.relative_path for r in files.collect()), sorted(r.relative_path for r in directories.collect())


def test_ingest_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest(RepositorySource("local", str(tmp_path / "no")))
    (tmp_path / "f").write_text("")
    with pytest.raises(NotADirectoryError):
        ingest(RepositorySource("local", str(tmp_path / "f")))
    with pytest.raises(ValueError):
        ingest(RepositorySource("ftp", "x"))
    with pytest.raises(RuntimeError):
        ingest(RepositorySource("git", str(tmp_path / "no")))
    assert ingest(RepositorySource("local", str(tmp_path))).name == tmp_path.name


def test_clone(tmp_path):
    origin = tmp_path / "origin"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (origin / "a.py").write_text("x")
    run("add", ".")
    run("commit", "-qm", "x")
    got = ingest(RepositorySource("git", f"file://{origin}", "main", True))
    assert (Path(got.path) / "a.py").read_text() == "x"
    assert got.name == Path(got.path).name


@pytest.mark.parametrize(
    ("lines", "path", "ignored"),
    [
        (["*.log"], "a/b.log", True),
        (["*.log", "!keep.log"], "a/keep.log", False),
        (["build/"], "build", False),
        (["build/"], "build/x", True),
        (["build"], "a/build/x", True),
        (["/build"], "a/build", False),
        (["/build"], "build", True),
        (["a/b"], "x/a/b", False),
        (["a/**/b"], "a/b", True),
        (["a/**/b"], "a/x/y/b", True),
        (["**/b"], "x/b", True),
        (["a/**"], "a", False),
        (["a/**"], "a/x", True),
        (["# c", "", "\\#x"], "#x", True),
        (["[a-c].txt"], "b.txt", True),
        (["[!a-c].txt"], "b.txt", False),
        (["?.txt"], "ab.txt", False),
        (["x\\ "], "x ", True),
        (["x   "], "x", True),
        ([], ".git", True),
        ([], ".git/config", True),
        ([], "a/.git", True),
        ([], ".github", False),
    ],
)
def test_ignore_patterns(lines, path, ignored):
    assert IgnoreRules(lines).ignores(path) is ignored


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab*/!?.[]", max_size=6), max_size=5), st.lists(st.lists(st.sampled_from(["a", "b", "ab", ".a", "a.b"]), min_size=1, max_size=4).map("/".join), min_size=1, max_size=8))
def test_ignore_column_equals_python(spark, lines, paths):
    rules = IgnoreRules(lines)
    df = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    got = [r[0] for r in df.select(rules.column(F.col("relative_path"))).collect()]
    assert got == [rules.ignores(p) for p in paths]
    reached = [p for p in paths if not any(rules.ignores("/".join(p.split("/")[:n])) for n in range(1, p.count("/") + 2))]
    assert sorted(r[0] for r in pruned(df, rules).collect()) == sorted(reached)
    assert kept(df, rules).count() == sum(not rules.ignores(p) for p in paths)


def test_scan_keeps_hidden_and_empty_and_prunes(spark, tmp_path):
    tree(tmp_path, **{"a.py": "x", "_u.py": "", ".hidden/.f": "", "skip/x": "", "skip/keep": "", "d/e/f.txt": "x", ".gitignore": "skip\n!skip/keep\nout/\n", "out/o": "", ".git/config": ""})
    files, directories = scanned(spark, tmp_path)
    assert files == [".gitignore", ".hidden/.f", "_u.py", "a.py", "d/e/f.txt"]
    assert directories == [".hidden", "d", "d/e", "out"]
    files, _ = scanned(spark, tmp_path, ignore_patterns=["*.py"])
    assert "a.py" not in files


def test_scan_columns(spark, tmp_path):
    tree(tmp_path, **{"src/main.py": "print()", "logo.png": b"\x89\x00", ".env": "A=1"})
    os.symlink(tmp_path / "src/main.py", tmp_path / "link.py")
    files, _ = RepositoryScanner(spark, limits=ScanLimits(max_file_size=6)).scan(local(tmp_path))
    got = {r.relative_path: r for r in files.collect()}
    main = got["src/main.py"]
    assert (main.name, main.extension, main.size, main.language, main.category, main.is_large) == ("main.py", ".py", 7, "Python", "source", True)
    assert (got["logo.png"].is_binary, got["logo.png"].category) == (True, "asset")
    assert (got[".env"].is_hidden, got[".env"].extension) == (True, "")
    assert got["link.py"].is_symlink
    assert got["link.py"].size == (tmp_path / "link.py").lstat().st_size


def test_absolute_classification_is_an_option(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    tree(root, **{"a.py": "x"})
    relative = RepositoryScanner(spark).scan(local(root))[0].first()
    absolute = RepositoryScanner(spark, classify_absolute=True).scan(local(root))[0].first()
    assert (relative.category, absolute.category) == ("source", "build")


def test_links(spark, tmp_path):
    tree(tmp_path, **{"repo/real/a.py": "x", "other/b.py": "y"})
    repo = tmp_path / "repo"
    os.symlink(tmp_path / "other", repo / "linked")
    os.symlink(repo, repo / "real" / "up")
    os.symlink(tmp_path / "gone", repo / "broken")
    files, directories = scanned(spark, repo)
    assert files == ["broken", "real/a.py"]
    assert directories == ["real"]
    files, directories = scanned(spark, repo, follow_symlinks=True)
    assert files == ["broken", "linked/b.py", "real/a.py"]
    assert directories == ["linked", "real"]


def test_unreadable_directory_is_an_error_row(spark, tmp_path):
    scanner = RepositoryScanner(spark)
    events = scanner.events(local(tmp_path / "gone"))
    assert scanner.errors(events).count() == 1
    assert scanner.files(events).count() == 0


def test_limits_in_scans(spark, tmp_path):
    tree(tmp_path, **{f"f{i}": "x" * 100 for i in range(3)}, **{f"d{i}/g": "y" for i in range(3)})
    assert len(scanned(spark, tmp_path, limits=ScanLimits(max_files=2))[0]) == 2
    assert scanned(spark, tmp_path, limits=ScanLimits(max_directories=2)) == ([], ["d0", "d1"])
    assert scanned(spark, tmp_path, limits=ScanLimits(max_total_size=150))[0] == ["f0"]
    assert len(scanned(spark, tmp_path, limits=ScanLimits(max_files=4))[0]) == 4


def _plain_limits(events, limits):
    files = directories = size = 0
    out = []
    for pos, kind, n in events:
        if kind == "directory":
            if limits.max_directories is not None and directories >= limits.max_directories:
                break
            directories += 1
        else:
            if limits.max_files is not None and files >= limits.max_files or limits.max_total_size is not None and size + n > limits.max_total_size:
                break
            files, size = files + 1, size + n
        out.append(pos)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["file", "directory"]), st.integers(0, 9)), max_size=12), st.integers(0, 6) | st.none(), st.integers(0, 4) | st.none(), st.integers(0, 30) | st.none())
def test_limit_window_equals_a_loop(spark, rows, files, directories, size):
    limits = ScanLimits(None, files, directories, size)
    events = [(i, k, n if k == "file" else None) for i, (k, n) in enumerate(rows)]
    df = spark.createDataFrame(events, "pos long, kind string, size long")
    assert sorted(r.pos for r in within_limits(df, limits).collect()) == _plain_limits(events, limits)


def test_whole_repository(spark, tmp_path):
    tree(tmp_path, **{"src/main.py": "x", "tests/test_main.py": "x", "docs/README.md": "x", "dist/app.js": "x", "package.json": '{"dependencies":{"react":"1"}}'})
    model = discover(spark, RepositorySource("local", str(tmp_path)))
    got = model.metadata.first()
    assert got.total_files == 5
    assert all(got[f"{c}_files"] == 1 for c in ("source", "test", "documentation", "build", "configuration"))
    assert {"Python", "JavaScript", "Markdown"} <= set(got.languages)
    assert [r.name for r in model.frameworks.collect()] == ["React"]
    assert [(r.name, r.ecosystem) for r in model.dependencies.collect()] == [("react", "javascript")]


def test_unreadable_manifest_has_no_dependencies(spark, tmp_path):
    tree(tmp_path, **{"package.json": b"\xff\xfe{"})
    assert discover(spark, RepositorySource("local", str(tmp_path))).dependencies.count() == 0


def test_limits_and_link_cycles_leave_rows(spark, tmp_path):
    tree(tmp_path, **{"a/x.py": "1", "a/y.py": "22", "b/z.py": "333"})
    os.symlink(tmp_path, tmp_path / "a" / "back")
    for limits, wanted in (
        (ScanLimits(max_files=2), ("max_files=2", "b/z.py")),
        (ScanLimits(max_directories=1), ("max_directories=1", "b")),
        (ScanLimits(max_total_size=4), ("max_total_size=4", "b/z.py")),
    ):
        scanner = RepositoryScanner(spark, limits=limits)
        (row,) = scanner.notices(scanner.events(local(tmp_path))).collect()
        assert (row.kind, row.message, row.relative_path) == ("limit", *wanted)
    scanner = RepositoryScanner(spark, follow_symlinks=True)
    events = scanner.events(local(tmp_path))
    (row,) = scanner.notices(events).collect()
    assert (row.kind, row.relative_path) == ("cycle", "a/back")
    assert scanner.errors(events).count() == 0
    assert scanner.notices(RepositoryScanner(spark).events(local(tmp_path))).count() == 0


def test_classifier_and_ignore_rules_can_be_injected(spark, tmp_path):
    tree(tmp_path, **{"a.py": "x", "b.log": "x", "tests/c.py": "x", ".gitignore": "*.py"})
    rules = IgnoreRules(["*.log", "!keep.log"])
    classifier = lambda path, language, binary: F.concat(F.lit("own:"), F.coalesce(language, F.lit("none")), F.when(F.startswith(path, F.lit("tests/")), "!").otherwise(""))
    scanner = RepositoryScanner(spark, ignore_rules=rules, classifier=classifier)
    files, _ = scanner.scan(local(tmp_path))
    assert {r.relative_path: r.category for r in files.collect()} == {"a.py": "own:Python", "tests/c.py": "own:Python!", ".gitignore": "own:none"}


def test_rules_survive_their_json():
    rules = IgnoreRules(["*.log", "!keep.log", "dist/", "/x/**"], custom=["y?"])
    again = IgnoreRules.of_json(rules.to_json())
    for path in ("a.log", "keep.log", "dist", "dist/a", "x/b", "q/x/b", "y1", "z"):
        assert again.ignores(path) == rules.ignores(path)


def test_files_are_not_opened_without_heads(spark, tmp_path):
    tree(tmp_path, **{"a.bin": b"\0"})
    scanner = RepositoryScanner(spark)
    assert [r["head"] for r in scanner.events(local(tmp_path), heads=False).where("kind = 'file'").collect()] == [None]
    assert [r.is_binary for r in scanner.files(scanner.events(local(tmp_path))).collect()] == [True]


def test_clones_go_where_they_are_told(tmp_path):
    origin, shared = tmp_path / "origin", tmp_path / "shared"
    shared.mkdir()
    tree(origin, **{"a.py": "x"})
    git = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    got = ingest(RepositorySource("git", str(origin)), clone_into=str(shared))
    assert Path(got.path).parent == shared
    assert (Path(got.path) / "a.py").read_text() == "x"

