"""Rule data and its loaders.  The values are fixed; a user may load others from JSON files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_PARTS = ("filenames", "directories", "filename_contains", "filename_prefixes", "filename_suffixes")

# Which names and directories tell a file's category.
CLASSIFICATION: dict[str, dict[str, list[str]]] = {
    "documentation": {
        "filenames": ["readme", "readme.md", "readme.txt", "readme.rst", "changelog", "changelog.md", "contributing.md", "license"],
        "directories": ["docs", "documentation"],
    },
    "test": {
        "directories": ["test", "tests", "spec", "specs"],
        "filename_contains": [".test.", ".spec."],
        "filename_prefixes": ["test_", "test-"],
        "filename_suffixes": ["_test.py", "_test.go"],
    },
    "configuration": {
        "filenames": [
            "package.json",
            "package-lock.json",
            "pyproject.toml",
            "poetry.lock",
            "cargo.toml",
            "cargo.lock",
            "pom.xml",
            "build.gradle",
            "build.gradle.kts",
            "settings.gradle",
            "settings.gradle.kts",
            "dockerfile",
            "docker-compose.yml",
            "docker-compose.yaml",
            ".gitignore",
            ".dockerignore",
            "makefile",
        ],
    },
    "generated": {"directories": ["__pycache__", ".pytest_cache", ".mypy_cache", "coverage"]},
    "build": {"directories": ["dist", "build", "target", "out"]},
}

# Manifest file names with their ecosystem and parser.
MANIFESTS: list[dict[str, str]] = [
    {"filename": "package.json", "ecosystem": "javascript", "parser": "json"},
    {"filename": "pyproject.toml", "ecosystem": "python", "parser": "pyproject"},
    {"filename": "requirements.txt", "ecosystem": "python", "parser": "requirements"},
    {"filename": "pom.xml", "ecosystem": "java", "parser": "maven"},
    {"filename": "build.gradle", "ecosystem": "java", "parser": "gradle"},
    {"filename": "build.gradle.kts", "ecosystem": "java", "parser": "gradle"},
    {"filename": "Cargo.toml", "ecosystem": "rust", "parser": "cargo"},
    {"filename": "go.mod", "ecosystem": "go", "parser": "gomod"},
]


@dataclass(frozen=True)
class Framework:
    """Detected by a dependency of its ecosystem that is listed or starts with a listed prefix."""

    name: str
    ecosystem: str
    dependencies: tuple[str, ...] = ()
    dependency_prefixes: tuple[str, ...] = ()


# Frameworks with the dependencies that tell them.
FRAMEWORKS: list[Framework] = [
    Framework("React", "javascript", ("react",)),
    Framework("Next.js", "javascript", ("next",)),
    Framework("Vue", "javascript", ("vue",)),
    Framework("Nuxt", "javascript", ("nuxt",)),
    Framework("Angular", "javascript", (), ("@angular/",)),
    Framework("Svelte", "javascript", ("svelte",)),
    Framework("SvelteKit", "javascript", ("@sveltejs/kit",)),
    Framework("Express", "javascript", ("express",)),
    Framework("NestJS", "javascript", (), ("@nestjs/",)),
    Framework("Fastify", "javascript", ("fastify",)),
    Framework("FastAPI", "python", ("fastapi",)),
    Framework("Django", "python", ("django",)),
    Framework("Flask", "python", ("flask",)),
    Framework("Starlette", "python", ("starlette",)),
    Framework("Tornado", "python", ("tornado",)),
    Framework("Streamlit", "python", ("streamlit",)),
    Framework("Spring Boot", "java", ("spring-boot",)),
    Framework("Quarkus", "java", ("quarkus",)),
    Framework("Micronaut", "java", ("micronaut",)),
    Framework("Gin", "go", ("github.com/gin-gonic/gin",)),
    Framework("Echo", "go", ("github.com/labstack/echo",)),
    Framework("Fiber", "go", ("github.com/gofiber/fiber",)),
    Framework("Chi", "go", ("github.com/go-chi/chi",)),
    Framework("Actix Web", "rust", ("actix-web",)),
    Framework("Axum", "rust", ("axum",)),
    Framework("Rocket", "rust", ("rocket",)),
]

FRAMEWORK_SCHEMA = "name string, ecosystem string, dependencies array<string>, dependency_prefixes array<string>"


def parse_classification(text: str) -> dict[str, dict[str, list[str]]]:
    return json.loads(text)


def parse_manifests(text: str) -> list[dict[str, str]]:
    return json.loads(text)


def parse_frameworks(text: str) -> list[Framework]:
    """Lists that are missing are empty."""
    return [Framework(r["name"], r["ecosystem"], tuple(r.get("dependencies", ())), tuple(r.get("dependency_prefixes", ()))) for r in json.loads(text)]


def load_classification(path: str | Path) -> dict[str, dict[str, list[str]]]:
    return parse_classification(Path(path).read_text(encoding="utf-8"))


def load_manifests(path: str | Path) -> list[dict[str, str]]:
    return parse_manifests(Path(path).read_text(encoding="utf-8"))


def load_frameworks(path: str | Path) -> list[Framework]:
    return parse_frameworks(Path(path).read_text(encoding="utf-8"))


def rule_part(rules: Mapping[str, Mapping[str, Sequence[str]]], category: str, part: str) -> list[str]:
    """Lower-cased values; a category or part that is missing has none."""
    return [v.lower() for v in rules.get(category, {}).get(part, ())]


def classification_table(spark: SparkSession, rules: Mapping[str, Mapping[str, Sequence[str]]] = CLASSIFICATION) -> DataFrame:
    """category, part and value of each rule."""
    rows = [(c, p, v) for c in rules for p in RULE_PARTS for v in rule_part(rules, c, p)]
    return spark.createDataFrame(rows, "category string, part string, value string")


def manifest_table(spark: SparkSession, manifests: Sequence[Mapping[str, str]] = MANIFESTS) -> DataFrame:
    """The first definition of each file name."""
    first: dict[str, tuple[str, str, str]] = {}
    for m in manifests:
        first.setdefault(m["filename"], (m["filename"], m["ecosystem"], m["parser"]))
    return spark.createDataFrame(list(first.values()), "filename string, ecosystem string, parser string")


def framework_table(spark: SparkSession, frameworks: Sequence[Framework] = FRAMEWORKS) -> DataFrame:
    """Dependencies and prefixes are lower-cased, ecosystems are not."""
    rows = [(f.name, f.ecosystem, list(f.dependencies), list(f.dependency_prefixes)) for f in frameworks]
    table = spark.createDataFrame(rows, FRAMEWORK_SCHEMA)
    return table.withColumns({c: F.transform(c, F.lower) for c in ("dependencies", "dependency_prefixes")})
