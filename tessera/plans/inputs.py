"""Repository tables derived from the test tables, by SQL that Spark and DuckDB both run.

The test tables hold no code, so every row of documents or events stands for a
file, a manifest, a scan event or a syntax node.  {str} is the dialect's string
type, {documents} and {events} are the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = """
select doc_id, rel_path, size, is_binary, is_symlink,
  case when rel_path like '%.py' then 'Python' when rel_path like '%.js' then 'JavaScript' when rel_path like '%.java' then 'Java' when rel_path like '%.md' then 'Markdown'
    when rel_path like '%.json' then 'JSON' when rel_path like '%.go' then 'Go' end as language
from (select doc_id, concat(
  case doc_id % 9 when 0 then 'src/' when 1 then 'src/core/' when 2 then 'tests/' when 3 then 'docs/' when 4 then 'dist/' when 5 then '__pycache__/' when 6 then 'pkg/.cfg/' when 7 then 'lib/' else '' end,
  case when doc_id % 23 = 7 then 'package.json' when doc_id % 23 = 9 then 'README.md' when doc_id % 23 = 11 then 'requirements.txt' when doc_id % 23 = 13 then 'Cargo.toml' when doc_id % 23 = 15 then 'cargo.toml'
    else concat(case doc_id % 7 when 0 then 'main' when 1 then 'test_unit' when 2 then 'app.test' when 3 then '.env' when 4 then 'README' when 5 then 'package' else 'Logo' end,
      cast(doc_id as {str}),
      case doc_id % 8 when 0 then '.py' when 1 then '.js' when 2 then '.java' when 3 then '.md' when 4 then '.json' when 5 then '.png' when 6 then '.xyz' else '_test.go' end) end) as rel_path,
  n_chars as size, doc_id % 13 = 0 as is_binary, doc_id % 19 = 0 as is_symlink from {documents}) t"""

EVENTS = "select doc_id as pos, case when doc_id % 10 = 3 then 'directory' else 'file' end as kind, case when doc_id % 10 = 3 then cast(null as bigint) else n_chars end as size from {documents}"

_N = "chr(10)"
MANIFESTS = {
    "json": """case when doc_id % 11 = 0 then 'not json' else concat('{{"dependencies":{{"React":"1","lib', cast(doc_id % 50 as {str}), '":"2"}},"devDependencies":{{"Vite":"5"', case when doc_id % 3 = 0 then ',"@angular/core":"1"' else '' end, '}}}}') end""",
    "requirements": f"""concat('Flask==2', {_N}, '# c', {_N}, '-r x.txt', {_N}, '-e .', {_N}, {_N}, 'Pkg', cast(doc_id % 40 as {{str}}), '[all]>=1', {_N}, 'a; python_version<"3"', {_N}, '  django ~= 3  ')""",
    "gradle": f"""concat('implementation "org.s:spring-boot:3"', {_N}, 'testImplementation ''a:b:c''', {_N}, 'compileOnly "x:y:z"', {_N}, 'implementation("k:l:m")', {_N}, 'api "Grp', cast(doc_id % 30 as {{str}}), ':art"', {_N}, 'api "alone"')""",
    "gomod": f"""concat('module x', {_N}, {_N}, 'require (', {_N}, chr(9), 'github.com/Gin-gonic/gin v1', {_N}, chr(9), '// note', {_N}, {_N}, chr(9), 'github.com/x/m', cast(doc_id % 30 as {{str}}), ' v2', {_N}, ')', {_N}, 'require a/b v2', {_N})""",
    "maven": """case when doc_id % 13 = 0 then '<a><b></a>' else concat('<project><artifactId>Root</artifactId><dependencies><dependency><artifactId> Spring-Boot </artifactId></dependency><dependency><artifactId>Lib', cast(doc_id % 20 as {str}), '</artifactId></dependency></dependencies></project>') end""",
    "pyproject": f"""case when doc_id % 17 = 0 then '[project' else concat('[project]', {_N}, 'dependencies = ["FastAPI[all]>=0.1", "Lib', cast(doc_id % 25 as {{str}}), '~=1"]', {_N}) end""",
    "cargo": f"""case when doc_id % 19 = 0 then '[dependencies' else concat('[dependencies]', {_N}, 'Axum = "0.7"', {_N}, 'Lib', cast(doc_id % 15 as {{str}}), ' = "1"', {_N}, '[dev-dependencies]', {_N}, 'tokio = "1"', {_N}) end""",
}

#: File names of the manifests, by parser.
MANIFEST_NAMES = {"json": "package.json", "requirements": "requirements.txt", "gradle": "build.gradle", "gomod": "go.mod", "maven": "pom.xml", "pyproject": "pyproject.toml", "cargo": "Cargo.toml"}

#: Java sources, and the syntax nodes that they have.
JAVA = """concat('package p', cast(doc_id % 7 as {str}), '; import lib.x', cast(doc_id % 13 as {str}), '; class C', cast(doc_id % 97 as {str}),
  case when doc_id % 3 = 0 then concat(' extends C', cast((doc_id * 7) % 97 as {str})) else '' end, case when doc_id % 5 = 0 then concat(' implements I', cast(doc_id % 17 as {str}), ', I', cast((doc_id * 5) % 17 as {str})) else '' end,
  ' {{ int f', cast(doc_id % 11 as {str}), '; void m', cast(doc_id % 89 as {str}), '() {{ m', cast((doc_id * 3) % 89 as {str}), '(); C', cast((doc_id * 5) % 97 as {str}), ' c = new C', cast((doc_id * 5) % 97 as {str}), '(); }} }} ',
  case when doc_id % 4 = 0 then concat('interface I', cast(doc_id % 17 as {str}), ' {{ void m', cast(doc_id % 31 as {str}), '(); }}') else '' end)"""
_NODE_ROWS = (
    (0, "package_declaration", "'p', doc_id % 7", "true"),
    (1, "import_declaration", "'lib.x', doc_id % 13", "true"),
    (2, "class_declaration", "'C', doc_id % 97", "true"),
    (3, "field_declaration", "'f', doc_id % 11", "true"),
    (4, "method_declaration", "'m', doc_id % 89", "true"),
    (5, "method_invocation", "'m', (doc_id * 3) % 89", "true"),
    (6, "object_creation_expression", "'C', (doc_id * 5) % 97", "true"),
    (7, "interface_declaration", "'I', doc_id % 17", "doc_id % 4 = 0"),
    (8, "method_declaration", "'m', doc_id % 31", "doc_id % 4 = 0"),
)
JAVA_NODES = " union all ".join(
    f"""select concat('f', cast(doc_id as {{str}})) as file, {pre} as pre, '{kind}' as type, concat({name}) as name,
  {"case when doc_id % 3 = 0 then concat('C', (doc_id * 7) % 97) end" if pre == 2 else "cast(null as {str})"} as superclass,
  {"case when doc_id % 5 = 0 then concat('I', doc_id % 17) end" if pre == 2 else "cast(null as {str})"} as first_interface,
  {"case when doc_id % 5 = 0 then concat('I', (doc_id * 5) % 17) end" if pre == 2 else "cast(null as {str})"} as second_interface from {{documents}} where {when}"""
    for pre, kind, name, when in _NODE_ROWS
)

#: Names that dependencies of frameworks and others are made of, by turns of the id.
DEPENDENCIES = """
select doc_id, case doc_id % 5 when 0 then 'javascript' when 1 then 'python' when 2 then 'java' when 3 then 'go' else 'rust' end as ecosystem,
  case doc_id % 12 when 0 then 'React' when 1 then 'fastapi' when 2 then 'spring-boot' when 3 then 'github.com/gin-gonic/gin' when 4 then 'axum' when 5 then '@angular/core' when 6 then 'flask' when 7 then 'next'
    when 8 then 'spring-boot-starter-web' when 9 then '@nestjs/common' when 10 then 'Django' else concat('x', cast(doc_id as {str})) end as name from {documents}"""

NODES = """
select concat('f', cast(user_id as {str})) as file, event_id as pre, type, name,
  case when type = 'class_declaration' and event_id % 3 = 0 then concat('C', cast((event_id * 7) % 97 as {str})) end as superclass,
  case when type = 'class_declaration' and event_id % 5 < 2 then concat('I', cast((event_id * 3) % 17 as {str})) end as first_interface,
  case when type = 'class_declaration' and event_id % 5 < 1 then concat('I', cast((event_id * 5) % 17 as {str})) end as second_interface
from (select user_id, event_id, type, case type when 'package_declaration' then concat('p', cast(event_id % 7 as {str})) when 'import_declaration' then concat('lib.x', cast(event_id % 13 as {str}))
    when 'interface_declaration' then concat('I', cast(event_id % 17 as {str})) when 'class_declaration' then concat('C', cast(event_id % 97 as {str})) when 'object_creation_expression' then concat('C', cast(event_id % 97 as {str}))
    when 'field_declaration' then concat('f', cast(event_id % 97 as {str})) else concat('m', cast(event_id % 97 as {str})) end as name
  from (select user_id, event_id, case when event_id % 53 = 0 then 'package_declaration' when event_id % 59 = 0 then 'import_declaration' when event_id % 31 = 0 then 'interface_declaration'
      when event_type = 'signup' then 'class_declaration' when event_type = 'click' then 'method_declaration' when event_type = 'view' then 'method_invocation' when event_type = 'purchase' then 'object_creation_expression'
      else 'field_declaration' end as type from {events}) a) b"""


def _spark(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.format(str="string", documents="{documents}", events="{events}"), **{table: source})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, FILES, "documents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, EVENTS, "documents")


def manifests(spark: SparkSession, sf_dir: str, parser: str) -> DataFrame:
    """doc_id and content."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return source.select("doc_id", F.expr(MANIFESTS[parser].format(str="string")).alias("content"))


def all_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name and content: a manifest of each kind for each document, one that can't be read, and a file that is none."""
    parts = [manifests(spark, sf_dir, p).select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(f"/{name}")).alias("path"), F.lit(name).alias("name"), "content") for p, name in MANIFEST_NAMES.items()]
    parts.append(parts[0].select("path", F.lit("build.gradle.kts").alias("name"), F.lit(None).cast("string").alias("content")))
    parts.append(parts[0].select("path", F.lit("Package.json").alias("name"), "content"))
    return reduce(DataFrame.unionByName, parts)


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return source.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.expr(JAVA.format(str="string")).alias("content"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, DEPENDENCIES, "documents")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _spark(spark, sf_dir, NODES, "events")
    return found.select("file", "pre", "type", "name", "superclass", F.array_compact(F.array("first_interface", "second_interface")).alias("interfaces"))


def duck(sql: str) -> str:
    return sql.format(str="varchar", documents="documents", events="events")
