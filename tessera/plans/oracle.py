"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tessera.functions.classify import HEAD_BYTES
from tessera.model import FILE_CATEGORIES
from tessera.operators.code_graph import EdgeBuilder
from tessera.plans import inputs
from tessera.plans.queries import LARGE, LIMITS, USER_RULES
from tessera.rules import CLASSIFICATION, FRAMEWORKS, MANIFESTS


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _category_test(rule: dict[str, list[str]]) -> str:
    tests = []
    if rule.get("filenames"):
        tests.append(f"low_name in ({_quoted(rule['filenames'])})")
    if rule.get("directories"):
        tests.append(f"list_has_any(string_split(low, '/'), [{_quoted(rule['directories'])}])")
    tests += [f"contains(low_name, '{v}')" for v in rule.get("filename_contains", ())]
    tests += [f"starts_with(low_name, '{v}')" for v in rule.get("filename_prefixes", ())]
    tests += [f"suffix(low_name, '{v}')" for v in rule.get("filename_suffixes", ())]
    return " or ".join(tests)


def _values(rows) -> str:
    return ", ".join("(" + _quoted(row) + ")" for row in rows)


def _files(rules=CLASSIFICATION) -> str:
    """A with clause that ends with the table f."""
    test = {k: _category_test({part: [v.lower() for v in values] for part, values in rules.get(k, {}).items()}) or "false" for k in CLASSIFICATION}
    return f"""v as ({inputs.duck(inputs.FILES)}),
g as (select *, list_last(string_split(rel_path, '/')) as name, lower(rel_path) as low, lower(list_last(string_split(rel_path, '/'))) as low_name from v),
f as (select doc_id, rel_path as relative_path, name, size, language, is_binary, is_symlink,
  case when regexp_matches(name, '^.+\\.[^.]+$') then regexp_extract(name, '\\.[^.]+$') else '' end as extension, starts_with(name, '.') as is_hidden, size > {LARGE} as is_large,
  case when {test['generated']} then 'generated' when {test['build']} then 'build' when is_binary then 'asset' when {test['documentation']} then 'documentation' when {test['test']} then 'test'
    when {test['configuration']} then 'configuration' when language is not null then 'source' else 'unknown' end as category from g),
d as (select distinct array_to_string(parts[1:n], '/') as relative_path from (select parts, unnest(range(1, len(parts))) as n from (select string_split(relative_path, '/') as parts from f) a) b)"""


_CATEGORIES = ", ".join(f"count(*) filter (where category = '{c}') as {c}_files" for c in FILE_CATEGORIES)
_FLAGS = ", ".join(f"count(*) filter (where is_{f}) as {f}_files" for f in ("binary", "large", "hidden", "symlink"))


#: The ignore patterns of the queries, each as a hand-written test of a path p.
_IGNORE = """case when regexp_matches({p}, '(^|/)test_unit[0-4][^/]*($|/)') then true
  when regexp_matches({p}, '^docs/README\\.md($|/)') then false
  when regexp_matches({p}, '^docs/.') then true
  when regexp_matches({p}, '^lib/main[^/]*($|/)') then true
  when regexp_matches({p}, '(^|/)__pycache__($|/)') then true
  when regexp_matches({p}, '(^|/)dist/.') then true
  when regexp_matches({p}, '(^|/)package\\.json($|/)') then false
  when regexp_matches({p}, '(^|/)[^/]*\\.json($|/)') then true
  else false end"""


def _limited(name: str) -> str:
    limits = LIMITS[name]
    trips = []
    over = "over (order by pos rows between unbounded preceding and current row)"
    if limits.max_files is not None:
        trips.append(f"sum(case when kind = 'file' then 1 else 0 end) {over} > {limits.max_files}")
    if limits.max_directories is not None:
        trips.append(f"sum(case when kind = 'directory' then 1 else 0 end) {over} > {limits.max_directories}")
    if limits.max_total_size is not None:
        trips.append(f"(kind = 'file' and sum(case when kind = 'file' then size else 0 end) {over} > {limits.max_total_size})")
    return f"with e as ({inputs.duck(inputs.EVENTS)}), t as (select *, {' or '.join(trips)} as trips from e) select pos, kind, size from t where pos < coalesce((select min(pos) from t where trips), 9223372036854775807)"


_STRIP = "trim({}, concat(' ', chr(9), chr(10), chr(13)))"
_NORMAL = "lower(" + _STRIP.format("regexp_extract(regexp_extract({0}, '^[^\\[]*'), '^[^<>=!~]*')") + ")"


def _dependencies() -> dict[str, str]:
    content = {p: f"m as (select doc_id, {inputs.duck(sql)} as content from documents)" for p, sql in inputs.MANIFESTS.items()}
    lines = "l as (select doc_id, " + _STRIP.format("line") + " as line, pos from (select doc_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as pos from m) x)"
    sections = " union all ".join(f"select doc_id, unnest(json_keys(content, '$.{k}')) as name from v where json_exists(content, '$.{k}')" for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))
    found = lambda table, pattern, group=1: f"unnest(regexp_extract_all(content, '{pattern}', {group})) as name from {table}"
    return {
        "deps_json": f"with {content['json']}, v as (select doc_id, cast(content as json) as content from m where json_valid(content)) select distinct doc_id, lower(name) as name from ({sections}) s",
        "deps_requirements": f"with {content['requirements']}, {lines} select distinct doc_id, {_NORMAL.format('line')} as name from l where line <> '' and not starts_with(line, '#') and not starts_with(line, '-r')",
        "deps_gradle": f"with {content['gradle']}, r as (select doc_id, unnest(regexp_extract_all(lower(content), '(?:implementation|api)\\s+[\"'']([^\"'']+)', 1)) as s from m), p as (select doc_id, string_split(s, ':') as parts from r) select distinct doc_id, parts[-2] as name from p where len(parts) >= 2",
        "deps_gomod": f"with {content['gomod']}, {lines}, b as (select *, max(case when line = 'require (' then pos end) over w as opened, max(case when line = ')' then pos end) over w as closed from l window w as (partition by doc_id order by pos rows between unbounded preceding and current row)) "
        "select distinct doc_id, lower(regexp_extract(line, '^\\S+')) as name from b where opened > coalesce(closed, 0) and opened < pos and line <> '' and line <> 'require ('",
        "deps_maven": f"with {content['maven']} select distinct doc_id, lower({_STRIP.format('name')}) as name from (select doc_id, {found('m', '<artifactId>([^<]*)</artifactId>')} where content like '%</project>') s",
        "deps_pyproject": f"with {content['pyproject']} select distinct doc_id, {_NORMAL.format('name')} as name from (select doc_id, {found('m', '\"([^\"]*)\"')} where content like '[project]%') s",
        "deps_cargo": f"with {content['cargo']}, t as (select doc_id, regexp_extract(content, '^\\[dependencies\\]\\n([^\\[]*)', 1) as content from m) select distinct doc_id, lower(name) as name from (select doc_id, {found('t', '([A-Za-z0-9_-]+) = ')}) s",
    }


def _frameworks() -> str:
    rows = ", ".join(f"('{f.name}', '{f.ecosystem}', [{_quoted(f.dependencies)}]::varchar[], [{_quoted(f.dependency_prefixes)}]::varchar[])" for f in FRAMEWORKS)
    return f"""w(framework, of_ecosystem, names, prefixes) as (values {rows}), n as ({inputs.duck(inputs.DEPENDENCIES)}),
j as (select doc_id, ecosystem, name as dependency, framework from n join w on ecosystem = of_ecosystem and (list_contains(names, lower(name)) or len(list_filter(prefixes, lambda p: starts_with(lower(name), p))) > 0))"""


def _facts(nodes: str = inputs.NODES) -> str:
    """A with clause that ends with a table for each kind of fact."""
    seen = lambda *types: f"last_value(case when type in ({_quoted(types)}) then name end ignore nulls) over w"
    return f"""a as ({inputs.duck(nodes)}),
s as (select *, {seen('package_declaration')} as pkg, {seen('class_declaration')} as cls, {seen('class_declaration', 'interface_declaration')} as typ, {seen('method_declaration')} as mth from a
  window w as (partition by file order by pre rows between unbounded preceding and current row)),
packages as (select file, pre, name from s where type = 'package_declaration'),
imports as (select file, pre, name from s where type = 'import_declaration'),
classes as (select file, pre, pkg as package, name from s where type = 'class_declaration'),
interfaces as (select file, pre, pkg as package, name from s where type = 'interface_declaration'),
methods as (select file, pre, typ as parent, name from s where type = 'method_declaration'),
fields as (select file, pre, cls as parent, name from s where type = 'field_declaration'),
calls as (select file, pre, cls as caller_parent, mth as caller, cast(null as varchar) as callee_parent, name as callee from s where type = 'method_invocation'),
creations as (select file, pre, cls as owner_parent, coalesce(mth, cls) as owner_name, case when mth is null then 'class' else 'method' end as owner_type, name as object_type from s where type = 'object_creation_expression'),
extends_ as (select file, pre, name as child_class, superclass as parent_class from s where type = 'class_declaration' and superclass is not null),
implements_ as (select file, pre, name as class_name, first_interface as interface_name from s where first_interface is not null union all select file, pre, name, second_interface from s where second_interface is not null)"""


def _edges() -> dict[str, str]:
    contains = lambda t, p: f"select distinct p.name as package_name, n.package as {p}_package, n.name as {p}_name from packages p join {t} c on c.file = p.file join {t} n on n.package = p.name and n.name = c.name"
    member = lambda t, p, m, k: f"select distinct c.package as {p}_package, c.name as {p}_name, m.parent as {k}_parent, m.name as {k}_name from {t} c join {m} m on m.parent = c.name"
    return {
        "contains_class": contains("classes", "class"),
        "contains_interface": contains("interfaces", "interface"),
        "class_declares": member("classes", "class", "methods", "method"),
        "interface_declares": member("interfaces", "interface", "methods", "method"),
        "has_field": member("classes", "class", "fields", "field"),
        "extends": "select distinct c.package as child_package, c.name as child_name, p.package as parent_package, p.name as parent_name from extends_ e join classes c on c.name = e.child_class join classes p on p.name = e.parent_class",
        "implements": "select distinct c.package as class_package, c.name as class_name, i.package as interface_package, i.name as interface_name from implements_ e join classes c on c.name = e.class_name join interfaces i on i.name = e.interface_name",
        "calls": "select distinct a.parent as caller_parent, a.name as caller_name, b.parent as callee_parent, b.name as callee_name from (select distinct caller_parent, caller, callee from calls) c join (select distinct parent, name from methods) a on a.parent = c.caller_parent and a.name = c.caller join (select distinct parent, name from methods) b on b.name = c.callee",
        "creates": "select distinct m.parent as method_parent, m.name as method_name, k.package as class_package, k.name as class_name from (select distinct owner_parent, owner_name, object_type from creations) c join (select distinct parent, name from methods) m on m.parent = c.owner_parent and m.name = c.owner_name join (select distinct package, name from classes) k on k.name = c.object_type",
    }


#: Languages of the names that occur (fixed values), by what the name ends with.
_LANGUAGES = (("requirements.txt", "Text only"), ("argo.toml", "TOML"), (".py", "Python"), (".js", "JavaScript"), (".java", "Java"), (".md", "Markdown"), (".json", "JSON"), (".go", "Go"))


def _extracted() -> str:
    """A select of name, ecosystem and source_file over all manifests."""
    ecosystem = {m["filename"]: m["ecosystem"] for m in MANIFESTS}
    own = _dependencies()
    return " union all ".join(f"select name, '{ecosystem[name]}' as ecosystem, concat('r', doc_id, '/{name}') as source_file from ({own[f'deps_{parser}']}) as x_{parser}" for parser, name in inputs.MANIFEST_NAMES.items())


def _told(dependencies: str) -> str:
    """Names of the frameworks that a select of name and ecosystem tells."""
    rows = ", ".join(f"('{f.name}', '{f.ecosystem}', [{_quoted(f.dependencies)}]::varchar[], [{_quoted(f.dependency_prefixes)}]::varchar[])" for f in FRAMEWORKS)
    return f"select distinct framework as name from ({dependencies}) n join (values {rows}) w(framework, of_ecosystem, names, prefixes) on n.ecosystem = of_ecosystem and (list_contains(names, lower(n.name)) or len(list_filter(prefixes, lambda p: starts_with(lower(n.name), p))) > 0)"


def _graph(nodes: str) -> tuple[str, str, str]:
    """A with clause, and selects of all nodes and all edges in one shape."""
    keys = (("Package", "packages", "null"), ("Class", "classes", "package"), ("Interface", "interfaces", "package"), ("Method", "methods", "parent"), ("Field", "fields", "parent"))
    all_nodes = " union all ".join(f"select distinct '{label}' as label, cast({scope} as varchar) as scope, name from {table}" for label, table, scope in keys)
    parts = []
    for method, kind, source, target in EdgeBuilder.KINDS:
        first = 1 if source == "Package" else 2
        names = _EDGE_COLUMNS[method]
        scope = names[0] if first == 2 else "null"
        parts.append(f"select '{kind}' as type, '{source}' as src_label, cast({scope} as varchar) as src_scope, {names[first - 1]} as src_name, '{target}' as dst_label, {names[first]} as dst_scope, {names[first + 1]} as dst_name from ({_edges()[method]}) as y_{method}")
    return f"with {_facts(nodes)} ", all_nodes, " union all ".join(parts)


#: Key columns of each kind of edge, source first.
_EDGE_COLUMNS = {
    "contains_class": ("package_name", "class_package", "class_name"),
    "contains_interface": ("package_name", "interface_package", "interface_name"),
    "class_declares": ("class_package", "class_name", "method_parent", "method_name"),
    "interface_declares": ("interface_package", "interface_name", "method_parent", "method_name"),
    "has_field": ("class_package", "class_name", "field_parent", "field_name"),
    "extends": ("child_package", "child_name", "parent_package", "parent_name"),
    "implements": ("class_package", "class_name", "interface_package", "interface_name"),
    "calls": ("caller_parent", "caller_name", "callee_parent", "callee_name"),
    "creates": ("method_parent", "method_name", "class_package", "class_name"),
}


def _more(files: str) -> dict[str, str]:
    """SQL of the loaders, of scans, of whole models and of whole graphs."""
    names = sorted({*_TABLES} - {"labels"})
    java, java_nodes, java_edges = _graph(inputs.JAVA_NODES)
    derived, nodes, edges = _graph(inputs.NODES)
    own = _dependencies()
    ecosystem = {m["filename"]: m["ecosystem"] for m in MANIFESTS}
    # Manifests among the derived files; the others occur under no name of a manifest.
    found = " union all ".join(f"select x_{p}.name, '{ecosystem[n]}' as ecosystem from ({own[f'deps_{p}']}) as x_{p} join f on f.doc_id = x_{p}.doc_id and f.name = '{n}'" for p, n in inputs.MANIFEST_NAMES.items())
    kinds = ("packages", "imports", "classes", "interfaces", "methods", "fields", "calls", "creations", "extends", "implements")
    return {
        "rules_classification": f"select * from (values {_values((c, p, v) for c, parts in CLASSIFICATION.items() for p, values in parts.items() for v in values)}) t(category, part, value)",
        "rules_manifests": f"select * from (values {_values((m['filename'], m['ecosystem'], m['parser']) for m in MANIFESTS)}) t(filename, ecosystem, parser)",
        "rules_frameworks": f"select * from (values {_values((f.name, f.ecosystem, ','.join(f.dependencies), ','.join(f.dependency_prefixes)) for f in FRAMEWORKS)}) t(name, ecosystem, dependencies, dependency_prefixes)",
        "file_user_rules": f"with {_files(USER_RULES)} select doc_id, category from f",
        "ignore_custom": files + f"select doc_id, relative_path from f where not ({_IGNORE.format(p='relative_path')})",
        "text_decode": "select doc_id, case when doc_id % 4 = 0 then null else length(coalesce(text, '')) end as n_chars from documents",
        "scan_tables": f"select concat(n, '.parquet') as relative_path, concat(n, '.parquet') as name, '.parquet' as extension, false as is_hidden, false as is_symlink, true as is_binary, false as is_large, 'asset' as category from (values {_values((n,) for n in names)}) t(n)",
        "language_detection": files + f"select doc_id, name, case {' '.join(f"when suffix(name, '{end}') then '{language}'" for end, language in _LANGUAGES)} end as language from f",
        "dependency_extract": _extracted(),
        "framework_detect": _told(_extracted()),
        "parser_registered": "select unnest(['a', concat('b', doc_id % 3)]) as name, 'own' as ecosystem, cast(doc_id as varchar) as source_file from documents",
        "repository_build": files + f"select 'derived' as name, count(*) as total_files, (select count(*) from d) as total_directories, count(*) filter (where category = 'source') as source_files, count(*) filter (where is_binary) as binary_files, (select count(*) from ({found}) a) as total_dependencies, (select count(distinct ecosystem) from ({found}) b) as ecosystems, (select string_agg(name, ',' order by name) from ({_told(found)}) c) as frameworks from f",
        "parsed_files": f"with {_facts()} select file, kind, count(*) as facts from ({' union all '.join(f"select file, '{k}' as kind from {k}{'_' if k in ('extends', 'implements') else ''}" for k in kinds)}) x group by file, kind",
        "java_nodes": f"select file, pre, type, name, superclass, concat_ws(',', first_interface, second_interface) as interfaces from ({inputs.duck(inputs.JAVA_NODES)}) x",
        "graph_nodes": java + java_nodes,
        "graph_edges": java + java_edges,
        "graph_merge": derived + f"select label as kind, count(*) as stored from ({nodes}) x group by label union all select type, count(*) from ({edges}) y group by type",
    }


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def oracle_sql() -> dict[str, str]:
    files = f"with {_files()} "
    languages = "(select string_agg(language || '=' || n, ',' order by language) from (select language, count(*) as n from f where coalesce(language, '') <> '' group by language) x)"
    above = "exists (select 1 from (select unnest(range(1, len(string_split(relative_path, '/')))) as n) r where " + _IGNORE.format(p="array_to_string(string_split(relative_path, '/')[1:n], '/')") + ")"
    out = {
        "file_projection": files + "select doc_id, relative_path, name, extension, size from f",
        "file_hidden_large": files + "select doc_id, is_hidden, is_large from f",
        "file_classification": files + "select doc_id, relative_path, category from f",
        "category_counts": files + f"select {_CATEGORIES} from f",
        "flag_counts": files + f"select {_FLAGS} from f",
        "language_histogram": files + "select language, count(*) as files from f where coalesce(language, '') <> '' group by language",
        "repository_metadata": files + f"select count(*) as total_files, {_CATEGORIES}, {_FLAGS}, (select count(*) from d) as total_directories, {languages} as languages from f",
        "directory_listing": files + "select relative_path, list_last(string_split(relative_path, '/')) as name, starts_with(list_last(string_split(relative_path, '/')), '.') as is_hidden from d",
        "ignore_filter": files + "select doc_id, relative_path from f where not " + f"({_IGNORE.format(p='relative_path')})",
        "directory_prune": files + "select doc_id, relative_path from f where not " + f"({_IGNORE.format(p='relative_path')}) and not {above}",
        "binary_sniff": f"select doc_id, case when doc_id % 4 = 0 then true when doc_id % 4 = 1 then false else contains(left(text, {HEAD_BYTES}), chr(0)) end as is_binary from documents",
        "manifest_lookup": files + f", m(filename, ecosystem, parser) as (values {', '.join(str(tuple(m[k] for k in ('filename', 'ecosystem', 'parser'))) for m in MANIFESTS)}) select doc_id, name, ecosystem, parser from f join m on name = filename",
        "framework_match": f"with {_frameworks()} select doc_id, ecosystem, dependency, framework from j",
        "framework_list": f"with {_frameworks()} select distinct framework as name from j",
    }
    out |= {name: _limited(name) for name in LIMITS}
    out |= _dependencies()
    out |= _more(files)
    facts = f"with {_facts()} "
    for name in ("packages", "imports", "classes", "interfaces", "methods", "fields", "calls", "creations", "extends", "implements"):
        out[f"ast_{name}"] = facts + f"select * from {name}{'_' if name in ('extends', 'implements') else ''}"
    out |= {"nodes_package": facts + "select distinct name from packages"}
    out |= {f"nodes_{k}": facts + f"select distinct package, name from {t}" for k, t in (("class", "classes"), ("interface", "interfaces"))}
    out |= {f"nodes_{k}": facts + f"select distinct parent, name from {t}" for k, t in (("method", "methods"), ("field", "fields"))}
    out |= {f"edges_{k}": facts + sql for k, sql in _edges().items()}
    number = "cast(substr({}.file, 2) as bigint)"
    out["edges_declares_incremental"] = facts + f"select distinct c.package as class_package, c.name as class_name, m.parent as method_parent, m.name as method_name from classes c join methods m on m.parent = c.name and {number.format('c')} <= {number.format('m')}"
    return out
