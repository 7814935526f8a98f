"""Facts from source files: syntax-tree facts of Python, contract graphs, compose graphs, calls, endpoints and configuration.

Regular expressions run as column functions; only syntax trees and YAML are parsed in Python, once per file, in a narrow pass
that emits tagged rows.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that recognise calls, endpoints and configuration references.
PY_CALLS = [r"requests\.(?i:(get|post|put|delete|patch|head|options))\s*\(\s*['\"]?([^'\")\s,]+)", r"httpx\.(?i:(get|post|put|delete|patch|head|options))\s*\(\s*['\"]?([^'\")\s,]+)", r"session\.(?i:(get|post|put|delete|patch|head|options))\s*\(\s*['\"]?([^'\")\s,]+)"]
PY_URLOPEN = r"urlopen\s*\(\s*['\"]([^'\"]+)['\"]"
JS_CALLS = [r"axios\.(?i:(get|post|put|delete|patch))\s*\(\s*['\"`]([^'\"`]+)['\"`]", r"request\.(?i:(get|post|put|delete|patch))\s*\(\s*['\"`]([^'\"`]+)['\"`]"]
JS_FETCH = r"fetch\s*\(\s*['\"`]([^'\"`]+)['\"`](?:\s*,\s*\{((?:[^{}]|\{[^{}]*\})*)\})?"
FLASK = r"@\w+\.route\s*\(\s*['\"]([^'\"]+)['\"](?:[^\n]*?methods\s*=\s*\[([^\]]+)\])?"
FASTAPI = r"@\w+\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)['\"]"
DJANGO = r"\bpath\s*\(\s*['\"]([^'\"]+)['\"]"
EXPRESS = r"(?:app|router)\.(get|post|put|delete|patch|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
NEST = r"@(Get|Post|Put|Delete|Patch)\s*\(\s*['\"`]?([^'\"`)\s]*)['\"`]?\s*\)"
PY_CONFIG = [r"os\.environ(?:\.get)?\s*\[\s*['\"](\w+)['\"]\s*\]", r"os\.getenv\s*\(\s*['\"](\w+)['\"]", r"os\.environ\.get\s*\(\s*['\"](\w+)['\"]", r"\bconfig\s*\(\s*['\"](\w+)['\"]"]
JS_CONFIG = [r"process\.env\.(\w+)", r"process\.env\s*\[\s*['\"](\w+)['\"]\s*\]"]
CONTRACT = r"(?m)^\s*(contract|interface|library|abstract\s+contract)\s+(\w+)"
PARENTS = r"(?m)^\s*(?:contract|interface|library|abstract\s+contract)\s+\w+\s+is\s+([^{]+)"
CONSTRUCTOR = r"(?s)constructor\s*\([^)]*\)[^{]*\{([^}]*)\}"
STATE_VARIABLE = r"(?m)^\s*(\w+)\s+(?:public|private|internal)?\s*(\w+)\s*;"
MEMBER_CALL = r"(\w+)\s*\.\s*(\w+)\s*\("


def every(column: str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(pattern), group)


# --- contracts --------------------------------------------------------------------------------


def contracts(files: DataFrame) -> DataFrame:
    """``(project_id, path, name, kind)`` of every declaration."""
    both = F.arrays_zip(every("content", CONTRACT, 1).alias("kind"), every("content", CONTRACT, 2).alias("name"))
    return files.where("ext = '.sol'").select("project_id", "path", F.explode(both).alias("c")).select("project_id", "path", F.col("c.name").alias("name"), F.regexp_replace("c.kind", r"\s+", " ").alias("kind"))


def contract_edges(files: DataFrame) -> DataFrame:
    """Edges between contracts: ``project_id, src, dst, edge_type, atomic, seq``.

    What a file mentions counts for every contract whose last declaration is in it. Inheritance and state variables are STATE,
    ``new X(`` in a constructor is atomic STATE, a cast there is ADDR, and a call on something named after a contract RUNTIME.
    Exact names join by equality; the two looser kinds compare names within a project.
    """
    sol = files.where("ext = '.sol'")
    decl = contracts(files)
    names = decl.select("project_id", F.col("name").alias("target")).distinct()
    own = decl.groupBy("project_id", F.col("name").alias("owner")).agg(F.max("path").alias("path"))
    body = F.array_join(every("content", CONSTRUCTOR, 1), "\n;\n")
    parents = F.flatten(F.transform(every("content", PARENTS, 1), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.regexp_replace(F.substring_index(y, "(", 1), r"\s+", " ")))))
    texts = sol.select("project_id", "path", "content", body.alias("body"))

    def mentions(column: Column, kind: str, atomic: bool, rank: int) -> DataFrame:
        return texts.select("project_id", "path", F.explode(F.array_distinct(column)).alias("word"), F.lit(kind).alias("edge_type"), F.lit(atomic).alias("atomic"), F.lit(rank).alias("seq"))

    inherited = sol.select("project_id", "path", F.explode(parents).alias("word"), F.lit("STATE").alias("edge_type"), F.lit(False).alias("atomic"), F.lit(1).alias("seq"))
    created = mentions(every("body", r"\bnew\s+(\w+)\s*\(", 1), "STATE", True, 2)
    variables = texts.select("project_id", "path", F.explode(every("content", STATE_VARIABLE, 1)).alias("word"), F.lit("STATE").alias("edge_type"), F.lit(False).alias("atomic"), F.lit(4).alias("seq"))
    exact = inherited.unionByName(created).unionByName(variables).join(names.withColumnRenamed("target", "word"), ["project_id", "word"]).withColumnRenamed("word", "target")
    bodies = sol.select("project_id", "path", F.posexplode(every("content", CONSTRUCTOR, 1)).alias("n", "body"))
    casts = bodies.select("project_id", "path", "n", F.explode(F.array_distinct(every("body", r"(\w+)\s*\(\s*\w+\s*\)", 1))).alias("word"), F.lit("ADDR").alias("edge_type"), F.lit(False).alias("atomic"), F.lit(3).alias("seq"))
    casts = casts.join(names, "project_id").where(F.col("word").endswith(F.col("target"))).drop("word").distinct().drop("n")
    calls = mentions(every("content", MEMBER_CALL, 1), "RUNTIME", False, 5).join(names, "project_id").where(F.lower("word").contains(F.lower("target"))).drop("word").distinct()
    found = exact.unionByName(casts).unionByName(calls)
    edges = found.join(own, ["project_id", "path"]).where((F.col("owner") != F.col("target")) | (F.col("seq") == 1))
    node = lambda c: F.concat(F.lit("sol:"), F.col(c))
    return edges.select("project_id", node("owner").alias("src"), node("target").alias("dst"), "edge_type", "atomic", "seq")


# --- compose ----------------------------------------------------------------------------------

EDGE = "project_id string, src string, dst string, edge_type string, atomic boolean, seq int"


def service_kind(name: Column, image: Column) -> Column:
    """Kind of a service by its name or image; anything like a database comes first."""
    has = lambda words: F.lower(F.concat_ws(" ", name, image)).rlike("|".join(words))
    return F.when(has(["postgres", "mysql", "mariadb", "mongo", "redis", "memcache"]), "database").when(has(["rabbit", "kafka", "celery"]), "queue").otherwise("service")


def _services(text: str | None) -> dict:
    import yaml

    try:
        doc = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return {}
    found = doc.get("services") if isinstance(doc, dict) else None
    return {str(k): v for k, v in found.items() if isinstance(v, dict)} if isinstance(found, dict) else {}


def _compose_edges(services: dict) -> list[tuple[str, str, str, bool]]:
    import re

    out = []
    word = {s: re.compile(rf"\b{re.escape(s)}\b") for s in services}
    for name, spec in services.items():
        needs = spec.get("depends_on") or []
        conditions = needs if isinstance(needs, dict) else {d: None for d in needs if isinstance(d, str)}
        for dep, how in conditions.items():
            if dep in services:
                state = how.get("condition") if isinstance(how, dict) else None
                out.append((name, dep, "ADDR" if state == "service_started" else "STATE", state == "service_healthy"))
        for link in spec.get("links") or []:
            if isinstance(link, str) and (target := link.split(":")[0]) in services:
                out.append((name, target, "ADDR", False))
        env = spec.get("environment") or []
        for item in [f"{k}={v}" for k, v in env.items()] if isinstance(env, dict) else map(str, env):
            other = next((s for s in services if s != name and word[s].search(item)), None)
            if other:
                out.append((name, other, "RUNTIME", False))
    return out


COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def compose_services(files: DataFrame) -> DataFrame:
    """``project_id, path, name, image`` of the services of compose files."""
    schema = "project_id string, path string, name string, image string"

    def run(batches):
        for b in batches:
            out = [(project, path, name, str(spec.get("image", ""))) for project, path, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for name, spec in _services(t).items()]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["project_id", "path", "name", "image"])

    return files.where(F.col("name").isin(*COMPOSE)).select("project_id", "path", "content").mapInArrow(run, schema)


def compose_edges(files: DataFrame) -> DataFrame:
    """Edges between the services of compose files: dependencies, links and mentions in the environment (the first other service of each item)."""
    rows = files.where(F.col("name").isin(*COMPOSE)).select("project_id", "content")

    def run(batches):
        for b in batches:
            out = []
            for project, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(project, f"docker:{a}", f"docker:{d}", kind, atomic, i) for i, (a, d, kind, atomic) in enumerate(_compose_edges(_services(text)))]
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in EDGE.split(", ")])

    return rows.mapInArrow(run, EDGE)


def yaml_verdicts(files: DataFrame, fine) -> DataFrame:
    """``project_id, path, fine``: what a predicate says of each YAML file's document; a file that doesn't parse fails."""
    key = dict(files.dtypes)["project_id"]

    def verdict(text: str | None) -> bool:
        import yaml

        try:
            return bool(fine(yaml.safe_load(text or "")))
        except yaml.YAMLError:
            return False

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([verdict(t) for t in b.column(2).to_pylist()], pa.bool_())], ["project_id", "path", "fine"])

    return files.select("project_id", "path", "content").mapInArrow(run, f"project_id {key}, path string, fine boolean")


# --- Python syntax trees ----------------------------------------------------------------------

FACT = "project_id string, path string, kind string, name string, detail string, line_no int, value int"


def branch_points(node: ast.AST) -> int:
    """1 plus the points where control can branch below a node; nested functions count too."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.Assert, ast.Raise, ast.Match, ast.match_case)):
            n += 1
    return n


def _python_facts(text: str | None) -> list[tuple]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return [("unparseable", "", "", 0, 0)]
    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out += [("import", a.name, "", x.lineno, 0) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out += [("import_from", x.module or "", a.name, x.lineno, x.level) for a in x.names]
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", x.name, "", x.lineno, branch_points(x)))
            if not ast.get_docstring(x) and not x.name.startswith("_"):
                out.append(("smell", "C0116", x.name, x.lineno, 0))
        elif isinstance(x, ast.If):
            if isinstance(x.test, ast.Compare) and isinstance(x.test.left, ast.Name) and x.test.left.id == "__name__":
                out.append(("main_guard", "", "", x.lineno, 0))
        elif isinstance(x, ast.While):
            if isinstance(x.test, ast.Constant) and x.test.value is True:
                out.append(("endless", "", "", x.lineno, 0))
        elif isinstance(x, ast.ClassDef):
            out.append(("class", x.name, ",".join(ast.unparse(b) for b in x.bases), x.lineno, 0))
            if not ast.get_docstring(x):
                out.append(("smell", "C0115", x.name, x.lineno, 0))
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """One parse per Python file: imports, functions with complexity, classes, missing docstrings, and whether it parses."""
    rows = files.where(F.col("ext") == ".py").select("project_id", "path", "content")

    def run(batches):
        names = [x.split()[0] for x in FACT.split(", ")]
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        for b in batches:
            out = [(p, f, *fact) for p, f, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for fact in _python_facts(text)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return rows.mapInArrow(run, FACT)


# --- calls, endpoints, configuration ----------------------------------------------------------


def _pairs(pattern: str, method: int, path: int, none: str = "GET") -> Column:
    paths = every("content", pattern, path)
    methods = every("content", pattern, method) if method else F.transform(paths, lambda _: F.lit(none))
    return F.transform(F.arrays_zip(methods.alias("m"), paths.alias("p")), lambda x: F.struct(F.upper(F.when(x["m"] == "", none).otherwise(x["m"])).alias("method"), x["p"].alias("path")))


def _by_language(files: DataFrame, python: list[Column], js: list[Column]) -> DataFrame:
    rows = files.select("project_id", F.col("path").alias("file"), F.explode(F.when(F.col("ext") == ".py", F.concat(*python)).when(F.col("ext").isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), F.concat(*js))).alias("x"))
    return rows.select("project_id", "file", "x.*")


def api_calls(files: DataFrame) -> DataFrame:
    """HTTP calls: ``project_id, file, method, path``. A fetch takes the method from the options of that very call."""
    fetch = F.transform(F.arrays_zip(every("content", JS_FETCH, 1).alias("p"), every("content", JS_FETCH, 2).alias("o")), lambda x: F.struct(F.upper(F.coalesce(F.nullif(F.regexp_extract(x["o"], r"method\s*:\s*['\"`](\w+)", 1), F.lit("")), F.lit("GET"))).alias("method"), x["p"].alias("path")))
    return _by_language(files, [*[_pairs(p, 1, 2) for p in PY_CALLS], _pairs(PY_URLOPEN, 0, 1)], [*[_pairs(p, 1, 2) for p in JS_CALLS], fetch])


def _decorated_endpoints(files: DataFrame) -> DataFrame:
    """Endpoints that Python and JavaScript code registers; Koa's routers read like Express's, Django answers any method."""
    flask = F.flatten(F.transform(F.arrays_zip(every("content", FLASK, 1).alias("p"), every("content", FLASK, 2).alias("m")), lambda x: F.transform(F.split(F.when(x["m"] == "", "GET").otherwise(x["m"]), ","), lambda m: F.struct(F.upper(F.regexp_replace(m, r"[\s'\"]", "")).alias("method"), x["p"].alias("path")))))
    return _by_language(files, [flask, _pairs(FASTAPI, 1, 2), _pairs(DJANGO, 0, 1, "*")], [_pairs(EXPRESS, 1, 2), _pairs(NEST, 1, 2)])


#: Methods of HTTP, and extensions of files that are routes.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
ROUTE_FILE = r"^(?:src/)?app/api/(?:(.*)/)?route\.(?:js|jsx|ts|tsx|mjs)$"
PAGE_FILE = r"^(?:src/)?pages/api/(.*)\.(?:js|jsx|ts|tsx|mjs)$"


def route_path(inner: Column) -> Column:
    """The URL path of a route's folders: ``users/[id]`` is ``/api/users/{id}``; a catch-all loses its dots."""
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & (p != "."))
    named = F.transform(parts, lambda p: F.regexp_replace(p, r"^\[\.*(.*)\]$", "{$1}"))
    return F.concat_ws("/", F.lit("/api"), F.nullif(F.array_join(named, "/"), F.lit("")))


def file_endpoints(files: DataFrame) -> DataFrame:
    """Routes that are declared by file path: the ``app`` router's name their methods by exports, the ``pages`` router's answer any."""
    named = F.filter(F.array(*[F.when(F.col("content").rlike(rf"export\s+(?:async\s+)?(?:function\s+{m}\b|const\s+{m}\b)"), m) for m in HTTP_METHODS]), lambda m: m.isNotNull())
    routes = files.where(F.col("path").rlike(ROUTE_FILE)).select("project_id", F.col("path").alias("file"), F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("*")))).alias("method"), route_path(F.regexp_extract("path", ROUTE_FILE, 1)).alias("path"))
    inner = F.regexp_replace(F.regexp_extract("path", PAGE_FILE, 1), r"(^|/)index$", "")
    pages = files.where(F.col("path").rlike(PAGE_FILE)).select("project_id", F.col("path").alias("file"), F.lit("*").alias("method"), route_path(inner).alias("path"))
    return routes.unionByName(pages)


def go_endpoints(files: DataFrame) -> DataFrame:
    """Routes that Go code registers on a router, under the prefix of the router's group (the last of its name in a file)."""
    group, route, handle = r"(\w+)\s*:?=\s*[\w.]+\.Group\(\s*[\"`]([^\"`]*)[\"`]", rf"(\w+)\.({'|'.join(HTTP_METHODS)})\(\s*[\"`]([^\"`]*)[\"`]", r"(\w+)\.(?:HandleFunc|Handle)\(\s*[\"`]([^\"`]*)[\"`]"
    go = files.where("ext = '.go'")
    prefixes = F.arrays_zip(every("content", group, 1).alias("name"), every("content", group, 2).alias("prefix"))
    named = F.transform(F.arrays_zip(every("content", route, 1).alias("on"), every("content", route, 2).alias("method"), every("content", route, 3).alias("path")), lambda x: F.struct(x["on"].alias("on"), x["method"].alias("method"), x["path"].alias("path")))
    any_ = F.transform(F.arrays_zip(every("content", handle, 1).alias("on"), every("content", handle, 2).alias("path")), lambda x: F.struct(x["on"].alias("on"), F.lit("*").alias("method"), x["path"].alias("path")))
    rows = go.select("project_id", F.col("path").alias("file"), prefixes.alias("groups"), F.explode(F.concat(named, any_)).alias("x"))
    own = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("groups", lambda g: g["name"] == F.col("x.on")), lambda g: F.regexp_replace(g["prefix"], "/+$", ""))), -1)
    path = F.concat(own, F.col("x.path"))
    return rows.select("project_id", "file", F.col("x.method").alias("method"), F.when(path == "", "/").otherwise(path).alias("path"))


def api_endpoints(files: DataFrame) -> DataFrame:
    """Endpoints of Flask, FastAPI, Django, Express, Koa, Nest, Next.js and Go routers: ``project_id, file, method, path``; ``*`` is any method."""
    return _decorated_endpoints(files).unionByName(file_endpoints(files)).unionByName(go_endpoints(files))


def config_references(files: DataFrame) -> DataFrame:
    """Configuration names that code reads: ``project_id, file, key``."""
    named = lambda patterns: [F.transform(every("content", p, 1), lambda k: F.struct(k.alias("key"))) for p in patterns]
    return _by_language(files, named(PY_CONFIG), named(JS_CONFIG))


def env_definitions(files: DataFrame) -> DataFrame:
    """Names and values of ``.env`` files: ``project_id, file, key, value``, without quotes."""
    rows = files.where(F.col("name").rlike(r"^\.env(\..*)?$")).select("project_id", F.col("path").alias("file"), F.explode(F.split("content", "\r?\n")).alias("line")).select("project_id", "file", F.trim("line").alias("line"))
    kept = rows.where(~F.col("line").startswith("#") & F.col("line").contains("="))
    return kept.select("project_id", "file", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.regexp_replace(F.trim(F.expr("substring(line, instr(line, '=') + 1)")), r"^['\"]|['\"]$", "").alias("value"))


def requirements(files: DataFrame) -> DataFrame:
    """Packages of requirements files: ``project_id, file, name, version``."""
    rows = files.where(F.col("name").rlike(r"^requirements.*\.txt$") | (F.element_at(F.concat(F.array(F.lit("")), "dirs"), -1) == "requirements") & (F.col("ext") == ".txt"))
    lines = rows.select("project_id", F.col("path").alias("file"), F.explode(F.split("content", "\r?\n")).alias("line")).select("project_id", "file", F.trim("line").alias("line")).where("line <> '' and line not like '#%' and line not like '-%'")
    return lines.select("project_id", "file", F.regexp_extract("line", r"^([A-Za-z0-9_-]+)", 1).alias("name"), F.regexp_extract("line", r"[=<>!~]+\s*([A-Za-z0-9.*]+)", 1).alias("version")).where("name <> ''")


def node_packages(files: DataFrame) -> DataFrame:
    """Packages of package.json files: ``project_id, file, name, version, is_dev``."""
    maps = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>"
    parsed = files.where("name = 'package.json'").select("project_id", F.col("path").alias("file"), F.from_json("content", maps).alias("j"))
    part = lambda c, dev: parsed.select("project_id", "file", F.explode(f"j.{c}").alias("name", "version"), F.lit(dev).alias("is_dev"))
    return part("dependencies", False).unionByName(part("devDependencies", True)).unionByName(part("peerDependencies", False))
