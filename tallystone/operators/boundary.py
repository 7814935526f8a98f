"""Deployment-readiness checks: one aggregation of the files of a project, then twelve rows."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dist_name, python_module
from .facts import python_facts
from .graph import scc

#: Folders that the checks pass over, files and patterns that they look for.
SKIP = "node_modules .git __pycache__ venv .next build dist artifacts cache coverage".split()
API_CALLS = [r"fetch\s*\(", r"axios\.", r"\.get\s*\([\"']/", r"\.post\s*\([\"']/", "BACKEND_URL", "API_URL"]
DIRECT_CALLS = [r"fetch\s*\(", r"axios\.", "BACKEND_URL", "API_URL"]
ROUTES = r"(router\.(get|post|put|delete)|app\.(get|post|put|delete))\s*\("
ENV_FILES = [".env", ".env.example", "backend/.env", "backend/.env.example", "frontend/.env"]
ENV_BUILTIN = ["NODE_ENV", "PUBLIC_URL", "FAST_REFRESH"]
BUILD = ["hardhat.config.js", "hardhat.config.ts", "truffle-config.js", "foundry.toml"]
DEPLOY = ["scripts/deploy.js", "scripts/deploy.ts", "deploy/deploy.js", "migrations/1_deploy.js"]
ABI = "array<struct<type:string,name:string>>"


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def first_of(condition: Column, name: str) -> Column:
    """The place of a file among those of its project that meet a condition, by path."""
    return F.sum(condition.cast("int")).over(Window.partitionBy("project_id").orderBy("path")).alias(name)


def env_pairs(content: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\r?\n"), F.trim), lambda x: ~x.startswith("#") & x.contains("="))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))).alias("v")))


def contract_checks(files: DataFrame) -> DataFrame:
    """``project_id, name, passed, applicable, detail``. The first so-many files are those first by path."""
    seen = files.where(~F.arrays_overlap("dirs", F.array(*map(F.lit, SKIP))))
    js, web = F.col("ext").isin(".js", ".jsx"), F.col("ext").isin(".js", ".jsx", ".ts", ".tsx")
    under = lambda d: F.col("path").startswith(f"{d}/")
    at = lambda p: F.col("path") == p
    front, back, test, sol = under("frontend/src") & web, under("backend") & (F.col("ext") == ".js"), under("test") & F.col("ext").isin(".js", ".ts"), under("contracts") & (F.col("ext") == ".sol")
    ranked = seen.withColumns({"r_js": first_of(js, "r"), "r_web": first_of(web, "r"), "r_front": first_of(front, "r"), "r_back": first_of(back, "r"), "r_test": first_of(test, "r")})
    text = F.coalesce("content", F.lit(""))
    pick = lambda cond, value: F.max(F.when(cond, value))
    flat = lambda cond, value: F.array_distinct(F.flatten(F.collect_list(F.when(cond, value))))
    early = lambda kind, rank, n: kind & (F.col(rank) <= n)
    functions = F.filter(F.regexp_extract_all(text, F.lit(r"\bfunction\s+(\w+)\s*\("), 1), lambda x: x != "constructor")
    requires = F.regexp_extract_all(text, F.lit(r"require\s*\(\s*['\"](\.[^'\"]+)['\"]"), 1)
    base = F.array_join("dirs", "/")
    # a required path, folded: "./x" and "../x" against the file's own folder
    joined = F.transform(requires, lambda r: F.regexp_replace(F.concat_ws("/", F.when(base != "", base), r), r"(^|/)\./", "$1"))
    for _ in range(4):
        joined = F.transform(joined, lambda p: F.regexp_replace(F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1"), r"(^|/)\./", "$1"))
    some = ranked.groupBy("project_id").agg(
        F.bool_or(under("contracts")).alias("contracts"), F.bool_or(under("backend")).alias("backend"), F.bool_or(under("frontend/src")).alias("frontend"), F.bool_or(under("test")).alias("tests"),
        pick(at("backend/config/contractABI.json"), text).alias("abi"), pick(at("abi/contractABI.json"), text).alias("abi2"),
        flat(sol, functions).alias("functions"), F.bool_or(early(js, "r_js", 30) & text.rlike(r'"name"\s*:\s*"(getValue|setValue)"')).alias("placeholder"),
        F.bool_or(early(front, "r_front", 30) & any_of(text, API_CALLS)).alias("calls"), F.bool_or(early(front, "r_front", 30) & any_of(text, DIRECT_CALLS)).alias("direct"), F.bool_or(early(back, "r_back", 30) & text.rlike(ROUTES)).alias("routes"),
        flat(early(web, "r_web", 50), F.regexp_extract_all(text, F.lit(r"process\.env\.(\w+)"), 1)).alias("refs"), flat(F.col("path").isin(*ENV_FILES), F.transform(env_pairs(text), lambda p: p["k"])).alias("defined"),
        F.flatten(F.collect_list(F.when(F.col("path").isin(".env", "backend/.env"), env_pairs(text)))).alias("values"),
        pick(at("backend/app.js"), text).alias("app"), pick(at("frontend/package.json"), text).alias("package"),
        F.bool_or(F.col("path").isin(*BUILD)).alias("build"), F.bool_or(F.col("path").isin(*DEPLOY)).alias("deploy"),
        F.flatten(F.collect_list(F.when(early(js, "r_js", 30), joined))).alias("requires"), F.collect_set("path").alias("paths"), F.collect_list(F.when(early(test, "r_test", 20), text)).alias("test_texts"),
    )
    has_artifacts = files.groupBy("project_id").agg(F.bool_or(under("artifacts")).alias("artifacts"))
    p = some.join(has_artifacts, "project_id").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("contracts", "backend", "frontend", "tests", "placeholder", "calls", "direct", "routes", "build", "deploy")})
    abi_text = F.coalesce("abi", "abi2")
    entries = F.from_json(F.when(abi_text.rlike(r"^\s*\["), abi_text), ABI)
    own = F.from_json(F.when(F.col("abi").rlike(r"^\s*\["), F.col("abi")), ABI)
    abi_functions = F.array_distinct(F.transform(F.filter(F.coalesce(own, F.array().cast(ABI)), lambda e: (e["type"] == "function") & (e["name"] != "")), lambda e: e["name"]))
    union = F.size(F.array_union(abi_functions, F.col("functions")))
    similar = F.try_divide(F.size(F.array_intersect(abi_functions, F.col("functions"))), union)
    missing = F.array_except(F.array_except("refs", "defined"), F.array(*map(F.lit, ENV_BUILTIN)))
    zero = F.exists("values", lambda v: F.lower(v["v"]).contains("0x" + "0" * 40))
    port = F.regexp_extract(F.coalesce("app", F.lit("")), r"(?:PORT|port)\s*(?:\|\||\?\?)\s*(\d+)", 1)
    front_port = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.get_json_object("package", "$.scripts.start"), F.lit("")), r"PORT=(\d+)", 1), F.lit("")), F.lit("3000"))
    stem = lambda x: F.regexp_replace(x, r"\.[A-Za-z0-9]+$", "")
    resolves = lambda x: F.array_contains("paths", x) | F.array_contains("paths", F.concat(stem(x), F.lit(".js"))) | F.array_contains("paths", F.concat(stem(x), F.lit(".json"))) | F.array_contains("paths", F.concat(x, F.lit("/index.js"))) | F.exists("paths", lambda y: y.startswith(F.concat(x, F.lit("/"))))
    broken = F.size(F.filter("requires", lambda x: ~resolves(x)))
    tested = F.size(F.filter("functions", lambda f: F.exists("test_texts", lambda t: t.contains(f))))
    n_functions = F.size("functions")
    pair, has_abi = F.col("backend") & F.col("frontend"), abi_text.isNotNull() | F.col("artifacts")
    true, none = F.lit(True), F.lit("")
    rows: list[tuple[str, Column, Column, Column]] = [
        ("abi_exists", F.coalesce(F.size(entries) > 0, F.lit(False)), has_abi | F.col("contracts"), none),
        ("abi_matches_contract", F.coalesce(similar > 0.5, F.lit(False)), F.col("contracts") & (n_functions > 0), F.coalesce(F.format_number(similar, 3), none)),
        ("no_placeholder_abi", ~F.col("placeholder"), true, none),
        ("frontend_calls_backend", F.col("calls"), pair, none),
        ("no_dead_backend_routes", F.col("direct"), pair & F.col("routes"), none),
        ("env_vars_defined", F.size(missing) == 0, F.size("refs") > 0, F.array_join(F.slice(F.sort_array(missing), 1, 5), ", ")),
        ("no_placeholder_addresses", ~zero, F.size("values") > 0, none),
        ("no_port_conflicts", port != front_port, port.try_cast("int") > 0, port),
        ("build_config_exists", F.col("build"), F.col("contracts"), none),
        ("deploy_script_exists", F.col("deploy"), F.col("contracts"), none),
        ("imports_resolve", broken == 0, F.size("requires") > 0, broken.cast("string")),
        ("tests_match_contract", F.coalesce(F.try_divide(tested, n_functions) > 0.5, F.lit(False)), F.col("contracts") & F.col("tests") & (n_functions > 0), tested.cast("string")),
    ]
    # where a check doesn't apply it counts as passed, but for the three that look for a file
    always = {"abi_exists", "build_config_exists", "deploy_script_exists"}
    structs = [F.struct(F.lit(n).alias("name"), (ok if n in always else ok | ~F.coalesce(a, F.lit(False))).alias("passed"), F.coalesce(a, F.lit(False)).alias("applicable"), d.alias("detail")) for n, ok, a, d in rows]
    return p.select("project_id", F.explode(F.array(*structs)).alias("c")).select("project_id", "c.*")


def failing(checks: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [F.col("applicable"), ~F.col("passed")])


# --- Python projects --------------------------------------------------------------------------

#: Names that the checks of Python projects look for.
PY_SKIP = "__pycache__ .git .tox .nox venv .venv node_modules .eggs build dist .mypy_cache .pytest_cache htmlcov coverage".split()
MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile"]
ENTRIES = ["main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "run.py", "cli.py"]
APP_SIGNALS = ["app.py", "manage.py", "wsgi.py", "asgi.py", "Procfile"]
WEB = ["flask", "django", "fastapi", "uvicorn", "gunicorn", "starlette", "tornado", "sanic", "aiohttp"]
CONTAINERS = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
CI_FILES, CI_DIRS = [".gitlab-ci.yml", "Jenkinsfile", ".travis.yml", "tox.ini", "Makefile"], [".github/workflows/", ".circleci/"]
PY_ENV_BUILTIN = ["PATH", "HOME", "USER", "LANG", "SHELL", "TERM", "PYTHONPATH", "VIRTUAL_ENV", "CONDA_DEFAULT_ENV"]
ALIASES = {"cv2": "opencv_python", "pil": "pillow", "sklearn": "scikit_learn", "yaml": "pyyaml", "bs4": "beautifulsoup4", "attr": "attrs", "gi": "pygobject", "serial": "pyserial", "dotenv": "python_dotenv", "jwt": "pyjwt", "magic": "python_magic", "dateutil": "python_dateutil"}
PLACEHOLDER = r"(?i)your[_-]?(?:api[_-]?)?key|changeme|change[_-]me|placeholder|xxx+|<[^>]+>|todo"


def python_imports(files: DataFrame) -> DataFrame:
    """``project_id, path, module, relative`` of every import; the module of a relative one is as written, without dots."""
    facts_ = python_facts(files).where("kind in ('import', 'import_from')")
    return facts_.select("project_id", "path", F.col("name").alias("module"), (F.col("value") > 0).alias("relative")).distinct()


def python_checks(files: DataFrame) -> DataFrame:
    """``project_id, name, passed, applicable, detail`` of the twelve checks of Python projects.

    Standard modules are those of the running interpreter. Import cycles are components of more than one module in the graph of imports
    between a project's own modules.
    """
    seen = files.where(~F.arrays_overlap("dirs", F.array(*map(F.lit, PY_SKIP))) & ~F.exists("dirs", lambda d: d.endswith(".egg-info")))
    py = F.col("ext") == ".py"
    text = F.coalesce("content", F.lit(""))
    test = py & F.col("name").startswith("test_") & (F.col("path").startswith("tests/") | F.col("path").startswith("test/") | (F.size("dirs") == 0))
    at = lambda p: F.col("path") == p
    pick = lambda cond: F.max(F.when(cond, text))
    flat = lambda cond, value: F.array_distinct(F.flatten(F.collect_list(F.when(cond, value))))
    env_refs = F.array_union(F.regexp_extract_all(text, F.lit(r"os\.environ(?:\.get)?\s*[\[(]\s*['\"](\w+)['\"]"), 1), F.regexp_extract_all(text, F.lit(r"os\.getenv\s*\(\s*['\"](\w+)['\"]"), 1))
    needed = F.transform(F.filter(F.transform(F.split(text, "\r?\n"), F.trim), lambda x: x.rlike(r"^[A-Za-z0-9]")), lambda x: dist_name(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1)))
    dependencies = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[[^\]\n]*dependenc[^\]\n]*\]\s*\n(.*?)(?:\n\[|\z)", 1), F.lit(r"(?m)^\s*\"?([A-Za-z0-9._-]+)\"?\s*[=<>~!]"), 1), dist_name)
    package = F.when(py & (F.col("name") == "__init__.py") & (F.size("dirs") >= 1) & ((F.size("dirs") == 1) | ((F.size("dirs") == 2) & (F.element_at("dirs", 1) == "src"))), F.element_at("dirs", -1))
    ranked = seen.withColumn("r_py", first_of(py, "r"))
    some = ranked.groupBy("project_id").agg(
        F.collect_set("path").alias("paths"), F.collect_set(F.when(~package.isin("tests", "test"), package)).alias("packages"), F.count_if(test).alias("n_tests"), F.collect_list(F.when(test & (F.size("dirs") > 0), text)).alias("tests"),
        flat(py, env_refs).alias("refs"), flat(F.col("path").isin(".env", ".env.example", ".env.template"), F.transform(env_pairs(text), lambda p: p["k"])).alias("defined"), F.bool_or(F.col("path").isin(".env", ".env.example")).alias("has_env"),
        F.bool_or(F.col("path").isin(".env", ".env.example") & F.exists(env_pairs(text), lambda p: p["v"].rlike(PLACEHOLDER))).alias("placeholder"),
        flat(at("requirements.txt") | F.col("path").rlike(r"^requirements/[^/]*\.txt$"), needed).alias("required"), flat(at("pyproject.toml"), dependencies).alias("depends"), pick(at("pyproject.toml")).alias("pyproject"),
        F.bool_or(F.col("path").isin(*APP_SIGNALS) | ((F.col("r_py") <= 30) & py & text.rlike("(?:import|from) (?:" + "|".join(WEB) + ")"))).alias("app"), F.bool_or(reduce(lambda a, b: a | b, [F.col("path").startswith(d) for d in CI_DIRS])).alias("ci_dir"),
    )
    imports = python_imports(seen.where(py)).cache()
    broken_setup = python_facts(seen.where(at("setup.py"))).where("kind = 'unparseable'").select("project_id", F.lit(True).alias("bad_setup")).distinct()
    outer = imports.where("not relative").groupBy("project_id").agg(F.collect_set(dist_name(F.substring_index("module", ".", 1))).alias("imported"))
    own_dir = F.regexp_replace("path", r"[^/]+$", "")
    target = F.concat(own_dir, F.regexp_replace("module", r"\.", "/"))
    relative = imports.where("relative").groupBy("project_id").agg(F.collect_list(F.struct(target.alias("t"), own_dir.alias("d"), (F.col("module") == "").alias("bare"))).alias("relative"))
    module = seen.where(py).select("project_id", "path", F.regexp_replace(python_module(F.col("path")), r"^src\.", "").alias("m"))
    links = imports.join(module, ["project_id", "path"]).select("project_id", F.col("m").alias("src"), F.when(F.col("relative"), F.concat_ws(".", F.nullif(F.regexp_replace("m", r"\.?[^.]*$", ""), F.lit("")), F.col("module"))).otherwise(F.col("module")).alias("dst"))
    links = links.join(module.select("project_id", F.col("m").alias("dst")).distinct(), ["project_id", "dst"]).where("src <> dst")
    circular = scc(links).groupBy("project_id", "scc").count().where("count > 1").select("project_id", F.lit(True).alias("circular")).distinct()
    p = some.join(outer, "project_id", "left").join(relative, "project_id", "left").join(circular, "project_id", "left").join(broken_setup, "project_id", "left").join(module.groupBy("project_id").agg(F.count("*").alias("modules")), "project_id", "left")
    has = lambda names: F.arrays_overlap("paths", F.array(*map(F.lit, names)))
    rel = F.coalesce("relative", F.array().cast("array<struct<t:string,d:string,bare:boolean>>"))
    lost = F.size(F.filter(rel, lambda x: F.when(x["bare"], ~F.array_contains("paths", F.concat(x["d"], F.lit("__init__.py")))).otherwise(~(F.array_contains("paths", F.concat(x["t"], F.lit(".py"))) | F.array_contains("paths", F.concat(x["t"], F.lit("/__init__.py")))))))
    standard = F.array(*[F.lit(n.lower()) for n in sorted(sys.stdlib_module_names)])
    third = F.array_except(F.array_except(F.coalesce("imported", F.array().cast("array<string>")), standard), F.col("packages"))
    declared = F.array_union("required", "depends")
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    undeclared = F.filter(third, lambda x: ~F.array_contains(declared, F.coalesce(F.try_element_at(alias, x), x)))
    undefined = F.array_except(F.array_except("refs", "defined"), F.array(*map(F.lit, PY_ENV_BUILTIN)))
    main = F.exists("packages", lambda n: F.array_contains("paths", F.concat(n, F.lit("/__main__.py"))) | F.array_contains("paths", F.concat(F.lit("src/"), n, F.lit("/__main__.py"))))
    toml = F.coalesce("pyproject", F.lit(""))
    naming = F.size(F.filter("tests", lambda t: F.exists("packages", lambda n: t.contains(n))))
    toml_fine = F.col("pyproject").isNull() | (toml.rlike(r"(?m)^\[(project|tool\.poetry)\]") & toml.rlike(r"(?m)^\[build-system\]"))
    first5 = lambda c: F.array_join(F.slice(F.sort_array(c), 1, 5), ", ")
    yes, none = F.lit(True), F.lit("")
    rows: list[tuple[str, Column, Column, Column]] = [
        ("internal_imports_resolve", lost == 0, F.size(rel) > 0, lost.cast("string")),
        ("requirements_exist", has(MANIFESTS), yes, none),
        ("deps_match_imports", F.size(undeclared) == 0, (F.size(declared) > 0) & (F.size(third) > 0), first5(undeclared)),
        ("env_vars_defined", F.size(undefined) == 0, F.size("refs") > 0, first5(undefined)),
        ("no_placeholder_config", ~F.col("placeholder"), F.col("has_env"), none),
        ("entry_point_exists", has(ENTRIES) | main | toml.rlike(r"\[project\.scripts\]|\[tool\.poetry\.scripts\]|console_scripts"), yes, none),
        ("tests_exist", F.col("n_tests") > 0, yes, F.col("n_tests").cast("string")),
        ("tests_import_project", F.coalesce(F.try_divide(naming, F.size("tests")) > 0.3, F.lit(False)), (F.size("packages") > 0) & (F.size("tests") > 0), naming.cast("string")),
        ("no_circular_imports", F.col("circular").isNull(), F.coalesce("modules", F.lit(0)) > 1, none),
        ("dockerfile_exists", has(CONTAINERS), F.col("app"), none),
        ("ci_config_exists", has(CI_FILES) | F.col("ci_dir"), yes, none),
        ("build_config_valid", has(["pyproject.toml", "setup.py", "setup.cfg"]) & toml_fine & F.col("bad_setup").isNull(), yes, none),
    ]
    # dockerfile_exists looks for files even where it doesn't apply; the others pass there
    structs = [F.struct(F.lit(n).alias("name"), (ok if n == "dockerfile_exists" else ok | ~F.coalesce(a, F.lit(False))).alias("passed"), F.coalesce(a, F.lit(False)).alias("applicable"), d.alias("detail")) for n, ok, a, d in rows]
    return p.select("project_id", F.explode(F.array(*structs)).alias("c")).select("project_id", "c.*")
