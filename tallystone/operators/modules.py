"""Modules of Python and JavaScript as nodes of the dependency graph, and the edges between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import facts

#: How libraries connect, what kind of module a connection makes, and which names of infrastructure a library matches.
PY_CONNECT = {
    "sqlalchemy": r"create_engine\s*\(|sessionmaker\s*\(", "psycopg2": r"psycopg2\.connect\s*\(", "pymongo": r"MongoClient\s*\(", "redis": r"Redis\s*\(|StrictRedis\s*\(",
    "requests": r"requests\.(get|post|put|delete|patch)\s*\(", "httpx": r"httpx\.(get|post|put|delete|patch|AsyncClient)\s*\(", "aiohttp": r"aiohttp\.ClientSession\s*\(",
    "pika": r"pika\.BlockingConnection\s*\(", "celery": r"Celery\s*\(", "kafka": r"KafkaProducer\s*\(|KafkaConsumer\s*\(",
}
JS_CONNECT = {
    "mongoose": r"mongoose\.connect\s*\(", "mongodb": r"MongoClient\.connect\s*\(|new\s+MongoClient\s*\(", "pg": r"new\s+Pool\s*\(|new\s+Client\s*\(", "mysql": r"mysql\.createConnection\s*\(|mysql\.createPool\s*\(",
    "redis": r"redis\.createClient\s*\(|new\s+Redis\s*\(", "amqplib": r"amqp\.connect\s*\(", "kafkajs": r"new\s+Kafka\s*\(", "axios": r"axios\.(get|post|put|delete|patch)\s*\(|axios\.create\s*\(", "fetch": r"\bfetch\s*\(",
}
MAKES = {"database": ["sqlalchemy", "psycopg2", "pymongo", "mongoose", "mongodb", "pg", "mysql"], "cache": ["redis"], "queue": ["pika", "celery", "kafka", "amqplib", "kafkajs"], "client": ["requests", "httpx", "aiohttp", "axios", "fetch"]}
REACHES = {
    "sqlalchemy": ["postgres", "mysql", "sqlite", "db", "database", "sql", "mariadb"], "psycopg2": ["postgres", "db", "database"], "pymongo": ["mongo", "db", "database"], "mongoose": ["mongo", "db", "database"], "mongodb": ["mongo", "db", "database"],
    "pg": ["postgres", "db", "database", "sql"], "mysql": ["mysql", "db", "database", "mariadb"], "redis": ["redis", "cache"], "pika": ["rabbit", "amqp", "mq", "queue"], "celery": ["rabbit", "redis", "celery", "queue", "broker"],
    "kafka": ["kafka", "queue", "broker"], "amqplib": ["rabbit", "amqp", "mq", "queue"], "kafkajs": ["kafka", "queue", "broker"],
}
JS_EXT = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
ES6 = r"import\s+(?:\{[^}]+\}|\*\s+as\s+\w+|\w+)?\s*(?:,\s*\{[^}]+\})?\s*from\s+['\"]([^'\"]+)['\"]"
REQUIRE = r"(?:const|let|var)\s+(?:\{[^}]+\}|\w+)\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
DYNAMIC = r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
NODE = ["project_id", "id", "name", "type", "path"]


def by_connection(content: Column, connect: dict[str, str]) -> Column:
    """The kind of the first library, in order, that a text connects with."""
    kind = {lib: k for k, libs in MAKES.items() for lib in libs}
    return reduce(lambda out, lib: F.when(content.rlike(connect[lib]), kind[lib]).otherwise(out), reversed(list(connect)), F.lit("module"))


def python_modules(files: DataFrame) -> DataFrame:
    """Python files that parse, typed by their first role: service, test, then what they connect with."""
    found = facts.python_facts(files).groupBy("project_id", "path").agg(F.bool_or(F.col("kind") == "unparseable").alias("bad"), F.bool_or(F.col("kind").isin("main_guard", "endless")).alias("runs"))
    c = F.col("content")
    celery = F.lower(c).contains("celery") & (c.contains("@app.task") | c.contains("@celery.task"))
    kind = F.when(c.rlike("Flask|FastAPI|Django"), "service").when(c.rlike("test_|pytest"), "test").when(celery | F.coalesce("runs", F.lit(False)), "service").otherwise(by_connection(c, PY_CONNECT))
    name = text.python_module(F.col("path"))
    kept = files.where(F.col("ext").isin(".py", ".pyi") & (c != "")).join(found, ["project_id", "path"], "left").where(~F.coalesce("bad", F.lit(False)))
    return kept.select("project_id", F.concat(F.lit("py:"), name).alias("id"), name.alias("name"), kind.alias("type"), "path")


def js_modules(files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript files, typed by the first pattern that they hold."""
    c = F.col("content")
    service = c.rlike(r"express\s*\(\)|new\s+Koa\s*\(|new\s+Hapi\.Server\s*\(|@Controller|@Get|@Post|@Put|@Delete|createServer\s*\(|\.listen\s*\(\s*\d")
    kind = F.when(service, "service").when(c.rlike(r"React\.Component|useState\s*\(|useEffect\s*\("), "component").when(c.rlike(r"describe\s*\(|it\s*\(|test\s*\(|expect\s*\("), "test").otherwise(by_connection(c, JS_CONNECT))
    name = text.js_module(F.col("path"))
    return files.where(F.col("ext").isin(*JS_EXT) & (c != "")).select("project_id", F.concat(F.lit("js:"), name).alias("id"), name.alias("name"), kind.alias("type"), "path")


def service_nodes(files: DataFrame) -> DataFrame:
    """Services of compose files, typed by name and image."""
    rows = facts.compose_services(files)
    return rows.select("project_id", F.concat(F.lit("docker:"), "name").alias("id"), "name", facts.service_kind(F.col("name"), F.col("image")).alias("type"), "path")


def contract_nodes(files: DataFrame) -> DataFrame:
    return facts.contracts(files).select("project_id", F.concat(F.lit("sol:"), "name").alias("id"), "name", F.regexp_replace("kind", "abstract contract", "abstract").alias("type"), "path")


def nodes(files: DataFrame) -> DataFrame:
    """All nodes in the order of extraction: Python, JavaScript, contracts, services, each by path."""
    parts = [python_modules(files), js_modules(files), contract_nodes(files), service_nodes(files)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*NODE, F.lit(i).alias("layer")) for i, p in enumerate(parts)])


def edge(df: DataFrame, kind: str, seq: int) -> DataFrame:
    return df.where("src <> dst" if kind != "STATE*" else "true").select("project_id", "src", "dst", F.lit(kind.rstrip("*")).alias("edge_type"), F.lit(False).alias("atomic"), F.lit(seq).alias("seq"))


def closest(refs: DataFrame, mods: DataFrame) -> DataFrame:
    """The module that an imported name means: the same name, else the first by path above or below it. Prefixes join by equality."""
    parts = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\.", -1))), lambda n: F.array_join(F.slice(F.split(c, r"\.", -1), 1, n), "."))
    wanted = refs.select("project_id", "name").distinct()
    same = wanted.join(mods.select("project_id", "name", F.col("id").alias("dst"), F.lit(0).alias("rank"), "path"), ["project_id", "name"])
    above = wanted.select("project_id", F.col("name").alias("want"), F.explode(parts("name")).alias("name")).where("want <> name").join(mods, ["project_id", "name"]).select("project_id", F.col("want").alias("name"), F.col("id").alias("dst"), F.lit(1).alias("rank"), "path")
    below = mods.select("project_id", "id", "path", F.col("name").alias("full"), F.explode(parts("name")).alias("name")).where("full <> name").join(wanted, ["project_id", "name"], "left_semi").select("project_id", "name", F.col("id").alias("dst"), F.lit(1).alias("rank"), "path")
    best = same.unionByName(above).unionByName(below).groupBy("project_id", "name").agg(F.min_by("dst", F.struct("rank", "path")).alias("dst"))
    return refs.join(best, ["project_id", "name"])


def python_edges(files: DataFrame, mods: DataFrame) -> DataFrame:
    """Imports (RUNTIME) and base classes taken from another module (STATE)."""
    found = facts.python_facts(files).join(mods.select("project_id", "path", F.col("id").alias("src")), ["project_id", "path"])
    imports = closest(found.where("kind in ('import', 'import_from') and name <> ''").select("project_id", "src", "name"), mods)
    bases = found.where("kind = 'class'").select("project_id", "src", F.explode(F.split("detail", ",")).alias("base")).where(F.col("base").rlike(r"^\w+\.\w+$")).select("project_id", "src", F.substring_index("base", ".", 1).alias("name"))
    return edge(imports, "RUNTIME", 11).unionByName(edge(closest(bases, mods), "STATE", 13))


def js_edges(files: DataFrame, mods: DataFrame) -> DataFrame:
    """Relative imports (RUNTIME) and classes that extend something named like a module (STATE)."""
    js = files.join(mods.select("project_id", "path", F.col("id").alias("src")), ["project_id", "path"])
    specifiers = F.concat(*[facts.every("content", p, 1) for p in (ES6, REQUIRE, DYNAMIC)])
    refs = js.select("project_id", "src", "dirs", F.explode(specifiers).alias("spec")).where("spec like '.%'")
    target = F.concat_ws("/", F.nullif(F.array_join("dirs", "/"), F.lit("")), "spec")
    for _ in range(6):
        target = F.regexp_replace(F.regexp_replace(target, r"(^|/)\./", "$1"), r"(^|/)(?!\.\.?/)[^/]+/\.\./", "$1")
    imports = refs.select("project_id", "src", F.explode(F.array(target, F.concat(target, F.lit("/index")))).alias("name")).join(mods.select("project_id", "name", F.col("id").alias("dst")), ["project_id", "name"])
    parents = js.select("project_id", "src", F.explode(facts.every("content", r"class\s+\w+\s+extends\s+(\w+)", 1)).alias("parent"))
    named = parents.join(mods.select("project_id", "name", F.col("id").alias("dst"), "path"), "project_id").where(F.lower("name").contains(F.lower("parent")))
    first = named.groupBy("project_id", "src", "parent").agg(F.min_by("dst", "path").alias("dst"))
    return edge(imports, "RUNTIME", 21).unionByName(edge(first, "STATE", 22))


def connection_edges(files: DataFrame, mods: DataFrame, all_nodes: DataFrame, connect: dict[str, str], seq: int) -> DataFrame:
    """A module that connects with a library depends (STATE) on each database, cache or queue whose name fits the library; itself included."""
    libs = [lib for lib in connect if lib in REACHES]
    used = F.array_compact(F.array(*[F.when(F.col("content").rlike(connect[lib]), F.lit(lib)) for lib in libs]))
    rows = files.join(mods.select("project_id", "path", F.col("id").alias("src")), ["project_id", "path"]).select("project_id", "src", F.explode(used).alias("lib"))
    infra = all_nodes.where("type in ('database', 'cache', 'queue')").withColumn("both", F.lower(F.concat_ws(" ", "id", "name")))
    fits = F.array_compact(F.array(*[F.when(F.col("both").rlike("|".join(REACHES[lib])), F.lit(lib)) for lib in libs]))
    reach = infra.select("project_id", F.col("id").alias("dst"), F.explode(fits).alias("lib"))
    return edge(rows.join(reach, ["project_id", "lib"]), "STATE*", seq)


def all_edges(files: DataFrame) -> DataFrame:
    """Every edge of the graph, with ``seq`` in the order of extraction. Edges with an end that is no node are not made."""
    everything = nodes(files).cache()
    layer = lambda i: everything.where(F.col("layer") == i)
    py, js = layer(0), layer(1)
    parts = [
        python_edges(files, py), connection_edges(files, py, everything, PY_CONNECT, 12), js_edges(files, js), connection_edges(files, js, everything, JS_CONNECT, 23),
        facts.contract_edges(files).withColumn("seq", F.col("seq") + 30), facts.compose_edges(files).withColumn("seq", F.col("seq") + 40),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
