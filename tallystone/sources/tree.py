"""Source trees as a table: a Python data source that lists every file, hidden ones too, and operators on it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "project_id string, path string, dirs array<string>, name string, ext string, size long, content string"

#: Directories that the extractors and the scanner pass over, and languages by extension.
SKIP = (".git .hg .svn __pycache__ .pytest_cache .mypy_cache .tox .nox .eggs node_modules bower_components vendor venv .venv env .env virtualenv dist build target .next .nuxt coverage .coverage htmlcov "
        "testdata test-projects test_projects test-fixtures test_fixtures fixtures __fixtures__ __mocks__").split()  # fmt: skip
SCAN_SKIP = "node_modules .git __pycache__ .venv venv env dist build .next .nuxt vendor target .tox .mypy_cache .pytest_cache coverage .cache migrations static assets public out".split()
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".sol": "solidity",
             ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config", ".cfg": "config", ".ini": "config"}
PRINT_SKIP = "node_modules .git __pycache__ venv .next build dist artifacts cache coverage package-lock.json yarn.lock".split()
MAX_FILE, MAX_SCAN = 10 * 1024 * 1024, 500 * 1024


class Listed(InputPartition):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class TreeReader(DataSourceReader):
    """Options: ``path`` (a project, or several separated by commas), or ``projects`` (a folder of projects);
    ``files_per_task``; ``content`` (false leaves it null, and files are only listed)."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        roots = [p for p in self.options.get("path", "").split(",") if p]
        if folder := self.options.get("projects"):
            roots += sorted(e.path for e in os.scandir(folder) if e.is_dir())
        found = []
        for root in roots:
            for d, dirs, names in os.walk(root):
                dirs.sort()
                found += [(os.path.basename(os.path.normpath(root)), root, os.path.relpath(os.path.join(d, n), root)) for n in sorted(names)]
        n = int(self.options.get("files_per_task", 200))
        return [Listed(found[i : i + n]) for i in range(0, len(found), n)] or [Listed([])]

    def read(self, partition: Listed):
        wanted = str(self.options.get("content", "true")).lower() == "true"
        for project, root, path in partition.files:
            full = os.path.join(root, path)
            try:
                size = os.path.getsize(full)
                text = None
                if wanted and size <= MAX_FILE:
                    with open(full, "rb") as f:
                        text = f.read().decode("utf-8", "ignore")
            except OSError:
                continue
            name = os.path.basename(path)
            stem, ext = os.path.splitext(name)
            yield project, path, path.split("/")[:-1], name, ext.lower() if stem else "", size, text


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str | None = None, projects: str | None = None, **options) -> DataFrame:
    """Files of one or several projects, with ``lang``."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("srctree").options(**{k: str(v) for k, v in options.items()})
    for key, value in (("path", path), ("projects", projects)):
        reader = reader.option(key, value) if value else reader
    return reader.load().withColumn("lang", language(F.col("ext")))


def language(ext: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def analysed(files: DataFrame) -> DataFrame:
    """Files that the extractors read: outside skipped directories (compared within the project) and not too large."""
    skipped = F.arrays_overlap("dirs", F.array(*map(F.lit, SKIP))) | F.exists("dirs", lambda d: d.endswith(".egg-info"))
    return files.where(~skipped & (F.col("size") <= MAX_FILE))


def scanned(files: DataFrame, most: int = 500) -> DataFrame:
    """Files that the scanner reads: known languages, no skipped part (the name counts too), up to 500 KiB, the first ``most`` of a project by path."""
    from pyspark.sql.window import Window

    parts = F.concat("dirs", F.array("name"))
    kept = files.where(F.col("lang").isNotNull() & ~F.arrays_overlap(parts, F.array(*map(F.lit, SCAN_SKIP))) & (F.col("size") <= MAX_SCAN))
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("project_id").orderBy("path"))).where(F.col("__n") <= most).drop("__n")


def project_types(files: DataFrame) -> DataFrame:
    """Per project, whether it has Python, JavaScript, Solidity and compose files."""
    compose = F.col("name").isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
    has = {"python": F.col("ext").isin(".py", ".pyi"), "javascript": F.col("ext").isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), "solidity": F.col("ext") == ".sol", "docker": compose}
    return files.groupBy("project_id").agg(*[F.bool_or(c).alias(n) for n, c in has.items()])


def fingerprint(files: DataFrame) -> DataFrame:
    """``project_id, item``: the distinct paths of a project, names in Pascal case replaced by ``<NAME>``; for ``metrics.homogeneity``."""
    kept = files.where(~F.arrays_overlap(F.concat("dirs", F.array("name")), F.array(*map(F.lit, PRINT_SKIP))))
    return kept.select("project_id", F.regexp_replace("path", "[A-Z][a-z]+(?:[A-Z][a-z]+)*", "<NAME>").alias("item")).distinct()
