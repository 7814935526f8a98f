"""Packages that manifests declare and keys that configuration files define, as tables.

Line formats are read with column functions; the section of a line is the last header above it, a window within
one file. YAML and JSON are flattened in one narrow Python pass.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.facts import env_definitions, node_packages, requirements

PACKAGE = ["project_id", "file", "name", "version", "ecosystem", "is_dev"]
#: Mapping keys whose children are environment variables.
ENV_SECTIONS = frozenset({"environment", "env", "environment_variables", "envvars"})


def numbered(files: DataFrame, wanted: Column) -> DataFrame:
    """``project_id, file, line_no, line`` (trimmed) and ``section``, the text of the last ``[header]`` at or above a line."""
    rows = files.where(wanted & F.col("content").isNotNull()).select("project_id", F.col("path").alias("file"), F.posexplode(F.split("content", "\r?\n")).alias("line_no", "raw"))
    rows = rows.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    header = F.nullif(F.regexp_extract("line", r"^\[+([^\[\]]+)\]+\s*(?:#.*)?$", 1), F.lit(""))
    order = Window.partitionBy("project_id", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header", header).withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(order), F.lit("")))


def named(file: str) -> Column:
    return F.col("name") == file


def requirement(text: Column) -> tuple[Column, Column]:
    """Name and version of a requirement as written."""
    return F.regexp_extract(text, r"^\s*['\"]?([A-Za-z0-9_-]+)", 1), F.regexp_extract(text, r"[=<>!~]=?\s*([A-Za-z0-9.*]+)", 1)


def packages(rows: DataFrame, name: Column, version: Column, ecosystem: str, dev: Column | bool = False) -> DataFrame:
    return rows.select("project_id", "file", name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"), (dev if isinstance(dev, Column) else F.lit(dev)).alias("is_dev")).where("name <> ''")


def setup_py(files: DataFrame) -> DataFrame:
    """Strings in the lists of ``install_requires`` and ``extras_require``."""
    block = F.concat_ws(",", F.regexp_extract("content", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), F.regexp_extract("content", r"(?s)extras_require\s*=\s*\{(.*?)\}", 1))
    keys = F.regexp_replace(block, r"['\"][^'\"]*['\"]\s*:", "")
    rows = files.where(named("setup.py")).select("project_id", F.col("path").alias("file"), F.explode(F.regexp_extract_all(keys, F.lit(r"['\"]([^'\"]+)['\"]"), 1)).alias("r"))
    return packages(rows, *requirement(F.col("r")), "pypi")


def setup_cfg(files: DataFrame) -> DataFrame:
    """Indented lines below ``install_requires`` of ``[options]`` and below the names of ``[options.extras_require]``."""
    rows = numbered(files, named("setup.cfg"))
    order = Window.partitionBy("project_id", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(~F.col("raw").rlike(r"^\s") & F.col("line").rlike(r"^[A-Za-z_.-]+\s*="), F.regexp_extract("line", r"^([A-Za-z_.-]+)", 1))
    rows = rows.withColumn("key", F.last(key, ignorenulls=True).over(order)).where(F.col("raw").rlike(r"^\s+\S") & ~F.col("line").startswith("#"))
    return packages(rows.where("(section = 'options' and key = 'install_requires') or section = 'options.extras_require'"), *requirement(F.col("line")), "pypi", F.col("section") != "options")


def pyproject(files: DataFrame) -> DataFrame:
    """Keys of sections whose name ends with ``dependencies``, and the strings of ``dependencies = [...]`` arrays."""
    rows = numbered(files, named("pyproject.toml")).where(F.col("header").isNull() & ~F.col("line").startswith("#"))
    keyed = rows.where(F.col("section").rlike("dependencies$") & F.col("line").contains("=")).withColumn("k", F.regexp_extract("line", r"^['\"]?([A-Za-z0-9_-]+)['\"]?\s*=", 1)).where("k <> 'python'")
    array = F.regexp_extract("content", r"(?ms)^\s*dependencies\s*=\s*\[(.*?)\]\s*$", 1)
    listed = files.where(named("pyproject.toml")).select("project_id", F.col("path").alias("file"), F.explode(F.regexp_extract_all(array, F.lit(r"['\"]([^'\"]+)['\"]"), 1)).alias("r"))
    return packages(keyed, F.col("k"), F.regexp_extract("line", r"([0-9][A-Za-z0-9.*]*)", 1), "pypi", F.col("section").rlike("dev")).unionByName(packages(listed, *requirement(F.col("r")), "pypi"))


def cargo(files: DataFrame) -> DataFrame:
    rows = numbered(files, named("Cargo.toml")).where(F.col("header").isNull() & F.col("section").isin("dependencies", "dev-dependencies", "build-dependencies") & F.col("line").contains("=") & ~F.col("line").startswith("#"))
    return packages(rows, F.trim(F.substring_index("line", "=", 1)), F.regexp_extract("line", r"\"([0-9][^\"]*)\"", 1), "cargo", F.col("section") == "dev-dependencies")


def go_mod(files: DataFrame) -> DataFrame:
    """Modules of ``require`` lines and blocks."""
    rows = numbered(files, named("go.mod"))
    order = Window.partitionBy("project_id", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("line").rlike(r"^require\s*\("), True).when(F.col("line").rlike(r"^\)|^(?:replace|exclude|retract|module)\b"), False)
    inside = rows.withColumn("open", F.coalesce(F.last(state, ignorenulls=True).over(order), F.lit(False)))
    line = F.regexp_replace("line", r"^require\s+", "")
    kept = inside.where((F.col("open") | F.col("line").rlike(r"^require\s+[^\s(]")) & ~F.col("line").rlike(r"^require\s*\(")).withColumn("l", line)
    return packages(kept, F.regexp_extract("l", r"^([^\s/]\S*)\s+v", 1), F.regexp_extract("l", r"\s(v\S+)", 1), "go")


def dependencies(files: DataFrame) -> DataFrame:
    """All declared packages: ``project_id, file, name, version, ecosystem, is_dev``."""
    pip = requirements(files).select("project_id", "file", "name", "version", F.lit("pypi").alias("ecosystem"), F.lit(False).alias("is_dev"))
    npm = node_packages(files).select("project_id", "file", "name", "version", F.lit("npm").alias("ecosystem"), "is_dev")
    return reduce(lambda a, b: a.unionByName(b), [pip, npm, setup_py(files), setup_cfg(files), pyproject(files), cargo(files), go_mod(files)])


def flattened(value, prefix: str = "", env: bool = False):
    """``(key, value)`` of a parsed document: dotted keys; below an environment section also the bare names."""
    for k, v in value.items() if isinstance(value, dict) else ():
        key = f"{prefix}.{k}" if prefix else str(k)
        section = str(k).lower() in ENV_SECTIONS
        if isinstance(v, dict):
            yield from flattened(v, key, section)
        elif isinstance(v, list) and section:
            for item in v:
                name, _, rest = str(item).partition("=")
                yield name.strip(), rest
        else:
            yield key, str(v)
            if env:
                yield str(k), str(v)


def document_definitions(files: DataFrame) -> DataFrame:
    """Keys of YAML and JSON files; files that don't parse have none."""
    schema = "project_id string, file string, key string, value string"

    def run(batches):
        import yaml

        for b in batches:
            out = []
            for project, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    doc = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
                    out += [(project, path, k, v) for k, v in flattened(doc)]
                except (ValueError, yaml.YAMLError, RecursionError):
                    continue
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["project_id", "file", "key", "value"])

    return files.where(F.col("ext").isin(".yaml", ".yml", ".json") & F.col("content").isNotNull()).select("project_id", "path", "content").mapInArrow(run, schema)


def line_definitions(files: DataFrame) -> DataFrame:
    """Keys of TOML files (bare) and of INI and CFG files (with their section)."""
    rows = numbered(files, F.col("ext").isin(".toml", ".ini", ".cfg")).where(F.col("header").isNull() & F.col("line").contains("=") & ~F.col("line").rlike("^[#;]"))
    bare = F.trim(F.substring_index("line", "=", 1))
    key = F.when(F.col("file").endswith(".toml") | (F.col("section") == ""), bare).otherwise(F.concat_ws(".", "section", bare))
    value = F.regexp_replace(F.trim(F.expr("substring(line, instr(line, '=') + 1)")), r"^['\"]|['\"]$", "")
    return rows.select("project_id", "file", key.alias("key"), value.alias("value"))


def config_definitions(files: DataFrame) -> DataFrame:
    """All defined keys: ``project_id, file, key, value``."""
    return env_definitions(files).unionByName(document_definitions(files)).unionByName(line_definitions(files))
