"""Illusion depth: the highest of ten stages that a project's files pass, from what can be told without running anything."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import yaml_verdicts

#: Names of the stages from 0 to 10.
STAGES = ("UNPARSEABLE", "PARSEABLE", "COMPILE", "LINT", "TYPE_CHECK", "UNIT_TEST", "INTEGRATION", "SAST", "BUILD", "DEPLOY", "HEALTHY")
COMPOSE_NAME = r"^(docker-compose|compose).*\.yml$"


def _compiles(text: str | None) -> tuple[bool, bool]:
    """Whether a Python file parses, and whether it compiles."""
    import ast
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return False, False
        try:
            compile(tree, "file", "exec", dont_inherit=True)
        except (SyntaxError, ValueError, RecursionError):
            return True, False
    return True, True


def python_stages(files: DataFrame) -> DataFrame:
    """``project_id, path, parses, compiles`` of Python files, each read once."""

    def run(batches):
        for b in batches:
            both = [_compiles(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in both], pa.bool_()), pa.array([y for _, y in both], pa.bool_())], ["project_id", "path", "parses", "compiles"])

    key = dict(files.dtypes)["project_id"]
    return files.where("ext = '.py'").select("project_id", "path", "content").mapInArrow(run, f"project_id {key}, path string, parses boolean, compiles boolean")


def illusion_depth(files: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """``project_id, stage, stage_name``: the last stage before the first that fails; 10 if none does.

    Parsing, compiling, the Dockerfile at the root (a FROM line) and the compose files there (a mapping with services or version) are
    read from the files. What needs tools comes as a table ``outcomes`` (project_id, stage, passed), as of linters, type checkers, tests and
    scanners; without a row a stage passes. A project without files of a kind passes that kind's stage.
    """
    projects = files.select("project_id").distinct()
    python = python_stages(files).groupBy("project_id").agg(F.bool_and("parses").alias("s1"), F.bool_and("compiles").alias("s2"))
    docker = files.where("path = 'Dockerfile'").groupBy("project_id").agg(F.bool_and(F.col("content").rlike(r"(?im)^\s*FROM")).alias("s8"))
    compose = files.where((F.size("dirs") == 0) & F.col("name").rlike(COMPOSE_NAME))
    valid = yaml_verdicts(compose, lambda d: isinstance(d, dict) and ("services" in d or "version" in d)).groupBy("project_id").agg(F.bool_and("fine").alias("s9"))
    out = projects
    for part in (python, docker, valid):
        out = out.join(part, "project_id", "left")
    if outcomes is not None:
        told = outcomes.where(F.col("stage").between(1, 10)).groupBy("project_id").pivot("stage", list(range(1, 11))).agg(F.bool_and("passed"))
        out = out.join(told.select("project_id", *[F.col(str(i)).alias(f"t{i}") for i in range(1, 11)]), "project_id", "left")
    passed = lambda i: F.least(*[F.coalesce(F.col(c), F.lit(True)) for c in (f"s{i}", f"t{i}") if c in out.columns], F.lit(True), F.lit(True))
    stage = F.lit(10)
    for i in range(10, 0, -1):
        stage = F.when(~passed(i), i - 1).otherwise(stage)
    return out.select("project_id", stage.alias("stage")).withColumn("stage_name", F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage") + 1))
