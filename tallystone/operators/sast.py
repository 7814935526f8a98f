"""Rule scans over lines: each language's rules are one projection, never a join of lines with rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_comment


@dataclass(frozen=True)
class Rule:
    id: str
    cwe: str
    severity: str
    owasp: str
    category: str
    description: str
    pattern: str
    languages: tuple[str, ...] = ("*",)
    false_positive: str | None = None


SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
FOUND = ("id", "cwe", "severity", "owasp", "category")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def scan(files: DataFrame, rules: list[Rule], project: str = "project_id", path: str = "path", content: str = "content", language: str | None = "lang", context: int = 3) -> DataFrame:
    """Findings: project, path, ``line_no``, the rule's columns and ``snippet``.

    Comment lines are skipped; a match is no finding if its line, or the lines up to ``context`` around it, match the
    rule's false-positive pattern. A line gives one finding per rule. Files are scanned in place: the lines of a text
    stay an array, only matches are exploded, and contexts are cut from the array. Patterns are literals, compiled once a task.
    """
    lang = F.col(language) if language else F.lit("text")
    parts = F.split(F.coalesce(F.col(content), F.lit("")), "\n", -1)
    rows = files.select(project, path, lang.alias("__lang"), parts.alias("__lines"))

    def around(lines: Column, i: Column) -> Column:
        first = F.greatest(F.lit(0), i - context)
        return F.array_join(F.slice(lines, first + 1, i + context + 1 - first), "\n")

    def hits(r: Rule):
        def good(line: Column) -> Column:
            hit = line["text"].rlike(f"(?i){r.pattern}") & ~is_comment(line["text"], F.col("__lang"))
            return hit & ~around(F.col("__lines"), line["no"]).rlike(f"(?i){r.false_positive}") if r.false_positive else hit

        return good

    def finding(r: Rule):
        values = [F.lit(getattr(r, f)).alias(f) for f in FOUND]
        return lambda line: F.struct((line["no"] + 1).alias("line_no"), *values, F.substring(F.trim(line["text"]), 1, 200).alias("snippet"))

    kept = []
    for r in rules:
        speaks = F.lit(True) if "*" in r.languages else F.col("__lang").isin(*r.languages)
        numbered = F.transform("__lines", lambda x, i: F.struct(i.alias("no"), x.alias("text")))
        found = F.transform(F.filter(numbered, hits(r)), finding(r))
        # most texts match no rule: one test of the whole text saves the walk over its lines (a lookahead could see past a line)
        some = F.lit(True) if "(?!" in r.pattern else F.col(content).rlike(f"(?im){r.pattern}")
        kept.append(F.when(speaks & some, found).otherwise(F.array().cast(f"array<struct<line_no:int,{','.join(f'{f}:string' for f in FOUND)},snippet:string>>")))
    out = files.select(project, path, F.col(content), lang.alias("__lang"), parts.alias("__lines")).select(project, path, F.explode(F.flatten(F.array(*kept))).alias("f")) if kept else rows.select(project, path).limit(0)
    return out.select(project, path, "f.*").withColumnRenamed("id", "rule_id")


def capped(findings: DataFrame, most: int = 50, project: str = "project_id", path: str = "path") -> DataFrame:
    """The first ``most`` findings of each rule and project, by path and line."""
    order = Window.partitionBy(project, "rule_id").orderBy(path, "line_no")
    return findings.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def summary(findings: DataFrame, sizes: DataFrame, project: str = "project_id") -> DataFrame:
    """Per project of ``sizes`` (project, ``lines``): findings by severity and their density per 1,000 lines."""
    n = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    per = findings.groupBy(project).agg(F.count("*").alias("findings"), *n)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("findings", *[s.lower() for s in SEVERITIES])]
    return sizes.join(per, project, "left").select(project, F.col("lines").cast("long").alias("lines"), *zero, F.round(F.coalesce(F.try_divide(F.coalesce("findings", F.lit(0)) * 1000.0, "lines"), F.lit(0.0)), 6).alias("density"))
