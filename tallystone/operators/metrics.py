"""Metrics of systems from fact tables that carry ``project_id``; a missing measurement is null, never 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.rates import density, smoothed_rate


def _rate(df: DataFrame, hit: Column, n: str, n_hit: str, name: str) -> DataFrame:
    return df.groupBy("project_id").agg(F.count("*").alias(n), F.count_if(hit).alias(n_hit), F.round(smoothed_rate(hit), 6).alias(name))


def interface_consistency(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Internal calls that an endpoint of the project answers.

    ``calls``: project, call_id, method, path; ``endpoints``: project, method (``*``: any), route. A path that is
    itself templated counts as answered. Literal routes match by equality; only templated ones are tried as
    patterns, against calls of the same project and number of segments, so the pattern join stays narrow.
    """
    plain = lambda c: F.regexp_replace(c, "/$", "")
    segments = lambda c: F.size(F.split(plain(c), "/", -1))
    templated = F.col("route").rlike(r"[{<:\[]")
    calls = calls.withColumns({"p": plain(F.col("path")), "k": segments(F.col("path"))})
    ends = endpoints.withColumns({"templated": templated, "p2": plain(F.col("route")), "k2": segments(F.col("route")), "r": text.template_regex(F.col("route"))})
    same = lambda e: (calls["project_id"] == e["project_id"]) & ((e["method"] == "*") | (e["method"] == calls["method"]))
    literal, pattern = ends.where("not templated"), ends.where("templated")
    exact = calls.join(literal, same(literal) & (calls["p"] == literal["p2"]), "left_semi").select("call_id")
    fits = calls.join(pattern, same(pattern) & (calls["k"] == pattern["k2"]) & F.expr("path rlike r"), "left_semi").select("call_id")
    hits = exact.unionByName(fits).distinct().withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False)) | F.col("path").contains("{")
    return _rate(calls.join(hits, "call_id", "left"), hit, "calls", "matched", "icr")


def config_consistency(refs: DataFrame, defs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """References to configuration keys that are defined; ``fuzzy`` also accepts other case, separators and build prefixes, by equi-join on the variants."""
    refs = refs.withColumn("__ref", F.monotonically_increasing_id())
    known = defs.select(F.col("key").alias("__key")).distinct()
    found = refs.join(known, refs["key"] == known["__key"], "left_semi").select("__ref")
    if fuzzy:
        variants = defs.select(F.explode(text.config_key_variants(F.col("key"))).alias("__key")).distinct()
        found = found.unionByName(refs.select("__ref", F.explode(text.config_key_variants(F.col("key"))).alias("__key")).join(variants, "__key", "left_semi").select("__ref"))
    hits = found.distinct().withColumn("hit", F.lit(True))
    return _rate(refs.join(hits, "__ref", "left"), F.coalesce("hit", F.lit(False)), "refs", "defined", "ccs")


def unresolved_references(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """Internal references without a module."""
    known = modules.select("module").distinct().withColumn("known", F.lit(True))
    return _rate(refs.join(known, "module", "left"), F.col("known").isNull(), "refs", "unresolved", "urr")


def missing_packages(used: DataFrame, sizes: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct packages that no registry row names, per 1,000 lines. ``sizes``: project, lines."""
    known = registry.select("name").distinct().withColumn("known", F.lit(True))
    per = used.select("project_id", "name").distinct().join(known, "name", "left").groupBy("project_id").agg(F.count("*").alias("packages"), F.count_if(F.col("known").isNull()).alias("missing"))
    return per.join(sizes, "project_id").select("project_id", F.col("lines").cast("long").alias("lines"), "packages", "missing", F.round(density(F.col("missing"), F.col("lines")), 6).alias("hd"))


def readiness(checks: DataFrame) -> DataFrame:
    """Share of applicable checks that pass; 0 if none applies."""
    ok = F.col("passed") & F.col("applicable")
    share = F.coalesce(F.try_divide(F.count_if(ok), F.count_if("applicable")), F.lit(0.0))
    return checks.groupBy("project_id").agg(F.count_if("applicable").alias("applicable"), F.count_if(ok).alias("passing"), F.round(share, 6).alias("drs"))


def check_status(checks: DataFrame) -> DataFrame:
    """Number of projects that pass, fail or aren't subject to each check; a passed check is a pass even where it doesn't apply."""
    status = F.when(F.col("passed"), "PASS").when(~F.col("applicable"), "N/A").otherwise("FAIL")
    return checks.groupBy("name").agg(*[F.count_if(status == s).alias(a) for s, a in (("PASS", "pass"), ("FAIL", "fail"), ("N/A", "na"))])


def homogeneity(items: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of the projects of a cohort, from distinct ``(cohort, project_id, item)``.

    Overlaps are counted through the shared items; pairs that share none add 0 and are only counted. An item that
    many projects hold makes as many pairs as it has projects, so a cohort is bounded by the caller.
    """
    sizes = items.groupBy("cohort", "project_id").agg(F.count("*").alias("n"))
    cohort = sizes.groupBy("cohort").agg(F.count("*").alias("m")).select("cohort", F.expr("m * (m - 1) div 2").alias("pairs"))
    a, b = items.select("cohort", "item", F.col("project_id").alias("x")), items.select("cohort", "item", F.col("project_id").alias("y"))
    both = a.join(b, ["cohort", "item"]).where("x < y").groupBy("cohort", "x", "y").agg(F.count("*").alias("k"))
    left, right = sizes.select("cohort", F.col("project_id").alias("x"), F.col("n").alias("nx")), sizes.select("cohort", F.col("project_id").alias("y"), F.col("n").alias("ny"))
    total = both.join(left, ["cohort", "x"]).join(right, ["cohort", "y"]).groupBy("cohort").agg(F.sum(F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))).alias("sum"))
    return cohort.where("pairs > 0").join(total, "cohort", "left").select("cohort", "pairs", F.round(F.coalesce("sum", F.lit(0.0)) / F.col("pairs"), 6).alias("thi"))


def first_failed_stage(stages: list[Column], healthy: int = 10) -> Column:
    """The number of the first stage that fails, or ``healthy``."""
    out = F.lit(healthy)
    for i in range(len(stages) - 1, -1, -1):
        out = F.when(~stages[i], i).otherwise(out)
    return out


def smell_density(lines: DataFrame, width: int = 120) -> DataFrame:
    """Long lines and task markers of ``(project_id, text)``, and lines with either per 1,000 lines that aren't blank."""
    long_, marked = F.length("text") > width, F.col("text").rlike(r"(?i)\b(todo|fixme|xxx|hack)\b")
    return lines.groupBy("project_id").agg(F.count_if(long_).alias("low"), F.count_if(marked).alias("info"), F.round(density(F.count_if(long_ | marked), F.count_if(F.trim("text") != "")), 6).alias("csd"))


def complexity(functions: DataFrame) -> DataFrame:
    """Mean and largest complexity per project, number of functions and of those above 10."""
    c = F.col("complexity")
    return functions.groupBy("project_id").agg(F.round(F.avg(c), 6).alias("ccx"), F.max(c).cast("long").alias("worst"), F.count("*").alias("functions"), F.count_if(c > 10).alias("above"))


def composite(levels: DataFrame, names: list[str]) -> DataFrame:
    """``acds`` = 1 - product of (1 - level) over the measured levels, each clamped to [0, 1]; which are unmeasured."""
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
    left = reduce(lambda a, b: a * b, [F.coalesce(1 - clamp(c), F.lit(1.0)) for c in names])
    measured = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in names])
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in names])
    acds = F.when(measured > 0, F.round(1 - left, 6))
    return levels.withColumns({"acds": acds, "measured": measured, "unmeasured": missing})


def issue_count(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags])


def parse_judgements(rows: DataFrame, path: str = "$.score") -> DataFrame:
    """``score`` from the raw JSON answers; null where an answer doesn't parse."""
    return rows.withColumn("score", F.get_json_object("raw", path).try_cast("double"))


def byte_budget(files: DataFrame, budget: int) -> DataFrame:
    """Files of each project, largest first, up to ``budget`` bytes; ``taken`` of the last is what is left."""
    order = Window.partitionBy("project_id").orderBy(F.desc("bytes"), "path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(order), F.lit(0))
    return files.withColumn("__before", before).where(F.col("__before") < budget).withColumn("taken", F.least("bytes", F.lit(budget) - F.col("__before"))).drop("__before")


def step_sample(df: DataFrame, key: str, order: str, step: int, most: int) -> DataFrame:
    """Every ``step``-th row of each key, at most ``most``."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__r", r).where(((F.col("__r") - 1) % step == 0) & (F.col("__r") <= step * most)).drop("__r")


def first_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def union_fallback(first: DataFrame, other: DataFrame) -> DataFrame:
    """``first``, or ``other`` if that is empty: decided in the plan, from one row."""
    any_ = first.limit(1).agg(F.count("*").alias("__n"))
    return first.unionByName(other.join(F.broadcast(any_), F.col("__n") == 0, "inner").drop("__n"))
