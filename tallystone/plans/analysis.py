"""The whole analysis of projects: from a table of files to one row of metrics per project."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rates import density, smoothed_rate
from ..operators import boundary, facts, graph, metrics, workspaces
from ..operators.modules import all_edges
from ..sources import manifests, tree

#: Fixed value: an import of a JavaScript module.
JS_IMPORT = r"(?:\bfrom\s+|\brequire\s*\(\s*|\bimport\s*\(\s*|\bimport\s+)['\"]([^'\"]+)['\"]"


def import_references(files: DataFrame) -> DataFrame:
    """``project_id, path, module, is_internal, resolved``.

    A Python module is internal if it, a package above it or a module below it is the project's, and resolved if it or a module below it is.
    For JavaScript see ``workspaces.references``.
    """
    py = files.where(F.col("ext").isin(".py", ".pyi"))
    parts = F.split(text.python_module(F.col("path")), r"\.", -1)
    prefixes = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, 1, n), "."))
    own = py.select("project_id", F.explode(prefixes(parts)).alias("module")).where("module <> ''").distinct().withColumn("known", F.lit(True))
    refs = facts.python_facts(files).where("kind in ('import', 'import_from')").select("project_id", "path", F.when((F.col("name") == "") & (F.col("value") > 0), ".").otherwise(F.col("name")).alias("module"))
    # a package above: some proper prefix is the project's own
    above = refs.select("project_id", "module").distinct().select("project_id", F.col("module").alias("m"), F.explode(prefixes(F.split("module", r"\.", -1))).alias("module"))
    above = above.join(own, ["project_id", "module"], "left_semi").select("project_id", F.col("m").alias("module")).distinct().withColumn("is_internal", F.lit(True))
    python = refs.join(own, ["project_id", "module"], "left").join(above, ["project_id", "module"], "left")
    python = python.select("project_id", "path", "module", F.coalesce("is_internal", F.lit(False)).alias("is_internal"), (F.col("known").isNotNull() | F.col("is_internal").isNull()).alias("resolved"))
    script = workspaces.references(files, JS_IMPORT)
    return python.unionByName(script)


#: Modules that Node itself has.
NODE_BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()


def used_packages(files: DataFrame) -> DataFrame:
    """``project_id, ecosystem, name`` of declared and imported packages, without the languages' own modules; case and dots aside for Python."""
    declared = manifests.dependencies(files).where("ecosystem in ('pypi', 'npm')").select("project_id", "ecosystem", "name")
    outer = import_references(files).where("not is_internal and module not like '.%'")
    python = outer.where(F.col("path").endswith(".py")).select("project_id", F.lit("pypi").alias("ecosystem"), F.substring_index("module", ".", 1).alias("name")).where(~F.col("name").isin(*sys.stdlib_module_names))
    script = outer.where(~F.col("path").endswith(".py") & ~F.col("module").startswith("node:")).select("project_id", F.lit("npm").alias("ecosystem"), text.npm_package(F.col("module")).alias("name")).where(~F.col("name").isin(*NODE_BUILTINS))
    both = declared.unionByName(python).unionByName(script).where("name <> ''")
    name = F.when(F.col("ecosystem") == "pypi", F.replace(F.lower("name"), F.lit("_"), F.lit("-"))).otherwise(F.col("name"))
    return both.select("project_id", "ecosystem", name.alias("name")).distinct()


def missing_density(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``project_id, packages, missing, hd``: packages that no row of ``registry`` (ecosystem, name, exists) has, per 1,000 lines of code."""
    known = registry.where("exists").select("ecosystem", "name").distinct().withColumn("known", F.lit(True))
    per = used_packages(files).join(known, ["ecosystem", "name"], "left").groupBy("project_id").agg(F.count("*").alias("packages"), F.count_if(F.col("known").isNull()).alias("missing"))
    code = text.lines(files.where(F.col("ext").isin(".py", ".js", ".ts", ".tsx", ".jsx", ".sol")), ["project_id"], keep_last=False).groupBy("project_id").agg(F.count_if(text.code_lines(F.col("text"), 1)).alias("lines"))
    return per.join(code, "project_id", "left").select("project_id", "packages", "missing", density(F.col("missing"), F.coalesce("lines", F.lit(0))).alias("hd"))


def rate_of(df: DataFrame, hit: Column, name: str) -> DataFrame:
    return df.groupBy("project_id").agg(smoothed_rate(hit).alias(name))


def checks(files: DataFrame) -> DataFrame:
    """Readiness checks by kind of project: contract checks where there are contracts or no Python, Python checks otherwise."""
    kind = files.groupBy("project_id").agg((F.bool_or(F.col("ext") == ".sol") | ~F.bool_or(F.col("ext") == ".py")).alias("contracts"))
    pick = lambda c: files.join(kind.where(c).select("project_id"), "project_id", "left_semi")
    return boundary.contract_checks(pick("contracts")).unionByName(boundary.python_checks(pick("not contracts")))


def analyse(files: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row per project of a table of files (``sources.tree.read_tree``): graph, rates, densities, readiness and the composite.

    A rate of nothing is 0; complexity and smells are null without Python files; levels that aren't measured stay out of the composite.
    Packages are looked up in ``registry`` (ecosystem, name, exists); without one, ``hd`` is null.
    """
    kept = tree.analysed(files)
    projects = files.select("project_id").distinct()
    edges = graph.edge_map(all_edges(kept))
    ddg = graph.feasibility(projects, graph.cycles(edges)).select("project_id", "cycles", "rating", "drd")
    calls = facts.api_calls(kept).where(text.is_internal_url(F.col("path"))).withColumn("call_id", F.monotonically_increasing_id())
    calls = calls.select("project_id", "call_id", "method", F.regexp_replace(text.url_path(F.col("path")), "^$", "/").alias("path"))
    icr = metrics.interface_consistency(calls, facts.api_endpoints(kept).select("project_id", "method", F.col("path").alias("route")).distinct()).select("project_id", "icr")
    refs = facts.config_references(kept).select("project_id", "key").withColumn("ref", F.monotonically_increasing_id())
    defs = manifests.config_definitions(kept).select("project_id", F.explode(text.config_key_variants(F.col("key"))).alias("v")).distinct()
    known = refs.select("project_id", "ref", F.explode(text.config_key_variants(F.col("key"))).alias("v")).join(defs, ["project_id", "v"], "left_semi").select("ref", F.lit(True).alias("hit")).distinct()
    ccs = rate_of(refs.join(known, "ref", "left"), F.col("hit").isNotNull(), "ccs")
    urr = import_references(kept).where("is_internal").groupBy("project_id").agg(smoothed_rate(~F.col("resolved")).alias("urr"))
    found = facts.python_facts(kept)
    ccx = found.where("kind = 'function'").groupBy("project_id").agg(F.avg("value").alias("ccx"))
    lines = text.lines(kept.where(F.col("ext") == ".py"), ["project_id"], keep_last=False)
    sized = lines.groupBy("project_id").agg(F.count_if(text.code_lines(F.col("text"), 2)).alias("code_lines"), F.count_if((F.length("text") > 120)).alias("long"), F.count_if(F.col("text").rlike(r"(?i)#\s*(TODO|FIXME|XXX|HACK)")).alias("marked"))
    smells = found.where("kind = 'smell'").groupBy("project_id").agg(F.count("*").alias("undocumented"))
    drs = metrics.readiness(checks(files)).select("project_id", "drs")
    hd = missing_density(kept, registry).select("project_id", "hd") if registry is not None else projects.withColumn("hd", F.lit(None).cast("double"))
    out = projects.join(hd, "project_id", "left")
    for part in (ddg, icr, ccs, urr, ccx, sized, smells, drs):
        out = out.join(part, "project_id", "left")
    csd = F.try_divide((F.col("long") + F.col("marked") + F.coalesce("undocumented", F.lit(0))) * 1000.0, F.col("code_lines"))
    out = out.withColumn("csd", csd).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("icr", "ccs", "urr")})
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    third = F.array_compact(F.array(clamp(F.col("ccx") / 15), clamp(F.col("csd") / 100)))
    out = out.withColumns({"l1": 1 - F.col("drs"), "l2": (clamp(1 - F.col("icr")) + clamp(1 - F.col("ccs")) + clamp(F.col("urr"))) / 3, "l3": F.try_divide(F.aggregate(third, F.lit(0.0), lambda a, x: a + x), F.size(third))})
    return metrics.composite(out, ["l1", "l2", "l3"]).select("project_id", "cycles", "rating", "drd", "icr", "ccs", "urr", "hd", "ccx", "csd", "drs", "l1", "l2", "l3", "acds", "measured", "unmeasured")
