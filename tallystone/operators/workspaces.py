"""Where imports of JavaScript lead: relative paths, packages of the project's own workspaces, aliases of compiler settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import facts

#: Extensions of scripts, the suffixes that module names go without, files of compiler settings in their order, and the list in a workspace file.
SCRIPTS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
SUFFIX = r"(?<=.)\.(d\.ts|tsx?|jsx?|mjs|cjs)$"
SETTINGS = ("tsconfig.json", "tsconfig.app.json", "tsconfig.base.json")
LISTED = r"(?m)^[ \t]*packages:[^\n]*\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?(?:\n|$))*)"


def folder() -> Column:
    """The folder of a file of ``files``, empty for the project's own."""
    return F.array_join("dirs", "/")


def normal(path: Column, depth: int = 6) -> Column:
    """A path without ``.`` and without up to ``depth`` steps up; what leads out of the project keeps its ``..``."""
    path = F.regexp_replace(path, "/{2,}", "/")
    for _ in range(depth):
        path = F.regexp_replace(F.regexp_replace(path, r"(^|/)\.(/|$)", "$1"), r"(^|/)(?!\.\.?/)[^/]+/\.\.(/|$)", "$1")
    return F.regexp_replace(path, "/$", "")


def under(base: Column, path: Column) -> Column:
    return normal(F.concat_ws("/", F.nullif(base, F.lit("")), path))


def workspace_packages(files: DataFrame) -> DataFrame:
    """``project_id, package, dir`` of packages in folders that the root's ``package.json`` or ``pnpm-workspace.yaml`` lists.

    A pattern is a folder, or all folders right below one (``packages/*``) that aren't hidden; patterns with ``!`` don't count. Of two
    packages of one name the last listed stands. Files that aren't JSON list nothing.
    """
    root = files.where(F.size("dirs") == 0)
    lists = "struct<workspaces:array<string>>"
    nested = "struct<workspaces:struct<packages:array<string>>>"
    npm = root.where("name = 'package.json'").select("project_id", F.lit(1).alias("layer"), F.coalesce(F.from_json("content", lists)["workspaces"], F.from_json("content", nested)["workspaces"]["packages"]).alias("patterns"))
    lines = F.split(F.regexp_extract("content", LISTED, 1), "\n")
    items = F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.startswith("-")), lambda x: F.regexp_replace(F.regexp_replace(x, "^[- ]+", ""), "^['\"]+|['\"]+$", ""))
    pnpm = root.where("name = 'pnpm-workspace.yaml'").select("project_id", F.lit(0).alias("layer"), items.alias("patterns"))
    patterns = pnpm.unionByName(npm).select("project_id", "layer", F.posexplode("patterns").alias("at", "pattern")).where("pattern not like '!%'")
    star = F.col("pattern").endswith("/*")
    wanted = patterns.select("project_id", "layer", "at", star.alias("below"), normal(F.when(star, F.expr("left(pattern, length(pattern) - 2)")).otherwise(F.col("pattern"))).alias("place"))
    own = files.where("name = 'package.json'").select("project_id", folder().alias("dir"), F.get_json_object("content", "$.name").alias("package")).where("package <> ''")
    last = F.element_at(F.split("dir", "/"), -1)
    above = F.regexp_replace("dir", "/?[^/]*$", "")
    spots = own.select("project_id", "dir", "package", F.lit(False).alias("below"), F.col("dir").alias("place"))
    spots = spots.unionByName(own.where((F.col("dir") != "") & ~last.startswith(".")).select("project_id", "dir", "package", F.lit(True).alias("below"), above.alias("place")))
    found = spots.join(wanted, ["project_id", "below", "place"])
    return found.groupBy("project_id", "package").agg(F.max_by("dir", F.struct("layer", "at", "dir")).alias("dir"))


def path_aliases(files: DataFrame) -> DataFrame:
    """``project_id, alias, target, rank`` of compiler settings, each alias with its first target inside the project; comments are stripped.

    ``rank`` orders aliases: by name of the settings' file, its path, and place in it.
    """
    raw = F.regexp_replace(F.regexp_replace("content", r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", "")
    order = F.array_position(F.array(*map(F.lit, SETTINGS)), F.col("name"))
    rows = files.where(F.col("name").isin(*SETTINGS) & ~F.array_contains("dirs", "node_modules"))
    options = F.from_json(raw, "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>")["compilerOptions"]
    paths = rows.select("project_id", "path", order.alias("file"), folder().alias("dir"), options.alias("o"))
    each = paths.select("project_id", "path", "file", under(F.col("dir"), F.coalesce("o.baseUrl", F.lit("."))).alias("base"), F.posexplode("o.paths").alias("at", "pattern", "targets"))
    each = each.select("project_id", "path", "file", "base", "at", "pattern", F.posexplode("targets").alias("nth", "target"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\*+$", ""), "/+$", "")
    target = under(F.col("base"), bare(F.col("target")))
    each = each.select("project_id", bare(F.col("pattern")).alias("alias"), F.when(target == "", ".").otherwise(target).alias("target"), F.struct("file", "path", "at", "nth").alias("rank")).where(~F.col("target").rlike(r"^(\.\.(/|$)|/)"))
    return each.groupBy("project_id", "alias").agg(F.min_by("target", "rank").alias("target"), F.min("rank").alias("rank"))


def known_modules(files: DataFrame) -> DataFrame:
    """``project_id, target``: files, scripts without suffix, and every folder that holds a script."""
    scripts = files.where(F.col("ext").isin(*SCRIPTS))
    above = F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda n: F.array_join(F.slice("dirs", 1, n), "/"))
    names = F.array(text.js_module(F.col("path")), F.regexp_replace("path", SUFFIX, ""))
    targets = scripts.select("project_id", F.explode(F.concat(names, F.when(F.size("dirs") > 0, above).otherwise(F.array().cast("array<string>")))).alias("target"))
    return targets.unionByName(files.select("project_id", F.col("path").alias("target"))).distinct()


def references(files: DataFrame, pattern: str) -> DataFrame:
    """``project_id, path, module, is_internal, resolved`` of what scripts import by ``pattern``.

    Relative paths, packages of workspaces and aliases are internal, in this order; all else is external and counts as
    resolved. A package resolves to its folder, its ``src`` or the part named; an alias to its first target; each to a file, a script's name or a folder that holds one.
    """
    found = files.where(F.col("ext").isin(*SCRIPTS)).select("project_id", "path", folder().alias("dir"), F.explode(facts.every("content", pattern, 1)).alias("module"))
    wanted = found.select("project_id", "dir", "module").distinct()
    relative = wanted.where("module like '.%'").select("project_id", "dir", "module", F.array(under(F.col("dir"), F.col("module"))).alias("targets"))
    outer = wanted.where("module not like '.%'").select("project_id", "module").distinct().withColumn("package", text.npm_package(F.col("module")))
    home = outer.join(workspace_packages(files).withColumnRenamed("dir", "home"), ["project_id", "package"])
    rest = F.regexp_replace(F.expr("substring(module, length(package) + 1)"), "^/+", "")
    spots = F.when(rest != "", F.array(F.concat_ws("/", "home", F.lit("src"), rest), F.concat_ws("/", "home", rest))).otherwise(F.array(F.concat_ws("/", "home", F.lit("src")), F.col("home")))
    packaged = home.select("project_id", "module", spots.alias("targets"))
    steps = F.split("module", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    tried = outer.join(packaged, ["project_id", "module"], "left_anti").select("project_id", "module", F.explode(heads).alias("alias")).join(path_aliases(files), ["project_id", "alias"])
    first = tried.groupBy("project_id", "module").agg(F.min_by(F.struct("alias", "target"), "rank").alias("x"))
    tail = F.regexp_replace(F.expr("substring(module, length(x.alias) + 1)"), "^/+", "")
    aliased = first.select("project_id", "module", F.array(F.concat_ws("/", F.col("x.target"), F.nullif(tail, F.lit("")))).alias("targets"))
    ways = relative.unionByName(wanted.where("module not like '.%'").join(packaged.unionByName(aliased), ["project_id", "module"]).select("project_id", "dir", "module", "targets"))
    both = F.array_distinct(F.concat("targets", F.transform("targets", lambda t: F.regexp_replace(t, SUFFIX, ""))))
    hits = ways.select("project_id", "dir", "module", F.explode(both).alias("target")).join(known_modules(files), ["project_id", "target"], "left_semi").select("project_id", "dir", "module", F.lit(True).alias("hit")).distinct()
    inner = ways.select("project_id", "dir", "module", F.lit(True).alias("inner")).join(hits, ["project_id", "dir", "module"], "left")
    out = found.join(inner, ["project_id", "dir", "module"], "left")
    return out.select("project_id", "path", "module", F.col("inner").isNotNull().alias("is_internal"), (F.col("inner").isNull() | F.col("hit").isNotNull()).alias("resolved"))
