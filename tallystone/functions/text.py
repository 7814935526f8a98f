"""Column functions over source text: lines, comments, paths, URLs and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame, keys: list[str], content: str = "content", keep_last: bool = True) -> DataFrame:
    """One row per line: the keys, ``line_no`` from 1 and ``text``. ``keep_last=False`` leaves out the empty line after a final line end."""
    parts = F.split(F.col(content), "\n", -1)
    if not keep_last:
        parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select(*keys, F.posexplode(parts).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def code_lines(text: Column, variant: int) -> Column:
    """Whether a line counts under one of the four countings of code size: 1 and 2 leave out comment lines by
    different signs, 3 counts all lines, 4 those that aren't blank."""
    s = F.trim(text)
    if variant == 1:
        return (s != "") & ~starts_with_any(s, ["#", "//", "/*", "*"])
    if variant == 2:
        return (s != "") & ~starts_with_any(s, ["#", "//"])
    return F.lit(True) if variant == 3 else s != ""


def url_path(url: Column) -> Column:
    """The path of a URL, without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def path_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)


def is_internal_url(url: Column) -> Column:
    """Loopback or templated hosts, host-relative paths, variables and environment mentions; without a scheme, whatever has a slash."""
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    has_scheme = url.rlike(r"^https?://")
    bare = F.regexp_replace(host, ":[0-9]+$", "")
    local = bare.isin("localhost", "127.0.0.1", "0.0.0.0") | host.rlike(r"[$\{]")
    relative = url.startswith("/") & ~url.startswith("//")
    return F.when(has_scheme, local).otherwise(relative | url.rlike(r"^[$\{]") | url.rlike(r"process\.env|import\.meta\.env|os\.environ") | url.contains("/"))


def template_regex(path: Column) -> Column:
    """An anchored regular expression for a templated route: parameters match one segment, with an optional final slash."""
    quoted = F.regexp_replace(path, r"([.()|?$*])", r"\\$1")
    params = F.regexp_replace(F.regexp_replace(quoted, r"\{[^}]*\}|<[^>]*>", "[^/]+"), r":[A-Za-z_][A-Za-z0-9_]*", "[^/]+")
    return F.concat(F.lit("^"), F.regexp_replace(params, "/$", ""), F.lit("/?$"))


def python_module(path: Column) -> Column:
    """Module name of a Python file: dots for slashes, a package for its ``__init__``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), "/", "."), r"(^|\.)__init__$", "")


def js_module(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.(d\.ts|tsx?|jsx?|mjs|cjs)$", ""), "/index$", "")


def npm_package(specifier: Column) -> Column:
    """The package of an import: two parts for a scoped name, one otherwise."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def dist_name(name: Column) -> Column:
    """Lower case, with ``-`` and ``.`` as ``_``."""
    return F.regexp_replace(F.lower(name), r"[-.]", "_")


def config_key_variants(key: Column, prefixes: tuple[str, ...] = ("REACT_APP_", "NEXT_PUBLIC_", "VITE_", "VUE_APP_")) -> Column:
    """Keys under which a configuration name also counts as defined: case and separators aside, with or without a build prefix."""
    norm = F.upper(F.regexp_replace(key, "-", "_"))
    bare = F.regexp_replace(norm, "^(" + "|".join(prefixes) + ")", "")
    return F.array_distinct(F.array(norm, bare))


def is_comment(text: Column, language: Column) -> Column:
    """Whether a line is blank or a comment of its language, by how it starts."""
    s = F.trim(text)
    marked = F.when(language == "python", s.startswith("#")).when(language.isin("javascript", "typescript", "go", "rust"), s.startswith("//")).when(language == "solidity", s.startswith("//") | s.startswith("/*"))
    return (s == "") | F.coalesce(marked, F.lit(False))
