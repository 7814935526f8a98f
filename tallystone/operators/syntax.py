"""What Python syntax trees hold, as a table: imports, calls, decorators, routes, environment reads, classes, framework objects.

Each text is parsed once in a narrow pass; questions about the code are filters on the table.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fenced block and the languages that count as Python, methods of HTTP in decorators, classes of web frameworks.
FENCE = r"```(\w*)\s*\n(.*?)```"
PYTHON_FENCES = ("", "python", "py", "python3")
ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "api_route")
FRAMEWORKS = {"Flask": "flask", "flask.Flask": "flask", "FastAPI": "fastapi", "fastapi.FastAPI": "fastapi", "Starlette": "starlette", "starlette.Starlette": "starlette"}

RECORD = "section int, kind string, name string, detail string, items array<string>, number int, line_no int"


def parsed(code: str | None) -> ast.Module | None:
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def sections(text: str | None) -> list[ast.Module]:
    """Trees of the fenced Python blocks of a Markdown text that parse; if there are none, of the text itself."""
    blocks = [m[2] for m in re.finditer(FENCE, text or "", re.S) if m[1].lower() in PYTHON_FENCES]
    trees = [t for t in map(parsed, blocks) if t is not None]
    whole = parsed(text) if not trees else None
    return trees if whole is None else [whole]


def dotted(x: ast.expr) -> str:
    """The dotted name of an expression; subscripts are looked through, and what has no name gives the attributes after it."""
    parts: list[str] = []
    while isinstance(x, (ast.Attribute, ast.Subscript)):
        if isinstance(x, ast.Attribute):
            parts.append(x.attr)
        x = x.value
    if isinstance(x, ast.Name):
        parts.append(x.id)
    return ".".join(reversed(parts))


def literal(x: ast.expr | None) -> str | None:
    return x.value if isinstance(x, ast.Constant) and isinstance(x.value, str) else None


def literals(x: ast.expr | None) -> list[str] | None:
    """Upper-case strings of a list, or None for what is no list."""
    return [s.upper() for s in map(literal, x.elts) if s] if isinstance(x, ast.List) else None


def of_decorator(deco: ast.expr, line: int):
    """The decorator's record, and its route if it registers one."""
    call = deco if isinstance(deco, ast.Call) else None
    name = dotted(call.func if call else deco)
    if not name:
        return
    yield "decorator", name, None, [], 0, line
    owner, _, last = name.rpartition(".")
    last, first = last.lower(), call.args[0] if call and call.args else None
    if name == "api_view" or (owner and last == "api_view"):
        asked = literals(first)
        yield "route", "", name, ["GET"] if asked is None else asked, 0, line
    elif owner and last == "route":
        asked = next((literals(k.value) for k in reversed(call.keywords) if k.arg == "methods" and isinstance(k.value, ast.List)), None) if first is not None else None
        yield "route", literal(first) or "", name, asked or ["GET"], 0, line
    elif owner and last in ROUTE_METHODS:
        yield "route", literal(first) or "", name, ["GET" if last == "api_route" else last.upper()], 0, line


def of_node(x: ast.AST):
    """Records of one node: kind, name, detail, items, number, line."""
    match x:
        case ast.Import():
            for a in x.names:
                yield "import", a.name, None, [a.asname or a.name], 0, x.lineno
        case ast.ImportFrom():
            yield "import", x.module or "", "from", [a.name for a in x.names], x.level or 0, x.lineno
        case ast.Call():
            name = dotted(x.func).lower()
            if name:
                yield "call", name, None, [], len(x.args) + len(x.keywords), x.lineno
            if name in ("os.getenv", "os.environ.get"):
                yield "env", literal(x.args[0] if x.args else None), name[3:].replace(".", "_"), [], 0, x.lineno
        case ast.Subscript() if dotted(x.value).lower() == "os.environ":
            yield "env", literal(x.slice), "environ_subscript", [], 0, x.lineno
        case ast.Assign() if isinstance(x.value, ast.Call) and dotted(x.value.func) in FRAMEWORKS:
            for target in x.targets:
                if isinstance(target, ast.Name):
                    yield "app", target.id, FRAMEWORKS[dotted(x.value.func)], [], 0, x.lineno
        case ast.ClassDef():
            idle = all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in x.body)
            yield "class", x.name, None, [b for b in map(dotted, x.bases) if b], int(not idle), x.lineno
    match x:
        case ast.ClassDef():
            for deco in x.decorator_list:
                yield from (r for r in of_decorator(deco, x.lineno) if r[0] == "decorator")
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            for deco in x.decorator_list:
                yield from of_decorator(deco, x.lineno)


def syntax(files: DataFrame, fenced: bool = False, keys: tuple[str, ...] = ("project_id", "path"), text_col: str = "content") -> DataFrame:
    """``keys`` (strings) with ``section, kind, name, detail, items, number, line_no``, one row a fact.

    ``import``: module, ``from``, names, level. ``call``: lower-case dotted name, number of arguments. ``decorator``: name. ``route``: path, decorator,
    methods. ``env``: key (null if computed), way of access. ``class``: name, bases, 1 if it has a body. ``app``: variable, framework.
    ``tree`` stands once for each text that parses; null and empty texts do, and hold nothing else. Texts that don't parse give no rows.
    With ``fenced``, the fenced Python blocks of Markdown are the sections, else the whole text is section 0.
    """
    names, kinds = [*keys, *(c.split()[0] for c in RECORD.split(", "))], [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for *own, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    whole = None if fenced else parsed(text)
                    for i, tree in enumerate(sections(text) if fenced else [whole] if whole is not None else []):
                        out.append((*own, i, "tree", None, None, [], 0, 0))
                        out += [(*own, i, *r) for x in ast.walk(tree) for r in of_node(x)]
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * len(keys) + kinds, strict=True)], names)

    return files.select(*keys, text_col).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", " + RECORD)


def within(name: Column, *wanted: str) -> Column:
    """Whether a dotted name is one of those wanted or lies below it; case aside."""
    low = F.lower(name)
    out = F.lit(False)
    for w in map(str.lower, wanted):
        out = out | (low == w) | low.startswith(w + ".")
    return out


def calls(found: DataFrame, *wanted: str) -> DataFrame:
    """Calls of functions, or of anything below a module, of a table by ``syntax``."""
    return found.where((F.col("kind") == "call") & within(F.col("name"), *wanted))


def imports_module(module: str) -> Column:
    """Whether a row of ``syntax`` imports the module, something below it, or a name like it."""
    return (F.col("kind") == "import") & (within(F.col("name"), module) | F.exists("items", lambda i: F.lower(i) == module.lower()))


def decorated(pattern: str) -> Column:
    """Whether a row of ``syntax`` is a decorator that fits a pattern, in which ``*`` stands for anything; case aside."""
    quoted = ".*".join(re.escape(p) for p in pattern.lower().split("*"))
    return (F.col("kind") == "decorator") & F.lower("name").rlike(f"^{quoted}$")


def classes(found: DataFrame, pattern: str) -> DataFrame:
    """Classes whose names hold a match of a regular expression; case aside."""
    return found.where((F.col("kind") == "class") & F.col("name").rlike(f"(?i){pattern}"))
