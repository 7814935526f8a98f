"""Facts of syntax trees, imports through workspaces and aliases, and fingerprints, against hand-made cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallystone.operators import metrics, syntax, workspaces
from tallystone.plans import analysis
from tallystone.sources import tree as trees


def tree(spark, files):
    df = spark.createDataFrame([(p, f, t) for p, f, t in files], "project_id string, path string, content string")
    parts = F.split("path", "/")
    return df.withColumns({"name": F.element_at(parts, -1), "dirs": F.slice(parts, F.lit(1), F.size(parts) - 1), "ext": F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))})


CODE = '''
import os, requests as rq
from ..web import Client, fetch
app = Flask(__name__)
api = fastapi.FastAPI()
a[0] = Starlette()

@app.route("/items/<id>", methods=["get", "post"])
def items(): return os.environ["KEY"], os.environ[name]

@app.route("/plain")
@api.get("/users")
@cached
async def users(): return requests.get(os.getenv("URL"), timeout=3), OS.environ.get("mode"), f()()

@api_view(["PUT"])
@router.api_route("/any")
def view(): pass

@dataclass(frozen=True)
class Shop(base.Model, Generic[T]):
    """only words"""

class ShopTest(Shop):
    x = 1
'''


def test_syntax(spark):
    files = tree(spark, [("p", "a.py", CODE), ("p", "bad.py", "def ("), ("p", "none.py", None), ("p", "nul.py", "x\0")])
    found = syntax.syntax(files).cache()
    rows = {k: {(r.name, r.detail, tuple(r["items"]), r.number) for r in found.where(F.col("kind") == k).collect()} for k in ("import", "call", "decorator", "route", "env", "class", "app")}
    assert rows["import"] == {("os", None, ("os",), 0), ("requests", None, ("rq",), 0), ("web", "from", ("Client", "fetch"), 2)}
    assert rows["app"] == {("app", "flask", (), 0), ("api", "fastapi", (), 0)}
    assert rows["env"] == {("KEY", "environ_subscript", (), 0), (None, "environ_subscript", (), 0), ("URL", "getenv", (), 0), ("mode", "environ_get", (), 0)}
    assert rows["route"] == {("/items/<id>", "app.route", ("GET", "POST"), 0), ("/plain", "app.route", ("GET",), 0), ("/users", "api.get", ("GET",), 0), ("", "api_view", ("PUT",), 0), ("/any", "router.api_route", ("GET",), 0)}
    assert {d[0] for d in rows["decorator"]} == {"app.route", "api.get", "cached", "api_view", "router.api_route", "dataclass"}
    assert rows["class"] == {("Shop", None, ("base.Model", "Generic"), 0), ("ShopTest", None, ("Shop",), 1)}
    assert {(r.name, r.number) for r in syntax.calls(found, "Requests", "os.getenv").collect()} == {("requests.get", 2), ("os.getenv", 1)}
    ask = lambda c: found.where(c).count() > 0
    assert ask(syntax.imports_module("requests")) and ask(syntax.imports_module("client")) and not ask(syntax.imports_module("flask"))
    assert ask(syntax.decorated("app.*")) and ask(syntax.decorated("DataClass")) and not ask(syntax.decorated("app"))
    assert [r.name for r in syntax.classes(found, "test$").collect()] == ["ShopTest"]
    assert {r.path for r in found.where("kind = 'tree'").collect()} == {"a.py", "none.py"}


def test_sections(spark):
    md = "text\n```python\nimport a\n```\n```js\nimport b\n```\n```\nimport c\n```\n```py\nimport (\n```\n"
    found = syntax.syntax(tree(spark, [("p", "x.md", md), ("p", "y.md", "import d"), ("p", "z.md", "no python here")]), fenced=True)
    assert {(r.path, r.section, r.name) for r in found.where("kind = 'import'").collect()} == {("x.md", 0, "a"), ("x.md", 1, "c"), ("y.md", 0, "d")}


def test_workspaces_and_aliases(spark):
    settings = '{\n // paths\n "compilerOptions": {"baseUrl": "src", "paths": {"@ui/*": ["../lib/ui/*", "x/*"], "~": ["app"], "up/*": ["../../out/*"]}}}'
    uses = "\n".join(f"import x{i} from '{m}';" for i, m in enumerate(["@co/store", "@co/api/mocks", "@co/api/none", "@co/hidden", "@ui/button", "@ui/missing", "~/main", "up/y", "react", "./side", "./folder", "./gone", "solo"]))
    files = [
        ("p", "package.json", json.dumps({"workspaces": {"packages": ["packages/*", "!packages/not", "./tools/"]}})), ("p", "pnpm-workspace.yaml", "packages:\n  # ours\n  - 'solo'\nother:\n  - none\n"),
        ("p", "packages/store/package.json", '{"name": "@co/store"}'), ("p", "packages/store/src/index.ts", ""), ("p", "packages/api/package.json", '{"name": "@co/api"}'), ("p", "packages/api/src/mocks.ts", ""),
        ("p", "packages/.h/package.json", '{"name": "@co/hidden"}'), ("p", "tools/package.json", '{"name": "tools"}'), ("p", "solo/package.json", '{"name": "solo"}'), ("p", "packages/broken/package.json", "{"),
        ("p", "tsconfig.json", settings), ("p", "lib/ui/button.tsx", ""), ("p", "src/app/main.ts", ""), ("p", "src/use.ts", uses), ("p", "src/side.js", ""), ("p", "src/folder/deep/file.js", ""),
        ("q", "src/use.ts", "import a from '@co/store'; import b from '~/main'"),
    ]
    table = tree(spark, files)
    assert {(r.package, r.dir) for r in workspaces.workspace_packages(table).collect()} == {("@co/store", "packages/store"), ("@co/api", "packages/api"), ("tools", "tools"), ("solo", "solo")}
    assert {(r.alias, r.target) for r in workspaces.path_aliases(table).collect()} == {("@ui", "lib/ui"), ("~", "src/app")}
    got = {(r.project_id, r.module): (r.is_internal, r.resolved) for r in analysis.import_references(table).collect()}
    yes, lost, outer = (True, True), (True, False), (False, True)
    assert got == {
        ("p", "@co/store"): yes, ("p", "@co/api/mocks"): yes, ("p", "@co/api/none"): lost, ("p", "@co/hidden"): outer, ("p", "@ui/button"): yes, ("p", "@ui/missing"): lost, ("p", "~/main"): yes, ("p", "up/y"): outer,
        ("p", "react"): outer, ("p", "./side"): yes, ("p", "./folder"): yes, ("p", "./gone"): lost, ("p", "solo"): lost, ("q", "@co/store"): outer, ("q", "~/main"): outer,
    }


def test_fingerprints(spark):
    files = tree(spark, [("a", "contracts/Voting.sol", ""), ("a", "README.md", ""), ("a", "node_modules/x.js", ""), ("b", "contracts/AuctionHouse.sol", ""), ("b", "yarn.lock", ""), ("b", "README.md", "")])
    items = trees.fingerprint(files)
    assert {r.item for r in items.collect()} == {"contracts/<NAME>.sol", "README.md"}
    assert metrics.homogeneity(items.withColumn("cohort", F.lit("c"))).first().thi == 1.0
