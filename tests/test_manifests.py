"""Manifests and configuration files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallystone.sources import manifests, tree

FILES = {
    "setup.py": "setup(install_requires=['a>=1', \"b\"], extras_require={'dev': ['c==2']})",
    "setup.cfg": "[metadata]\nname = x\n[options]\ninstall_requires =\n    d>=1\n    # no\n    e\npackages = find:\n[options.extras_require]\ntest =\n    f\n",
    "pyproject.toml": "[project]\nname = 'x'\ndependencies = [\n  'g>=1',\n  \"h\",\n]\n[tool.poetry.dependencies]\npython = '^3'\ni = '^1.2'\n",
    "Cargo.toml": "[package]\nname = 'x'\n[dependencies]\nj = \"1.0\"\n[dev-dependencies]\nk = { version = \"2.0\" }\n",
    "go.mod": "module m\nrequire example.com/l v1.2.3\nrequire (\n\texample.com/m v0.1.0 // indirect\n)\nreplace (\n\texample.com/n v1 => ../n\n)\n",
    "requirements.txt": "o==1\n", "package.json": '{"dependencies": {"p": "1"}}',
    "c.yaml": "server:\n  port: 1\n  env:\n    KEY: v\n    N: 2\nservices:\n  w:\n    environment:\n      - A=b\n      - C\n", "bad.yml": "a: [", "d.json": '{"x": {"y": [1]}}', "e.ini": "top = 0\n[s]\n; no\nk = 'v'\n", ".env": "Q=1\n",
}


def frame(spark):
    rows = [("p", n, [], n, "" if n == ".env" else os.path.splitext(n)[1], len(t), t) for n, t in FILES.items()]
    return spark.createDataFrame(rows, tree.SCHEMA)


def test_dependencies(spark):
    got = {(r.name, r.version, r.ecosystem, r.is_dev) for r in manifests.dependencies(frame(spark)).collect()}
    assert got == {
        ("a", "1", "pypi", False), ("b", "", "pypi", False), ("c", "2", "pypi", False), ("d", "1", "pypi", False), ("e", "", "pypi", False), ("f", "", "pypi", True), ("g", "1", "pypi", False), ("h", "", "pypi", False), ("i", "1.2", "pypi", False),
        ("j", "1.0", "cargo", False), ("k", "2.0", "cargo", True), ("example.com/l", "v1.2.3", "go", False), ("example.com/m", "v0.1.0", "go", False), ("o", "1", "pypi", False), ("p", "1", "npm", False),
    }


def test_definitions(spark):
    got = {(r.key, r.value) for r in manifests.config_definitions(frame(spark)).where(F.col("file").isin("c.yaml", "bad.yml", "d.json", "e.ini", ".env")).collect()}
    assert got == {("server.port", "1"), ("server.env.KEY", "v"), ("KEY", "v"), ("server.env.N", "2"), ("N", "2"), ("A", "b"), ("C", ""), ("x.y", "[1]"), ("top", "0"), ("s.k", "v"), ("Q", "1")}
