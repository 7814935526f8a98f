"""Judge post-processing, illusion depth and endpoints against hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallystone.operators import deployment, facts, judge


def answers(spark, texts):
    return {r.i: r for r in judge.parse_answers(spark.createDataFrame(list(enumerate(texts)), "i int, raw string")).collect()}


def test_answers(spark):
    got = answers(spark, [
        'Sure:\n```json\n{"score": 4.5, "confidence": "high", "evidence": ["a", 2], "reasoning": "r"}\n```', '```\n{"score": "2"}\n```', 'x {"score": 9, "evidence": "one"} and {"score": 1}',
        '{"score": 3.5, "confidence": "sure", "reasoning": 7}', "no json", None, '{"score": "many"}', '{"score": -2, "confidence": "medium"}', "[1]", '{"score": NaN}',
    ])
    assert [got[i].score for i in range(10)] == [4, 2, 5, 4, 3, 3, 3, 1, 3, 3]
    assert [got[i].confidence for i in (0, 1, 3, 4, 7)] == ["high", "low", "low", "low", "medium"]
    assert got[0].evidence == ["a", "2"] and got[2].evidence == ["one"] and got[4].evidence == [] and got[3].reasoning == "7"
    assert [got[i].parsed for i in range(10)] == [True, True, True, True, False, False, False, True, False, False]


def test_scales(spark):
    def scores(rows):
        return spark.createDataFrame(rows, "metric string, score double")

    bands = judge.native_scores(scores([("deployment_risk", 4.0), ("deployment_risk", 3.0), ("ownership_void", 3.67)]))
    assert {r.metric: r.score for r in bands.collect()} == {"deployment_risk": 0.7, "ownership_void": 70.0}
    same = judge.native_scores(scores([("ownership_void", 90.0), ("ownership_void", 3.0)]))
    assert same.first().score == 46.5
    with pytest.raises(judge.AmbiguousScaleError):
        judge.native_scores(scores([("ownership_void", 3.0), ("unheard", 99.0)]))
    with pytest.raises(judge.ConflictingScaleError):
        judge.native_scores(scores([("deployment_risk", 3.0), ("ownership_void", 90.0)]))
    with pytest.raises(KeyError):
        judge.native_scores(scores([("unheard", 3.0)]), judge.ORDINAL)
    with pytest.raises(ValueError):
        judge.native_scores(scores([("ownership_void", 3.0)]), "other")
    assert {r.score for r in judge.native_scores(scores([("defect_density", 2.5), ("specification_alignment", 0.2)]), judge.ORDINAL).collect()} == {3.5, 0.1}


def tree(spark, files):
    df = spark.createDataFrame([(p, f, t) for p, f, t in files], "project_id string, path string, content string")
    parts = F.split("path", "/")
    return df.withColumns({"name": F.element_at(parts, -1), "dirs": F.slice(parts, F.lit(1), F.size(parts) - 1), "ext": F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))})


def test_illusion_depth(spark):
    files = tree(spark, [
        ("bad", "a.py", "def f(:\n"), ("bad", "b.py", "x = 1\n"), ("late", "a.py", "return 1\n"), ("build", "a.py", ""), ("build", "Dockerfile", "RUN x\n"), ("deploy", "docker-compose.yml", "- a\n"),
        ("deploy", "Dockerfile", "# x\n from python\n"), ("fine", "compose.prod.yml", "services: {}\n"), ("fine", "sub/Dockerfile", "RUN x"), ("lint", "a.py", "x=1\n"), ("broken", "compose.yml", "a: [\n"),
    ])
    told = spark.createDataFrame([("lint", 3, False), ("lint", 5, False), ("fine", 4, True)], "project_id string, stage int, passed boolean")
    got = {r.project_id: (r.stage, r.stage_name) for r in deployment.illusion_depth(files, told).collect()}
    assert got == {"bad": (0, "UNPARSEABLE"), "late": (1, "PARSEABLE"), "build": (7, "SAST"), "deploy": (8, "BUILD"), "broken": (8, "BUILD"), "fine": (10, "HEALTHY"), "lint": (2, "COMPILE")}
    assert {r.project_id: r.stage for r in deployment.illusion_depth(files).collect()}["lint"] == 10


def test_endpoints_by_file_and_of_go(spark):
    files = tree(spark, [
        ("n", "app/api/users/[id]/route.ts", "export async function GET() {}\nexport const POST = 1"), ("n", "src/app/api/route.js", "nothing"), ("n", "app/api/[...slug]/route.ts", "export function DELETE() {}"),
        ("n", "pages/api/index.ts", ""), ("n", "src/pages/api/items/[id].ts", ""), ("n", "pages/api/items/index.js", ""), ("n", "other/app/api/x/route.ts", ""),
        ("g", "main.go", 'api := r.Group("/api/")\napi.GET("/users", h)\nr.POST(`/x`, h)\nhttp.HandleFunc("/h", f)\nr.GET("", z)'),
        ("k", "k.js", "router.get('/k', f)"),
    ])
    got = {(r.project_id, r.method, r.path) for r in facts.api_endpoints(files).collect()}
    assert got == {
        ("n", "GET", "/api/users/{id}"), ("n", "POST", "/api/users/{id}"), ("n", "*", "/api"), ("n", "DELETE", "/api/{slug}"), ("n", "*", "/api/items/{id}"), ("n", "*", "/api/items"),
        ("g", "GET", "/api/users"), ("g", "POST", "/x"), ("g", "*", "/h"), ("g", "GET", "/"), ("k", "GET", "/k"),
    }


def test_command_line(spark, tmp_path, capsys):
    from tallystone.__main__ import main

    demo = tmp_path / "demo"
    demo.mkdir()
    (demo / "a.py").write_text("import b\n\n\ndef f(x):\n    return x if x else 1\n")
    (demo / "b.py").write_text("x = 1\n")
    assert main(["list-metrics"]) == 0 and "urr:" in capsys.readouterr().out
    assert main(["ccx", str(demo), "--format", "json"]) == 0
    assert '"ccx": ' in capsys.readouterr().out
    assert main(["id", str(demo), "--format", "csv", "--out", str(tmp_path / "x")]) == 0 and "HEALTHY" in (tmp_path / "x").read_text()
