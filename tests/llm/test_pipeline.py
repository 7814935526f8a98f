"""The pipeline's stages one after another, each against its rule."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from test_llm_operators import brute_components, brute_counts

import corpus_pipeline
from tallystone.llm import common, mixing
from tallystone.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name)).cache()
        docs = kept[name]
        assert name == "encode" or docs.columns == columns
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    counts = {i: brute_counts(t) for i, t in texts.items()}
    failed = {i for i, c in counts.items() if c[0] < 10 or 100 * c[4] > 20 * c[0]}
    first = {r.doc_id for r in kept["quality"].collect()}
    assert not first & failed and len(first) >= 0.95 * (len(texts) - len(failed))
    _, want = brute_components([(i, texts[i], "") for i in first])
    second = {r.doc_id for r in kept["near_duplicates"].collect()}
    assert second == {c for _, c in want.values()}
    third = {r.doc_id: r for r in kept["secret_scan"].collect()}
    assert set(third) == second and all(r.n_chars == len(r.text) for r in third.values())
    taken = {r.doc_id: r for r in mixing.mix(kept["secret_scan"]).collect()}
    fourth = [r.doc_id for r in kept["mixture"].collect()]
    assert all(abs(fourth.count(i) - r.taken / r.size) <= 0.5 for i, r in taken.items())
    assert sorted(r.doc_id for r in kept["encode"].collect()) == sorted(fourth)


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    plain = "\n".join(" ".join(f"v{i}x{j}" for i in range(9)) for j in range(3))
    rows = [(1, plain, "en", "s", 3), (1, plain, "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, plain + " more", None, None, None), (5, long, "en", "t", 1), (6, "secret = 'abcdef123' " + plain, "en", "t", 1), (7, plain + "\n" + "x" * 70_000, "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS key", "2 AS gone", "'x' AS own", "3 AS times", "4 AS spans", "5 AS fixed", "6 AS k", "7 AS h")
    kept = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    assert sorted(str(r.doc_id) for r in kept["quality"]) == ["1", "1", "5", "6", "7", "None"]
    ids = Counter(str(r.doc_id) for r in kept["near_duplicates"])
    assert ids["1"] == 1 and ids["2"] == ids["3"] == ids["5"] == 1
    assert len(kept["secret_scan"]) == len(rows) and {r.doc_id: r.text for r in kept["secret_scan"]}[6].startswith("<|secret|>")
    assert {r.doc_id for r in kept["mixture"]} <= {1, None, 5, 6, 7} and kept["mixture"][0].asDict().keys() == set(docs.columns)
    assert Counter(r.doc_id for r in kept["encode"]) == Counter(r[0] for r in rows)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "encode" or set(out.columns) == set(docs.columns))


def test_the_run_leaves_only_results_behind(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    since = len(common.MADE)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert [p.rsplit("/", 1)[-1].split("-")[0] for p in common.MADE[since:] if p.rsplit("/", 1)[-1].split("-")[0] in dict(corpus_pipeline.STAGES)] == ["mixture"]
