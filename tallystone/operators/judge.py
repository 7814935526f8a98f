"""Post-processing of model judgements and the sample of source that a judge reads. Calls to a model are out of scope; answers come as a table."""

from __future__ import annotations

import contextlib
import itertools
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Extensions that a judge reads, names of entry points, bytes of a sample.
EXTENSIONS = ".py .js .ts .jsx .tsx .sol .go .rs .java .rb .php .c .cpp .h .cs .swift .kt .vue".split()
ENTRY_POINTS = "main.py app.py index.js index.ts server.js server.ts app.js app.ts main.go main.rs cli.py manage.py".split()
BUDGET = 50_000

#: The native value of each ordinal band from 1 to 5, the native ceilings (None: open), and the scales' names.
BANDS = {
    "defect_density": (1.0, 3.5, 7.5, 15.0, 25.0),
    "vulnerability_density": (0.5, 2.0, 4.0, 7.5, 15.0),
    "deployment_risk": (0.1, 0.3, 0.5, 0.7, 0.9),
    "ownership_void": (10.0, 30.0, 50.0, 70.0, 90.0),
    "specification_alignment": (0.1, 0.3, 0.5, 0.7, 0.9),
}
CEILINGS = {"defect_density": None, "vulnerability_density": None, "deployment_risk": 1.0, "ownership_void": 100.0, "specification_alignment": 1.0}
CONFIDENCES = ("high", "medium", "low")
ORDINAL, NATIVE, HIGHEST_BAND = "ordinal", "native", 5.0

ANSWER = "score double, confidence string, evidence array<string>, reasoning string, parsed boolean"


class ScaleError(ValueError):
    """The scale of some scores can't be told."""


class AmbiguousScaleError(ScaleError):
    """Every score is legal on both scales."""


class ConflictingScaleError(ScaleError):
    """Some scores are legal on one scale only and some on the other only."""


def first_object(text: str) -> str | None:
    """The text from the first brace to the one that closes it."""
    start = text.find("{")
    depth = itertools.accumulate((c == "{") - (c == "}") for c in text[max(start, 0) :])
    end = next((i for i, d in enumerate(depth) if d == 0), None) if start >= 0 else None
    return None if end is None else text[start : start + end + 1]


def json_in(text: str | None) -> dict:
    """The JSON of an answer: of a block marked as JSON, of any block, of the first object in braces, or of all of it; else empty."""
    blocks = [re.search(p, text or "", re.S) for p in (r"```json\s*\n?(.*?)```", r"```\s*\n?(.*?)```")]
    for candidate in (*(m[1] for m in blocks if m), first_object(text or ""), text):
        with contextlib.suppress(ValueError, TypeError):
            found = json.loads(candidate)
            return found if isinstance(found, dict) else {}
    return {}


def result_of(text: str | None, default: float = 3.0) -> tuple:
    """Score (a whole number from 1 to 5), confidence, evidence and reasoning of an answer, and whether it held a score."""
    found = json_in(text)
    try:
        score = float(found["score"])
        score, parsed = (score, True) if math.isfinite(score) else (default, False)
    except (KeyError, TypeError, ValueError):
        score, parsed = default, False
    confidence, evidence = found.get("confidence"), found.get("evidence") or []
    evidence = evidence if isinstance(evidence, list) else [evidence]
    return float(max(1, min(5, round(score)))), confidence if confidence in CONFIDENCES else "low", [str(e) for e in evidence], str(found.get("reasoning", "")), parsed


def parse_answers(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``score, confidence, evidence, reasoning, parsed`` from a model's answers, other columns kept.

    An answer without a usable score has the default 3, scores are rounded half to even and clamped to 1..5, an
    unknown confidence is low. A null answer is an empty one. One Arrow batch at a time, no shuffle.
    """

    @F.pandas_udf(ANSWER)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([result_of(t) for t in texts], columns=["score", "confidence", "evidence", "reasoning", "parsed"])

    columns = [c for c in rows.columns if c not in ("score", "confidence", "evidence", "reasoning", "parsed")]
    return rows.withColumn("answer__", read(raw)).select(*columns, "answer__.*")


def _by_metric(metric: Column, values: dict, then) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(metric == name, then(value)).otherwise(out)
    return out


def to_native(metric: Column, score: Column, scale: Column | str) -> Column:
    """A score in its metric's native unit: as it is on the native scale, the middle of its band on the ordinal one. Unknown metrics give null there."""
    band = F.least(F.greatest(F.bround(score, 0), F.lit(1.0)), F.lit(HIGHEST_BAND)).cast("int")
    middle = _by_metric(metric, BANDS, lambda b: F.element_at(F.array(*map(F.lit, b)), band))
    return F.when((F.lit(scale) if isinstance(scale, str) else scale) == NATIVE, score).otherwise(middle)


def scale_of(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per set of scores (``by``; all together without): ``scale``, null if no score tells, and ``conflict`` if both are told.

    A score above its metric's native ceiling is a band, any other above 5 is native.
    """
    ceiling = _by_metric(F.col("metric"), CEILINGS, lambda c: F.lit(float("inf") if c is None else c))
    band, native = F.col("score") > ceiling, (F.col("score") <= ceiling) & (F.col("score") > HIGHEST_BAND)
    told = samples.groupBy(*(by or [])).agg(F.coalesce(F.bool_or(band), F.lit(False)).alias("b"), F.coalesce(F.bool_or(native), F.lit(False)).alias("n"))
    scale = F.when(F.col("b") & ~F.col("n"), ORDINAL).when(F.col("n") & ~F.col("b"), NATIVE)
    return told.select(*(by or []), scale.alias("scale"), (F.col("b") & F.col("n")).alias("conflict"))


def native_scores(samples: DataFrame, scale: str | None = None) -> DataFrame:
    """``metric, score`` in native units: the mean of a metric's scores, converted. Without a given scale it is told from all
    scores; an error if none or both are told, or if a metric has no bands."""
    if scale is None:
        told = scale_of(samples).first()
        if told["conflict"]:
            raise ConflictingScaleError("some scores exceed their native range, others the five bands")
        if told["scale"] is None:
            raise AmbiguousScaleError("every score is legal on both scales; name the scale")
        scale = told["scale"]
    if scale not in (ORDINAL, NATIVE):
        raise ValueError(f"unknown scale {scale!r}")
    means = samples.groupBy("metric").agg(F.avg("score").alias("mean"))
    if scale == ORDINAL and (unknown := means.where(~F.col("metric").isin(*BANDS)).limit(1).collect()):
        raise KeyError(f"no bands for {unknown[0]['metric']!r}")
    return means.select("metric", to_native(F.col("metric"), F.col("mean"), scale).alias("score"))


def mean_of_runs(scores: DataFrame) -> DataFrame:
    """Mean score of the runs of each metric; runs without a score are left out (answers that held none have the default)."""
    return scores.where(F.col("score").isNotNull()).groupBy("project_id", "metric").agg(F.avg("score").alias("score"), F.count("*").alias("runs"))


def sample_source(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Files for a judge: entry points first, then larger ones, up to ``budget`` bytes; the last is cut at a line end."""
    code = files.where(F.col("ext").isin(*EXTENSIONS) & F.col("content").isNotNull())
    code = code.withColumns({"bytes": F.octet_length("content").cast("long"), "entry": F.col("name").isin(*ENTRY_POINTS)})
    order = Window.partitionBy("project_id").orderBy(F.desc("entry"), F.desc("bytes"), "path").rowsBetween(Window.unboundedPreceding, -1)
    kept = code.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("before") < budget)
    room = (F.lit(budget) - F.col("before")).cast("int")
    cut = F.decode(F.substring(F.encode("content", "utf-8"), F.lit(1), room), "utf-8")
    whole = F.col("bytes") <= room
    return kept.select("project_id", "path", F.when(whole, F.col("content")).otherwise(F.regexp_replace(cut, r"\n[^\n]*\z", "")).alias("content"), (~whole).alias("truncated"))
