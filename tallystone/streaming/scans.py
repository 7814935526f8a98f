"""The rule scan over a stream of files: stateless, so that the batch projection applies as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sast


def scan_stream(files: DataFrame, rules: list[sast.Rule], **columns) -> DataFrame:
    """Findings of a streaming table of files, in append mode."""
    return sast.scan(files, rules, **columns)


def finding_rates(findings: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by rule and time window, with a watermark that lets late files in."""
    return findings.withWatermark(time, late).groupBy(F.window(time, window), "rule_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "rule_id", "n")
