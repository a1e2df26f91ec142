"""Writers of findings and training pairs; nothing unverified leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentscan.operators.secrets import redact


def publishable(findings: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Findings whose evidence was redacted; a row that couldn't be inspected stops the write."""
    r = redact(findings, evidence)
    checked = F.when(F.col("redaction_status") == "unverified", F.raise_error(F.lit("a finding's evidence was not inspected"))).otherwise(F.col("redacted"))
    return r.withColumn(evidence, checked).drop("redacted")


def write_findings(findings: DataFrame, path: str, evidence: str = "evidence") -> None:
    """Findings as Parquet by scan_date and category."""
    publishable(findings, evidence).write.mode("append").partitionBy("scan_date", "category").parquet(path)


def write_training(pairs: DataFrame, path: str) -> None:
    """Training pairs (input, label, ...) as JSON lines by label, inputs cut at 4096 characters."""
    pairs.withColumn("input", F.substring("input", 1, 4096)).write.mode("append").partitionBy("label").json(path)
