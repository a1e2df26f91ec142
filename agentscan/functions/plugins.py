"""Detectors and rules from outside, and a table function for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from agentscan.functions.rules import Rule, scan

#: What a detector returns, at least.
FINDING = ("path", "check_id", "severity")
SEVERITIES = ("critical", "high", "medium", "low", "info")


class Detectors:
    """Named detectors, each a function from artifacts to findings; their results are united."""

    def __init__(self):
        self.named: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.named:
            raise ValueError(f"detector {name} is there already")
        self.named[name] = detector

    def run(self, artifacts: DataFrame) -> DataFrame:
        out = None
        for name, detector in self.named.items():
            f = detector(artifacts)
            if missing := set(FINDING) - set(f.columns):
                raise ValueError(f"detector {name} returns no {', '.join(sorted(missing))}")
            f = f.select(*FINDING)
            out = f if out is None else out.unionByName(f)
        if out is None:
            raise ValueError("no detector")
        return out


def rules_from(rows: list[dict]) -> tuple[list[Rule], list[tuple[dict, str]]]:
    """User rules as data: the valid ones, and the rejected ones with the reason."""
    good, bad = [], []
    for r in rows:
        try:
            re.compile(r["pattern"])
            if r["severity"] not in SEVERITIES:
                raise ValueError("unknown severity")
            good.append(Rule(r["check_id"], r["severity"], r["pattern"], r.get("name", ""), r.get("exclude")))
        except (KeyError, re.error, ValueError) as e:
            bad.append((r, f"{type(e).__name__}: {e}"))
    return good, bad


def rule_detector(rules: list[Rule]) -> Callable[[DataFrame], DataFrame]:
    return lambda artifacts: scan(artifacts, "content", rules, ["path"])


@udtf(returnType="line_no int, check_id string, col int, matched string")
class ExplodeFindings:
    """Payload findings of one text, for use in SQL: SELECT * FROM t, LATERAL explode_findings(t.content)."""

    def eval(self, text: str):
        from agentscan.operators.text import unframed

        for n, line in enumerate((text or "").split("\n"), 1):
            for check, at, matched in unframed(line.removesuffix("\r")):
                yield n, check, at + 1, matched[:160]


def register(spark: SparkSession) -> None:
    spark.udtf.register("explode_findings", ExplodeFindings)
