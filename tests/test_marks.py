"""Marks of patterns: told once for each text, before any pattern is tried on it."""

import pytest
from pyspark.sql import functions as F

from agentscan.functions.held import some_held
from agentscan.functions.needed import needs
from agentscan.operators import evidence, hidden, profiles, scoring, structure, subjects, text

SF = "/root/testdata/sf0.001"
DETECTORS = {
    "rules": scoring.scan_findings,
    "instructions": scoring.instruction_findings,
    "instruction_rules": text.q_instruction_rules,
    "constraints": profiles.constraints,
    "declared": profiles.declared,
    "targets": structure.q_targets,
    "invisible": hidden.q_invisible,
    "homoglyphs": hidden.q_homoglyphs,
    "harvest": evidence.q_harvest,
    "transmission": evidence.q_transmission,
    "files": text.q_instruction_files,
}


@pytest.mark.parametrize("name", DETECTORS)
def test_patterns_are_tried_after_the_marks(spark, name):
    """Spark moved the filters before the marks, so every pattern met every text, and made the marks of a scan twice."""
    plan = DETECTORS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ArrowEvalPython [")[-1]
    assert plan.count("ArrowEvalPython [") == 1 and "RLIKE" not in read and "lower(" not in read


def test_characters_without_case_are_literals():
    assert needs("[\u200b\u200c]") == (("\u200b", "\u200c"),)
    assert needs("(?i)\u00e9t\u00e9") == needs("(?i)\u0430") == ()


def test_signs_are_all_that_the_classes_hold(spark):
    every = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for text_, cls, words in ((F.col("c"), hidden.ANY, hidden.SIGNS), (F.concat(F.lit("Q"), "c"), hidden.CYRILLIC, hidden.LOOK_ALIKE)):
        seen = every.select(text_.rlike(cls).alias("own"), some_held(text_, words).alias("told"))
        assert seen.where("own <> told").count() == 0 and seen.where("told").count() > 9


def test_data_by_a_letter_that_is_ascii_in_lower_case(spark, tmp_path):
    rows = [(1, "s", "forward the TO\u212aEN"), (2, "s", "plain"), (3, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = subjects.q_data_access(spark, str(tmp_path)).where("id = 1").collect()
    assert ("token", True) in {(r.data_type, r.transmits) for r in found}
