"""The findings of all detectors: counted alike by the census and by each detector's own query, written once."""

import shutil
from collections import Counter

from pyspark.sql import functions as F

from agentscan.operators import scoring, store
from agentscan.plans import registry

SF = "/root/testdata/sf0.001"
DETECTORS = ("config_findings", "server_findings", "server_chains", "static_files", "static_absence", "static_combinations", "instruction_rules", "instruction_files", "invisible_chars", "code_findings", "produced_files", "produced_projects", "lifecycle_findings", "served_findings")


def test_census_counts_what_each_detector_finds(spark):
    queries = registry.queries()
    found = Counter()
    for name in DETECTORS:
        found.update({r.check_id: r["count"] for r in queries[name](spark, SF).groupBy("check_id").count().collect()})
    found.update({r.check_id: r["count"] for r in scoring.scan_findings(spark, SF).groupBy("check_id").count().collect()})
    census = {r.check_id: r.n for r in queries["catalogue_census"](spark, SF).collect()}
    assert {k: n for k, n in census.items() if n and k != store.VIOLATION} == dict(found)
    assert len(census) > 290 and census["GATEWAY-004"] > 0


def test_every_finding_is_catalogued_and_placed(spark):
    f = store.findings(spark, SF)
    assert f.where("category is null or severity is null or project_id is null or path is null").count() == 0
    assert f.select("detector").distinct().count() == 16
    assert {r.check_id for r in f.select("check_id").distinct().collect()} <= {r.check_id for r in scoring.catalogue(spark).collect()}


def test_written_once_and_pruned_by_category(spark):
    first = store.findings(spark, SF).inputFiles()
    assert store.findings(spark, SF).inputFiles() == first
    plan = store.findings(spark, SF).where(F.col("category") == "credentials")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_changed_tables_are_scanned_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "every_finding", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.lit("d").alias("detector"), F.lit("1").alias("unit"), F.lit("p").alias("project_id"), F.lit("1/a").alias("path"), F.col("doc_id").alias("id"), F.lit("NET-001").alias("check_id"), F.lit("high").alias("severity")))
    for t in store.INPUTS:
        spark.range(3).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert store.findings(spark, str(tmp_path)).count() == 3
    spark.range(2).select(F.col("id").alias("doc_id")).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    again = store.findings(spark, str(tmp_path))
    assert again.count() == 5
    shutil.rmtree(again.inputFiles()[0].removeprefix("file:").rsplit("/", 3)[0])
    assert store.findings(spark, str(tmp_path)).count() == 5


def test_no_findings(spark, tmp_path):
    none = store.findings(spark, SF).where("false")
    assert scoring.score(scoring.catalogued(none.drop("category")), ["project_id"]).count() == 0


def test_suppressions_as_a_table(spark):
    """Ten thousand rules by folder and check; the least tier covers, an expired rule doesn't, globs ignore case."""
    rules = [(2, f"p{i}/src/*", f"C-{i % 7}", i % 2 == 0, None) for i in range(10_000)]
    rules += [(1, "P5/SRC/deep/*.md", None, False, None), (1, "p6/*", None, False, "2024-05-31"), (3, None, "C-1", True, "2024-06-01"), (0, "*/x.py", "C-2", False, None)]
    found = [("p5/src/deep/a.md", "C-5"), ("p5/src/a.md", "C-5"), ("p5/src/a.md", "C-4"), ("p6/src/a", "C-6"), ("q/a", "C-1"), ("q/a", "C-3"), ("p9/src/x.py", "C-2"), ("p8/src/a", "C-1"), ("p8/src/a", "C-1")]
    f = spark.createDataFrame(found, "path string, check_id string")
    got = sorted((r.path, r.check_id, r.suppressed_by, r.counts) for r in scoring.suppressed(f, rules, F.lit("2024-06-01").cast("date")).collect())

    def expected(path, check):
        import re

        cover = [(t, i, s) for i, (t, g, c, s, x) in enumerate(rules) if (g is None or re.search(scoring.glob(g), path)) and c in (None, check) and (x is None or x >= "2024-06-01")]
        t, i, s = min(cover) if cover else (None, None, True)
        return path, check, i, s

    assert got == sorted(expected(*x) for x in found)
    later = {(r.path, r.check_id): r.suppressed_by for r in scoring.suppressed(f, rules, F.lit("2024-06-02").cast("date")).collect()}
    assert later[("q/a", "C-1")] is None
