"""Readers of corpora, diffs, custom payloads and labelled fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that hold no artifacts, and the largest file that is read.
VENDORED = r"/(?:node_modules|\.git|dist|build|vendor|__pycache__|\.venv)/"
MOST_BYTES = 1_048_576


def load_artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(project_id, path, size, content, truncated): files under ``path``, the first folder naming the project.

    Vendored folders are skipped; files over the limit are listed with a null content, never silently left out.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = f"^.*?{'/' + path.strip('/').split('/')[-1]}/"
    rel = F.regexp_replace("path", root, "")
    small = F.col("length") <= MOST_BYTES
    return f.where(~F.col("path").rlike(VENDORED)).select(F.split(rel, "/")[0].alias("project_id"), rel.alias("path"), F.col("length").alias("size"), F.when(small, F.col("content").cast("string")).alias("content"), (~small).alias("truncated"))


def load_ledger(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(project_id, path, size, state): every file under ``path`` and what ``load_artifacts`` does with it.

    state is ``read``, ``cut`` (over the limit) or ``skipped`` (in a vendored folder, whatever its
    size). Only names and sizes are asked of the file system; no content is read. Spark's reader lists no
    file of zero bytes, so empty files have no row, here as in ``load_artifacts``.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rel = F.regexp_replace("path", f"^.*?{'/' + path.strip('/').split('/')[-1]}/", "")
    state = F.when(F.col("path").rlike(VENDORED), "skipped").when(F.col("length") > MOST_BYTES, "cut").otherwise("read")
    return f.select(F.split(rel, "/")[0].alias("project_id"), rel.alias("path"), F.col("length").alias("size"), state.alias("state"))


def load_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(commit, commit_seq, file, line_no, text): added lines of exported ``git log -p`` files, one history a file.

    A history is read commit by commit, so that neither a row nor a window holds all of it. In a
    commit each line gets the last file and hunk before it; an added line's number is its hunk's start
    plus the kept and added lines since. The oldest commit has the smallest sequence number, from the
    commits' order in the log, newest first: one number for each commit is all that is sorted.
    """
    t = spark.read.option("lineSep", "\ncommit ").text(path).select(F.input_file_name().alias("log"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^commit ", "").alias("value"))
    t = t.where(F.col("value").rlike("^[0-9a-f]{7,40}"))
    newest = Window.partitionBy("log").orderBy(F.desc("at"))
    order = t.select("log", "at").withColumn("commit_seq", F.row_number().over(newest) - 1)
    rows = t.select("log", "at", F.regexp_extract("value", "^([0-9a-f]{7,40})", 1).alias("commit"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    w = Window.partitionBy("log", "at").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda p: F.last(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)), ignorenulls=True).over(w)
    file, hunk = r"^\+\+\+ b/(.*)$", r"^@@ -\S+ \+(\d+)"
    s = rows.withColumns({"file": last(file), "start": last(hunk).cast("int"), "hunk_no": F.count(F.when(F.col("line").rlike(hunk), 1)).over(w)})
    h = Window.partitionBy("log", "at", "hunk_no").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counted = s.withColumn("before", F.coalesce(F.count(F.when(F.col("line").rlike(r"^[+ ]") & ~F.col("line").rlike(r"^\+\+\+ "), 1)).over(h), F.lit(0)))
    added = counted.where(F.col("line").rlike(r"^\+") & ~F.col("line").rlike(r"^\+\+\+ ") & F.col("start").isNotNull())
    return added.join(order, ["log", "at"]).select("commit", "commit_seq", "file", (F.col("start") + F.col("before")).alias("line_no"), F.expr("substring(line, 2)").alias("text"))


PAYLOAD = "id string, category string, severity string, payload string, successIndicators array<string>, blockedIndicators array<string>, _corrupt_record string"


def load_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Custom payload rows (JSON lines): those that are valid, and the rejected ones with the reason."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    p = raw.select("value", F.from_json("value", PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p")).select("value", "p.*")
    why = (
        F.when(F.col("_corrupt_record").isNotNull(), "not JSON")
        .when(F.coalesce(F.col("id"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.col("payload"), F.lit("")) == "", "no payload")
        .when(~F.coalesce(F.col("severity").isin("critical", "high", "medium", "low"), F.lit(False)), "unknown severity")
        .when(F.coalesce(F.size("successIndicators"), F.lit(-1)) < 1, "no success indicator")
    )
    judged = p.withColumn("reason", why)
    return judged.where("reason is null").drop("reason", "_corrupt_record", "value"), judged.where("reason is not null").select("value", "reason")


def load_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Labelled fixtures (JSON lines) without the retired ones."""
    schema = "fixture_id string, surface string, expected_label string, expected_severity string, retired boolean"
    return spark.read.schema(schema).json(path).where(~F.coalesce("retired", F.lit(False))).drop("retired")
