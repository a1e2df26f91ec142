"""The findings of all detectors as one table, written once and read by every score.

Each detector gives (unit, check_id, severity), a unit being a file by path or id, a project, a
conversation or a response. One join with the files' places, which holds no text, gives files their
projects. The table is Parquet, partitioned by the day of the scan and by category and ordered by project;
files of one category are dealt by path, so that neither a common check nor a large project is one task.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted
from agentscan.functions.work import exists, stamp, work_dir
from agentscan.operators import configs, evidence, governance, hidden, produced, profiles, prompts, scoring, secrets, static, structure, subjects, text
from agentscan.sources.derived import SQL_ARTIFACTS, artifacts, marked_artifacts

#: Tables that detectors read, and files that one category is dealt to at most.
INPUTS, DEAL = ("documents", "conversations", "pages"), 64
#: Where written tables are, by session, inputs and their state.
_WRITTEN: dict[tuple, str] = {}
#: Severities of checks whose detector gives none.
HIDDEN = {"UNICODE-STEGO-004": "critical", "UNICODE-STEGO-001": "high"}
INSTRUCTIONS = {"SEM-INST-003": "medium", "SEM-INST-004": "low"}
VIOLATION = "SOUL-VIOLATION"
#: Detectors whose check ids come out of other operators' results.
PRODUCED = ("produced-files", "produced-projects", "code", "lifecycle", "violations")
#: What detectors ask of a file's text, told in one pass before any of them reads it: patterns, and literals of which one must stand there.
ASKED = (
    *(r.pattern for rules in (scoring.RULES, evidence.SURFACES, text.CAPABILITIES) for r in rules),
    *(p for c in static.ABSENCE for p in (c[2], c[3])),
    *(p for c in static.COMBINATIONS for p in c[2]),
    *(p for _, p in (*structure.CODE, *secrets.SHAPES, *governance.VIOLATIONS)),
    *(p for p, _ in (*governance.TIER_SIGNS, *profiles.HOSTILE, *profiles.BENIGN, *profiles.DECLARED)),
    *(text.PERMISSIVE, text.EXFILTRATION, text.SECURITY_TERMS, evidence.HARVEST, evidence.NOUN, evidence.SEND, evidence.URL, profiles.MODAL, structure.PURPOSE),
    *(*structure.HIERARCHY, produced.CONDITION, produced.RESISTS, produced.TRUST, produced.URL_PASSWORD),
    *(hidden.SIGNS, hidden.LOOK_ALIKE, (*subjects.DATA, subjects.KELVIN)),
)


def _by(levels: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col("check_id") == k, v) for k, v in levels.items()])


def _found(df: DataFrame, detector: str, unit: Column | str, severity: Column | str = "severity") -> DataFrame:
    s = F.col(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(detector).alias("detector"), (F.col(unit) if isinstance(unit, str) else unit).cast("string").alias("unit"), "check_id", s.alias("severity"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def every_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(detector, unit, project_id, path, id, check_id, severity) of all detectors, made anew.

    A finding of a whole project stands at the project's folder, with id 0. Findings of conversations
    belong to the project ``conversations``, those of responses to their host.
    """
    with marked_artifacts(spark, sf_dir, ASKED):
        return _every_finding(spark, sf_dir)


def _every_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_files = _united(
        [
            _found(scoring.scan_findings(spark, sf_dir), "rules", "path"),
            _found(static.q_files(spark, sf_dir), "files", "path"),
            _found(static.q_combinations(spark, sf_dir), "combinations", "path"),
            _found(configs.q_configs(spark, sf_dir), "configs", "path"),
            _found(configs.q_servers(spark, sf_dir), "servers", "path"),
            _found(scoring.instruction_findings(spark, sf_dir), "instructions", "path"),
            _found(text.q_instruction_files(spark, sf_dir), "instruction-files", "id", _by(INSTRUCTIONS)),
            _found(hidden.q_invisible(spark, sf_dir), "hidden", "id", _by(HIDDEN)),
            _found(structure.q_code(spark, sf_dir), "code", "id", F.lit("high")),
            _found(governance.q_grades(spark, sf_dir).where("violations <> ''").withColumn("check_id", F.lit(VIOLATION)), "violations", "path", F.lit("high")),
            _found(produced.q_files(spark, sf_dir), "produced-files", "unit"),
        ]
    )
    places = artifacts(spark, sf_dir).select("id", "project_id", F.col("path").alias("place"))
    j = of_files.withColumn("id", F.split("unit", "/")[0].cast("long")).join(places, "id", "left")
    of_files = j.select("detector", "unit", "project_id", F.when(F.contains("unit", F.lit("/")), F.col("unit")).otherwise(F.col("place")).alias("path"), "id", "check_id", "severity")

    of_projects = _united([_found(static.q_absence(spark, sf_dir), "absence", "project_id"), _found(configs.q_chains(spark, sf_dir), "chains", "project_id"), _found(produced.q_projects(spark, sf_dir), "produced-projects", "unit")])
    of_projects = of_projects.select("detector", "unit", F.col("unit").alias("project_id"), F.concat(F.coalesce("unit", F.lit("")), F.lit("/")).alias("path"), F.lit(0).cast("long").alias("id"), "check_id", "severity")

    talks = _found(prompts.q_lifecycle(spark, sf_dir), "lifecycle", "conv_id")
    talks = talks.select("detector", "unit", F.lit("conversations").alias("project_id"), F.concat(F.lit("conversations/"), "unit").alias("path"), F.col("unit").cast("long").alias("id"), "check_id", "severity")
    served = evidence.q_served(spark, sf_dir)
    served = served.select(F.lit("served").alias("detector"), F.col("page_id").cast("string").alias("unit"), F.col("host").alias("project_id"), F.concat("host", "path").alias("path"), F.col("page_id").alias("id"), "check_id", "severity")
    return _united([of_files, of_projects, talks, served])


def _sql(detector: str, sql: str, unit: str, severity: str = "severity", check: str = "check_id", where: str = "") -> str:
    return f"SELECT '{detector}' AS detector, ({unit})::VARCHAR AS unit, {check} AS check_id, {severity} AS severity FROM ({sql})" + (f" WHERE {where}" if where else "")


def _sql_by(levels: dict[str, str]) -> str:
    return "CASE check_id " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in levels.items()) + " END"


_OF_FILES = "\nUNION ALL ".join(
    [
        _sql("rules", f"WITH {scoring.SQL_SCAN} SELECT * FROM scanned", "path"),
        _sql("files", static.SQL_FILES, "path"),
        _sql("combinations", static.SQL_COMBINATIONS, "path"),
        _sql("configs", configs.SQL_CONFIGS, "path"),
        _sql("servers", configs.SQL_SERVER_FINDINGS, "path"),
        _sql("instructions", text.SQL_INSTRUCTION, "id"),
        _sql("instruction-files", text.SQL_INSTRUCTION_FILES, "id", _sql_by(INSTRUCTIONS)),
        _sql("hidden", hidden.SQL_INVISIBLE, "id", _sql_by(HIDDEN)),
        _sql("code", structure.SQL_CODE, "id", "'high'"),
        _sql("violations", governance.SQL_GRADES, "path", "'high'", quoted(VIOLATION), "violations <> ''"),
        _sql("produced-files", produced.SQL_FILES, "unit"),
    ]
)
_OF_PROJECTS = "\nUNION ALL ".join([_sql("absence", static.SQL_ABSENCE, "project_id"), _sql("chains", configs.SQL_CHAINS, "project_id"), _sql("produced-projects", produced.SQL_PROJECTS, "unit")])
#: All findings in SQL; every other SQL text of findings stands on it.
SQL_EVERY = f"""SELECT detector, unit, p.project_id, CASE WHEN contains(unit, '/') THEN unit ELSE p.path END AS path, string_split(unit, '/')[1]::BIGINT AS id, check_id, severity FROM ({_OF_FILES}) u LEFT JOIN (WITH {SQL_ARTIFACTS} SELECT id, project_id, path FROM artifacts) p ON p.id = string_split(unit, '/')[1]::BIGINT
UNION ALL SELECT detector, unit, unit AS project_id, coalesce(unit, '') || '/' AS path, 0 AS id, check_id, severity FROM ({_OF_PROJECTS})
UNION ALL SELECT 'lifecycle', conv_id::VARCHAR, 'conversations', 'conversations/' || conv_id, conv_id, check_id, severity FROM ({prompts.SQL_LIFECYCLE})
UNION ALL SELECT 'served', page_id::VARCHAR, host, host || path, page_id, check_id, severity FROM (WITH {evidence.SQL_SERVED} SELECT * FROM served)"""


def write_findings(findings: DataFrame, path: str, day: datetime.date) -> None:
    """Findings as Parquet, by the day of the scan and category; an unknown category is null's folder."""
    f = scoring.catalogued(findings).drop("family", "attack_class", "fix").withColumn("scan_date", F.lit(day))
    dealt = f.repartition("category", F.pmod(F.xxhash64("path"), F.lit(DEAL))).sortWithinPartitions("category", "project_id", "path")
    dealt.write.mode("append").partitionBy("scan_date", "category").parquet(path)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the tables in a folder: scanned and written when first asked for, read from then on.

    A session scans again when the tables have changed since, or the written findings are gone.
    """
    key = (spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in INPUTS))
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key]):
        path = work_dir(spark, "findings")
        write_findings(every_finding(spark, sf_dir), path, datetime.date.today())
        _WRITTEN[key] = path
    schema = "detector string, unit string, project_id string, path string, id long, check_id string, severity string, scan_date date, category string"
    return spark.read.schema(schema).parquet(_WRITTEN[key])


def q_store(spark, sf_dir):
    """Findings by detector and category: how many, of how many checks and units."""
    return findings(spark, sf_dir).groupBy("detector", "category").agg(F.count("*").alias("n"), F.count_distinct("check_id").alias("checks"), F.count_distinct("unit").alias("units"))


SQL_STORE = f"WITH {scoring.CATALOGUE_SQL} SELECT detector, category, count(*) AS n, count(DISTINCT check_id) AS checks, count(DISTINCT unit) AS units FROM ({SQL_EVERY}) f LEFT JOIN catalogue c ON c.p = regexp_extract(f.check_id, '{scoring.PREFIX}', 1) GROUP BY ALL"


def q_families(spark, sf_dir):
    """Findings of all produced families by family: how many, and of how many units. Read from the written findings."""
    f = findings(spark, sf_dir)
    f = f.where(F.col("detector").isin(*PRODUCED) | (F.col("detector") == "servers") & F.startswith("check_id", F.lit("SEM-MCP")))
    return f.groupBy(F.regexp_replace("check_id", "-[0-9]+$", "").alias("family")).agg(F.count("*").alias("findings"), F.count_distinct("unit").alias("units"))


QUERIES = {"findings_store": (q_store, SQL_STORE), "produced_families": (q_families, produced.SQL_FAMILIES)}
