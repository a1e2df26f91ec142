"""Coverage by category of checks: which files were read, cut or left out, and what that lets a scan claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted
from agentscan.operators.profiles import _CONTENT, _KIND, typed
from agentscan.operators.scoring import CATALOGUE, SQL_CAT, catalogued, findings
from agentscan.sources.derived import artifacts
from agentscan.sources.loaders import MOST_BYTES, VENDORED

#: Categories whose checks read every text, and those that read files of one type.
EVERY_TEXT = ("access", "credentials", "crypto", "hidden-text", "injection-hardening", "logging", "network")
BY_TYPE = (
    ("agent_config", ("configuration", "isolation")),
    ("config", ("configuration", "isolation")),
    ("documentation", ("governance",)),
    ("env", ("configuration",)),
    ("heartbeat", ("governance", "supply")),
    ("instructions", ("governance", "identity", "memory")),
    ("manifest", ("supply",)),
    ("mcp_config", ("configuration", "isolation")),
    ("memory", ("memory",)),
    ("settings", ("configuration", "permissions")),
    ("skill", ("permissions", "skill")),
    ("soul", ("governance", "identity")),
    ("source", ("code", "isolation", "supply")),
    ("system_prompt", ("governance", "memory")),
    ("tool_config", ("configuration",)),
)
CATEGORIES = tuple(sorted({c[1] for c in CATALOGUE}))
READS = tuple((t, c) for t, cs in BY_TYPE for c in cs)


def ledger(files: DataFrame) -> DataFrame:
    """(project_id, category, state, files_read, files_cut, files_left, findings) of ``files`` without findings yet.

    ``files`` holds project_id, artifact_type and state: ``read``, ``cut`` (too large to be read
    whole), ``skipped`` (a vendored folder) or ``unread``. Files are counted by project, type and state
    before anything is multiplied by categories, so a project of a third of all files is a few rows.
    Every project has a row for every category. Files of unknown types count for the categories that
    read every text alone; nulls in project_id are one project; an empty table gives no rows.
    """
    n = files.groupBy("project_id", "artifact_type", "state").agg(F.count("*").alias("n"))
    by_type = F.create_map(*[x for t, cs in BY_TYPE for x in (F.lit(t), F.array(*[F.lit(c) for c in cs]))])
    reads = F.concat(F.array(*[F.lit(c) for c in EVERY_TEXT]), F.coalesce(F.element_at(by_type, F.coalesce("artifact_type", F.lit(""))), F.array().cast("array<string>")))
    counts = [F.when(F.col("state") == s, F.col("n")).otherwise(0).alias(c) for s, c in (("read", "files_read"), ("cut", "files_cut"))]
    left = F.when(F.col("state").isin("read", "cut"), 0).otherwise(F.col("n")).alias("files_left")
    rows = n.select("project_id", F.explode(reads).alias("category"), *counts, left)
    zero = F.lit(0).cast("long")
    seeds = n.select("project_id").distinct().select("project_id", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"), zero.alias("files_read"), zero.alias("files_cut"), zero.alias("files_left"))
    return rows.unionByName(seeds)


def covered(files: DataFrame, hits: DataFrame) -> DataFrame:
    """The ledger of ``files`` with the findings ``hits`` (project_id, category): one row a project and category.

    A listed file proves nothing: a category is examined if one of its files was read, or if it has a
    finding; a file that was cut makes it truncated, findings or not; else it is not examined.
    Findings without a category are left out; a project that has findings and no files has rows for
    the categories of its findings.
    """
    zero = F.lit(0).cast("long")
    found = hits.where("category is not null").groupBy("project_id", "category").agg(F.count("*").alias("findings"))
    found = found.select("project_id", "category", *[zero.alias(c) for c in ("files_read", "files_cut", "files_left")], "findings")
    g = ledger(files).withColumn("findings", zero).unionByName(found).groupBy("project_id", "category").agg(*[F.sum(c).alias(c) for c in ("files_read", "files_cut", "files_left", "findings")])
    state = F.when(F.col("files_cut") > 0, "truncated").when(F.col("files_read") + F.col("findings") > 0, "examined").otherwise("not-examined")
    return g.select("project_id", "category", state.alias("state"), "files_read", "files_cut", "files_left", "findings")


def q_coverage(spark, sf_dir):
    """What a scan of each project may claim, category by category."""
    size, path = F.octet_length("content"), F.concat(F.lit("/"), F.col("path"))
    state = F.when(path.rlike(VENDORED), "skipped").when(F.col("unread"), "unread").when(size > MOST_BYTES, "cut").otherwise("read")
    files = typed(artifacts(spark, sf_dir)).select("project_id", "artifact_type", state.alias("state"))
    return covered(files, catalogued(findings(spark, sf_dir)).select("project_id", "category"))


SQL_COVERAGE = f"""WITH {SQL_CAT}, every(category) AS (VALUES {", ".join(f"({quoted(c)})" for c in EVERY_TEXT)}), known(category) AS (VALUES {", ".join(f"({quoted(c)})" for c in CATEGORIES)}),
reads(artifact_type, category) AS (VALUES {", ".join(f"({quoted(t)}, {quoted(c)})" for t, c in READS)}),
files AS (SELECT project_id, coalesce({_KIND}, {_CONTENT}, 'text') AS artifact_type, CASE WHEN regexp_matches('/' || path, {quoted(VENDORED)}) THEN 'skipped' WHEN unread THEN 'unread' WHEN strlen(content) > {MOST_BYTES} THEN 'cut' ELSE 'read' END AS state FROM artifacts),
r AS (SELECT project_id, category, state, 0 AS finding FROM files, every UNION ALL SELECT project_id, category, state, 0 FROM files JOIN reads USING (artifact_type) UNION ALL SELECT DISTINCT project_id, category, NULL, 0 FROM files, known UNION ALL SELECT project_id, category, NULL, 1 FROM cat WHERE category IS NOT NULL),
g AS (SELECT project_id, category, count(*) FILTER (state = 'read') AS files_read, count(*) FILTER (state = 'cut') AS files_cut, count(*) FILTER (state IN ('skipped', 'unread')) AS files_left, sum(finding)::BIGINT AS findings FROM r GROUP BY ALL)
SELECT project_id, category, CASE WHEN files_cut > 0 THEN 'truncated' WHEN files_read + findings > 0 THEN 'examined' ELSE 'not-examined' END AS state, files_read, files_cut, files_left, findings FROM g"""

QUERIES = {"category_coverage": (q_coverage, SQL_COVERAGE)}
