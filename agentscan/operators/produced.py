"""Findings that other operators' results produce: their check ids, in one table of units and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.held import marks
from agentscan.functions.rules import MARKS, any_match, possible, quoted, rows_of, told
from agentscan.functions.work import kept
from agentscan.operators import configs, evidence, governance, hidden, profiles, prompts, secrets, structure, subjects
from agentscan.sources.derived import SQL_ARTIFACTS, artifacts

#: Words of a prompt's order of trust, of its resistance, and of conditions that void a rule.
TRUST, RESISTS, CONDITION = r"(?i)\btrust|authority", r"(?i)never (?:comply|follow|ignore)|must not follow|reject[^.]{0,40}override", r"(?i)unless (?:instructed|told|the user|asked)|when appropriate"
#: Files of configuration and of instructions.
CONFIG_FILE, INSTRUCTIONS = r"\.(?:env|json|ya?ml)$", r"(?:CLAUDE|SOUL|SKILL|system-prompt)\.md$"
URL_PASSWORD = r"(?i)\b[a-z]+://[^\s/:@'\"]+:[^\s/@'\"]+@"


def _as(df: DataFrame, unit, check: str, severity: str | Column, where: Column | None = None) -> DataFrame:
    df = df.where(where) if where is not None else df
    s = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(unit.cast("string").alias("unit"), F.lit(check).alias("check_id"), s.alias("severity"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_files(spark, sf_dir):
    """Findings of single files and lines: credentials, surfaces, prompts, scopes and hidden text."""
    c = F.col
    surfaces, scores = evidence.risk_surfaces(spark, sf_dir, True), F.when(c("confidence") >= 0.8, "critical").otherwise("high")
    sent = evidence.clauses(spark, sf_dir, [evidence.SEND, evidence.URL, evidence.NOUN]).where(c("clause").rlike(evidence.SEND) & c("clause").rlike(evidence.URL) & c("clause").rlike(evidence.NOUN))
    keys, texts = kept(secrets.secrets(spark, sf_dir), "secrets"), artifacts(spark, sf_dir)
    inferred, front = profiles.inferred_capabilities(spark, sf_dir, True), evidence.q_front(spark, sf_dir, True)
    patterns = [*structure.HIERARCHY, CONDITION, RESISTS, TRUST]
    *order, void, resists, trust = told("content", patterns)
    low = sum((hit.cast("int") for hit in order), F.lit(0)) / float(len(order)) < 0.4
    lacks = (("AST-PROMPT-001", "high", low), ("AST-PROMPT-002", "medium", void), ("AST-PROMPT-003", "high", ~resists), ("AST-PROMPT-004", "medium", ~trust))
    prompt = texts.where(c("path").rlike(INSTRUCTIONS)).withColumn(MARKS, marks(texts, "content", patterns))
    prompt = rows_of(prompt, ["path"], F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"))) for i, s, hit in lacks])), "check_id")
    targets = structure.q_targets(spark, sf_dir).select(F.split("path", "/")[0].cast("long").alias("id"))
    acts = inferred.where(c("capability").isin("shell:execute", "network:outbound")).select("id").distinct()
    return _united(
        [
            _as(evidence.q_harvest(spark, sf_dir), c("id"), "AST-CRED-001", "high"),
            _as(sent, c("id"), "AST-CRED-002", "critical"),
            _as(keys, c("path"), "AST-CRED-003", "critical"),
            _as(surfaces, c("path"), "AST-EXFIL-001", scores, (c("attack_class") == "DATA-EXFIL") & (c("confidence") >= 0.5)),
            _as(surfaces, c("path"), "AST-HEARTBEAT-001", scores, c("attack_class") == "REMOTE-INSTRUCT"),
            _as(surfaces, c("path"), "AST-INJECT-001", scores, c("attack_class").isin("SKILL-INJECT", "PROMPT-INJECT")),
            _as(evidence.q_evasion(spark, sf_dir), c("path"), "AST-MANIP-001", "high", c("evasive")),
            _as(subjects.q_data_access(spark, sf_dir, inferred), c("id"), "AST-PERSIST-001", "high", c("transmits") & ~c("covered")),
            prompt.select(c("path").alias("unit"), "check_id", "severity"),
            _as(front, c("id"), "AST-SCOPE-001", "high", F.coalesce(c("permissions").rlike(r"\*"), F.lit(False))),
            _as(inferred.select("id").distinct().join(front.where("capabilities is null and permissions is null and name is not null"), "id"), c("id"), "AST-SCOPE-002", "medium"),
            _as(targets.join(acts, "id"), c("id"), "AST-SCOPE-003", "medium"),
            _as(structure.q_directives(spark, sf_dir), c("path"), "AST-SCOPE-004", "critical"),
            _as(possible(texts, "content", [URL_PASSWORD]), c("path"), "SEM-CRED-001", "high", any_match(c("content"), [URL_PASSWORD])),
            _as(keys, c("path"), "SEM-CRED-002", "critical", c("path").rlike(CONFIG_FILE)),
            _as(keys, c("path"), "SEM-CRED-003", "critical", c("path").rlike(INSTRUCTIONS)),
            _as(hidden.q_homoglyphs(spark, sf_dir), c("id"), "UNICODE-STEGO-005", "medium"),
        ]
    )


def _sub(sql: str, unit: str, check: str, severity: str = "", where: str = "") -> str:
    level = severity if severity.startswith("CASE") else quoted(severity)
    return f"SELECT ({unit})::VARCHAR AS unit, '{check}' AS check_id, {level} AS severity FROM ({sql})" + (f" WHERE {where}" if where else "")


_SURFACES, _KEYS, _FILES = f"WITH {evidence.SQL_SURFACES} SELECT * FROM surfaces", f"WITH {secrets.SQL_SECRETS} SELECT * FROM secrets", f"WITH {SQL_ARTIFACTS} SELECT * FROM artifacts"
_PROMPTS = f"{_FILES} WHERE regexp_matches(path, {quoted(INSTRUCTIONS)})"
_BY = "CASE WHEN confidence >= 0.8 THEN 'critical' ELSE 'high' END"
_LOW = "(" + " + ".join(f"regexp_matches(content, {quoted(p)})::INT" for p in structure.HIERARCHY) + f") / {len(structure.HIERARCHY)}.0::DOUBLE < 0.4"
_ACTS = f"WITH {profiles.SQL_INFERRED} SELECT DISTINCT id FROM inferred"
_m = lambda p, c="content": f"regexp_matches({c}, {quoted(p)})"
SQL_FILES = "\nUNION ALL ".join(
    [
        _sub(evidence.SQL_HARVEST, "id", "AST-CRED-001", "high"),
        _sub(f"WITH {evidence.SQL_CLAUSES} SELECT id FROM clauses WHERE {_m(evidence.SEND, 'clause')} AND {_m(evidence.URL, 'clause')} AND {_m(evidence.NOUN, 'clause')}", "id", "AST-CRED-002", "critical"),
        _sub(_KEYS, "path", "AST-CRED-003", "critical"),
        _sub(_SURFACES, "path", "AST-EXFIL-001", _BY, "attack_class = 'DATA-EXFIL' AND confidence >= 0.5"),
        _sub(_SURFACES, "path", "AST-HEARTBEAT-001", _BY, "attack_class = 'REMOTE-INSTRUCT'"),
        _sub(_SURFACES, "path", "AST-INJECT-001", _BY, "attack_class IN ('SKILL-INJECT', 'PROMPT-INJECT')"),
        _sub(evidence.SQL_EVASION, "path", "AST-MANIP-001", "high", "evasive"),
        _sub(subjects.SQL_DATA, "id", "AST-PERSIST-001", "high", "transmits AND NOT covered"),
        _sub(_PROMPTS, "path", "AST-PROMPT-001", "high", _LOW),
        _sub(_PROMPTS, "path", "AST-PROMPT-002", "medium", _m(CONDITION)),
        _sub(_PROMPTS, "path", "AST-PROMPT-003", "high", f"NOT {_m(RESISTS)}"),
        _sub(_PROMPTS, "path", "AST-PROMPT-004", "medium", f"NOT {_m(TRUST)}"),
        _sub(evidence.SQL_FRONT, "id", "AST-SCOPE-001", "high", "contains(permissions, '*')"),
        _sub(f"SELECT a.id FROM ({_ACTS}) a JOIN ({evidence.SQL_FRONT}) f ON f.id = a.id WHERE capabilities IS NULL AND permissions IS NULL AND name IS NOT NULL", "id", "AST-SCOPE-002", "medium"),
        _sub(f"SELECT a.id FROM ({_ACTS} WHERE capability IN ('shell:execute', 'network:outbound')) a JOIN ({structure.SQL_TARGETS}) t ON string_split(t.path, '/')[1]::BIGINT = a.id", "id", "AST-SCOPE-003", "medium"),
        _sub(structure.SQL_DIRECTIVES, "path", "AST-SCOPE-004", "critical"),
        _sub(_FILES, "path", "SEM-CRED-001", "high", _m(URL_PASSWORD)),
        _sub(_KEYS, "path", "SEM-CRED-002", "critical", _m(CONFIG_FILE, "path")),
        _sub(_KEYS, "path", "SEM-CRED-003", "critical", _m(INSTRUCTIONS, "path")),
        _sub(hidden.SQL_HOMOGLYPHS, "id", "UNICODE-STEGO-005", "medium"),
    ]
)


def q_projects(spark, sf_dir):
    """Findings of projects: capabilities against declarations and constraints, and gaps of governance."""
    c = F.col
    # found once, read by every check
    rules, inferred = kept(profiles.constraints(spark, sf_dir), "constraints"), profiles.inferred_capabilities(spark, sf_dir, True)
    gaps = profiles.q_gaps(spark, sf_dir, inferred, rules)
    weak = rules.where("enforceability <= 0.4").groupBy("project_id").agg(F.count("*").alias("n"))
    shown = inferred.select("project_id").distinct()
    bound = rules.select("project_id").distinct()
    resists = rules.where(c("sentence").rlike(r"(?i)overrid|ignore|disregard")).select("project_id").distinct()
    return _united(
        [
            _as(profiles.q_undeclared(spark, sf_dir, inferred), c("project_id"), "AST-CAP-001", "medium"),
            _as(subjects.q_unconstrained(spark, sf_dir, inferred, rules), c("project_id"), "AST-CAP-002", "high"),
            _as(gaps, c("project_id"), "AST-GOV-001", "high", c("missing") != ""),
            _as(weak, c("project_id"), "AST-GOV-002", "medium"),
            _as(shown.join(bound, "project_id", "left_anti"), c("project_id"), "AST-GOV-003", "high"),
            _as(shown.join(resists, "project_id", "left_anti"), c("project_id"), "AST-GOV-004", "high"),
            _as(gaps, c("project_id"), "AST-GOV-005", F.when(c("ratio") < 0.3, "high").otherwise("medium"), c("ratio") < 0.5),
        ]
    )


_RULES = f"WITH {profiles.SQL_CONSTRAINTS} SELECT * FROM constraints"
_SHOWN = f"WITH {profiles.SQL_INFERRED} SELECT DISTINCT project_id FROM inferred"
SQL_PROJECTS = "\nUNION ALL ".join(
    [
        _sub(profiles.SQL_UNDECLARED, "project_id", "AST-CAP-001", "medium"),
        _sub(subjects.SQL_UNCONSTRAINED, "project_id", "AST-CAP-002", "high"),
        _sub(profiles.SQL_GAPS, "project_id", "AST-GOV-001", "high", "missing <> ''"),
        _sub(f"SELECT DISTINCT project_id FROM ({_RULES}) WHERE enforceability <= 0.4", "project_id", "AST-GOV-002", "medium"),
        _sub(f"SELECT * FROM ({_SHOWN}) WHERE project_id NOT IN (SELECT project_id FROM ({_RULES}))", "project_id", "AST-GOV-003", "high"),
        _sub(f"SELECT * FROM ({_SHOWN}) WHERE project_id NOT IN (SELECT project_id FROM ({_RULES}) WHERE regexp_matches(sentence, '(?i)overrid|ignore|disregard'))", "project_id", "AST-GOV-004", "high"),
        _sub(profiles.SQL_GAPS, "project_id", "AST-GOV-005", "CASE WHEN ratio < 0.3 THEN 'high' ELSE 'medium' END", "ratio < 0.5"),
    ]
)


SQL_FAMILIES = f"""WITH e AS ({SQL_FILES} UNION ALL {SQL_PROJECTS} UNION ALL {_sub(structure.SQL_CODE, "id", "AST-CODE", "high")} UNION ALL {_sub(prompts.SQL_LIFECYCLE, "conv_id", "LIFECYCLE", "high")} UNION ALL {_sub(configs.SQL_SERVER_FINDINGS, "path", "SEM-MCP", "high", "starts_with(check_id, 'SEM-MCP')")} UNION ALL {_sub(governance.SQL_GRADES, "path", "SOUL-VIOLATION", "high", "violations <> ''")})
SELECT regexp_replace(check_id, '-[0-9]+$', '') AS family, count(*) AS findings, count(DISTINCT unit) AS units FROM e GROUP BY 1"""

QUERIES = {"produced_files": (q_files, SQL_FILES), "produced_projects": (q_projects, SQL_PROJECTS)}
