"""Checks of configurations: predicates over fields of JSON files and of the servers they declare."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted, rows_of
from agentscan.sources.derived import SQL_CONFIG_FILES, config_files


class Check(NamedTuple):
    """A check fires where all its tests, (field, kind, value), hold for a file of its path."""

    check_id: str
    severity: str
    path: str
    tests: tuple[tuple, ...]


_GATEWAY, _SETTINGS, _SERVERS, _EDITOR = r"openclaw\.json$", r"\.claude/settings\.json$", r"mcp\.json$", r"\.vscode/mcp\.json$"
_SECRET = r'"[A-Z_]*(?:KEY|TOKEN|SECRET|PASSWORD)":"[^$"]'
_ROOT = r'"(?:/|~|/root|/home)"'
#: Packages that near names imitate.
KNOWN = ("@modelcontextprotocol/server-filesystem", "@modelcontextprotocol/server-github", "mcp-server-git", "mcp-server-fetch", "mcp-server-time")
#: Checks of whole files. Versions before the one named lack the fix of the vulnerability.
FILES = (
    Check("GATEWAY-001", "critical", _GATEWAY, (("$.gateway.host", "is", "0.0.0.0"),)),
    Check("GATEWAY-002", "critical", _GATEWAY, (("$.gateway", "has", None), ("$.security.websocketOrigins", "lacks", None))),
    Check("GATEWAY-003", "critical", _GATEWAY, (("$.gateway.auth.token", "not like", r"^\$\{"),)),
    Check("GATEWAY-004", "critical", _GATEWAY, (("$.exec.approvals", "is", "false"),)),
    Check("GATEWAY-005", "critical", _GATEWAY, (("$.sandbox.enabled", "is", "false"),)),
    Check("GATEWAY-006", "critical", _GATEWAY, (("$.docker", "like", r'"privileged":true|docker\.sock|/etc/passwd'),)),
    Check("GATEWAY-007", "critical", _GATEWAY, (("$.dm.policy", "is", "open"), ("$.dm.allowFrom", "like", r'"\*"'))),
    Check("GATEWAY-008", "high", _GATEWAY, (("$.tailscale.funnel", "is", "true"),)),
    Check("CONFIG-006", "high", _GATEWAY, (("$.moltbook.autoFollow", "is", "true"),)),
    Check("CONFIG-007", "critical", _GATEWAY, (("$.tools.elevated.defaultLevel", "is", "full"),)),
    Check("CONFIG-008", "high", _GATEWAY, (("$.sandbox.enabled", "is", "false"),)),
    Check("CONFIG-009", "high", _GATEWAY, (("$.gateway.auth.token", "not like", r"^\$\{"), ("$.gateway.auth.token", "shorter", 24))),
    Check("CVE-001", "critical", _GATEWAY, (("$.version", "older", (2026, 1, 29)),)),
    Check("CVE-002", "medium", _GATEWAY, (("$.gateway.auth", "has", None), ("$.gateway.controlUi.allowedOrigins", "lacks", None))),
    Check("CVE-003", "high", _GATEWAY, (("$.version", "older", (2026, 1, 29)),)),
    Check("CVE-004", "critical", _GATEWAY, (("$.version", "older", (2026, 1, 29)), ("$.docker", "has", None))),
    Check("CLAUDE-002", "high", _SETTINGS, (("$.permissions.allow", "like", r'"(?:\*|(?:Bash|Read|Write)(?:\(\*\))?)"'),)),
    Check("CLAUDE-003", "high", _SETTINGS, (("$.permissions.allow", "like", r"rm -rf|sudo |chmod 777"),)),
    Check("CLAUDE-004", "medium", _SETTINGS, (("$.permissions.allow", "has", None), ("$.permissions.deny", "lacks", None))),
    Check("SEM-PERM-001", "critical", _SETTINGS, (("$.permissions.allow", "like", r'"\*"'),)),
    Check("SEM-PERM-002", "high", _SETTINGS, (("$.permissions.allow", "like", r'"Bash(?:\(\*\))?"'),)),
    Check("SEM-PERM-003", "high", _SETTINGS, (("$.permissions.allow", "like", r'"Write\((?:/|~)'),)),
)
#: Checks of single servers.
SERVERS = (
    Check("MCP-001", "critical", _SERVERS, (("$.args", "like", _ROOT),)),
    Check("MCP-002", "critical", _SERVERS, (("$.command", "like", r"^(?:ba|z)?sh$"), ("$.allowedCommands", "lacks", None))),
    Check("MCP-003", "critical", _SERVERS, (("$.env", "like", _SECRET),)),
    Check("MCP-004", "high", _SERVERS, (("$.env", "like", r'(?i):"(?:admin|password|changeme|default)"'),)),
    Check("MCP-005", "high", _SERVERS, (("$.allowedTools", "like", r'"\*"'),)),
    Check("MCP-006", "low", _SERVERS, (("$.timeout", "lacks", None),)),
    Check("MCP-007", "low", _SERVERS, (("$.retries", "lacks", None),)),
    Check("MCP-008", "medium", _SERVERS, (("$.url", "like", r"://0\.0\.0\.0"),)),
    Check("MCP-009", "medium", _SERVERS, (("$.tools", "like", r'"(?:execute|shell|delete|send)"'),)),
    Check("MCP-010", "low", _SERVERS, (("$.logging", "lacks", None),)),
    Check("NET-002", "high", _SERVERS, (("$.url", "like", r"^http://"), ("$.url", "not like", r"^http://(?:localhost|127\.)"))),
    Check("SEM-MCP-001", "high", _SERVERS, (("$.args", "like", _ROOT),)),
    Check("SEM-MCP-002", "critical", _SERVERS, (("$.args", "like", r"--(?:no-sandbox|disable-sandbox|privileged|dangerously)"),)),
    Check("SEM-MCP-003", "critical", _SERVERS, (("$.args", "like", r"(?i)--(?:api-?key|token|password)="),)),
    Check("SEM-MCP-004", "high", _SERVERS, (("$.permissions", "like", r'^\["\*"\]$'),)),
    Check("SEM-MCP-007", "high", _SERVERS, (("$.args", "near", KNOWN),)),
    Check("SEM-MCP-008", "critical", _SERVERS, (("$.args", "like", r"curl[^\"]*\|\s*(?:ba)?sh"),)),
    Check("SEM-CRED-004", "critical", _SERVERS, (("$.env", "like", _SECRET),)),
    Check("VSCODE-001", "critical", _EDITOR, (("$.env", "like", _SECRET),)),
    Check("VSCODE-002", "critical", _EDITOR, (("$.args", "like", _ROOT),)),
)
_VERSION = r"^\d{1,8}(?:\.\d{1,8})*$"


def _test(json: Column, field: str, kind: str, value) -> Column:
    v = F.get_json_object(json, field)
    if kind == "is":
        return v == value
    if kind == "has":
        return v.isNotNull()
    if kind == "lacks":
        return v.isNull()
    if kind == "like":
        return v.rlike(value)
    if kind == "not like":
        return ~v.rlike(value)
    if kind == "shorter":
        return F.length(v) < value
    if kind == "older":
        return v.rlike(_VERSION) & (F.split(v, "\\.").cast("array<int>") < F.array(*[F.lit(x) for x in value]))
    near = F.array(*[F.lit(k) for k in value])
    return F.exists(F.from_json(v, "array<string>"), lambda a: F.exists(near, lambda k: F.levenshtein(a, k, 2).between(1, 2)))


def failed(json: Column, path: Column, checks: tuple[Check, ...]) -> Column:
    """Array of (check_id, severity) of the checks that a JSON text fails; broken JSON fails none."""
    out = []
    for c in checks:
        hit = path.rlike(c.path)
        for t in c.tests:
            hit = hit & F.coalesce(_test(json, *t), F.lit(False))
        out.append(F.when(hit, F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"))))
    return F.when(F.get_json_object(json, "$").isNotNull(), F.array_compact(F.array(*out)))


def _sql_test(json: str, field: str, kind: str, value) -> str:
    v = f"json_extract_string({json}, {quoted(field)})"
    return {
        "is": lambda: f"{v} = {quoted(str(value))}",
        "has": lambda: f"{v} IS NOT NULL",
        "lacks": lambda: f"{v} IS NULL",
        "like": lambda: f"regexp_matches({v}, {quoted(value)})",
        "not like": lambda: f"NOT regexp_matches({v}, {quoted(value)})",
        "shorter": lambda: f"length({v}) < {value}",
        "older": lambda: f"CASE WHEN regexp_matches({v}, {quoted(_VERSION)}) THEN string_split({v}, '.')::INT[] < {list(value)} END",
        "near": lambda: f"len(list_filter(from_json(json_extract({json}, {quoted(field)}), '[\"VARCHAR\"]'), lambda a: {' OR '.join(f'levenshtein(a, {quoted(k)}) BETWEEN 1 AND 2' for k in value)})) > 0",
    }[kind]()


def _sql_failed(source: str, json: str, keep: str, checks: tuple[Check, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, {quoted(c.check_id)} AS check_id, {quoted(c.severity)} AS severity FROM {source} WHERE regexp_matches(path, {quoted(c.path)}) AND " + " AND ".join(_sql_test(json, *t) for t in c.tests) for c in checks)


def config_findings(files: DataFrame) -> DataFrame:
    """Checks that configuration files (project_id, path, content) fail."""
    return rows_of(files, ["project_id", "path"], failed(F.col("content"), F.col("path"), FILES), "check_id")


def servers(files: DataFrame) -> DataFrame:
    """(project_id, path, server, json): a row for each server that a file declares under either key."""
    declared = F.coalesce(F.get_json_object("content", "$.mcpServers"), F.get_json_object("content", "$.servers"))
    some = files.where(F.col("path").rlike(_SERVERS))
    return some.select("project_id", "path", F.explode(F.from_json(declared, "map<string,string>")).alias("server", "json"))


def server_findings(files: DataFrame) -> DataFrame:
    """Checks that servers fail."""
    return rows_of(servers(files), ["project_id", "path", "server"], failed(F.col("json"), F.col("path"), SERVERS), "check_id")


def q_configs(spark, sf_dir):
    return config_findings(config_files(spark, sf_dir))


def q_servers(spark, sf_dir):
    return server_findings(config_files(spark, sf_dir))


_VALID = f"{SQL_CONFIG_FILES}, sound AS (SELECT * FROM config_files WHERE json_valid(content))"
SQL_CONFIGS = f"WITH {_VALID} {_sql_failed('sound', 'content', 'project_id, path', FILES)}"
SQL_SERVERS = f"""{_VALID}, m AS (SELECT project_id, path, coalesce(json_extract(content, '$.mcpServers'), json_extract(content, '$.servers')) AS m FROM sound WHERE regexp_matches(path, {quoted(_SERVERS)})), k AS (SELECT project_id, path, m, unnest(json_keys(m)) AS server FROM m WHERE m IS NOT NULL),
server_rows AS (SELECT project_id, path, server, json_extract(m, '$."' || server || '"') AS json FROM k)"""
SQL_SERVER_FINDINGS = f"WITH {SQL_SERVERS} {_sql_failed('server_rows', 'json', 'project_id, path, server', SERVERS)}"


def q_chains(spark, sf_dir):
    """Attack chains of a project's servers (read, execute, send) and projects with more than five servers."""
    s = servers(config_files(spark, sf_dir)).withColumn("tools", F.get_json_object("json", "$.tools"))
    has = {n: F.max(F.coalesce(F.contains("tools", F.lit(f'"{n}"')), F.lit(False))).alias(n) for n in ("read", "execute", "send")}
    g = s.groupBy("project_id").agg(F.count("*").alias("n_servers"), *has.values())
    found = F.array_compact(
        F.array(
            F.when(F.col("read") & F.col("send"), F.struct(F.lit("SEM-MCP-005").alias("check_id"), F.when(F.col("execute"), "critical").otherwise("high").alias("severity"))),
            F.when(F.col("n_servers") > 5, F.struct(F.lit("SEM-MCP-006").alias("check_id"), F.lit("medium").alias("severity"))),
        )
    )
    return g.select("project_id", "n_servers", F.inline(found))


SQL_CHAINS = f"""WITH {SQL_SERVERS}, g AS (SELECT project_id, count(*) AS n_servers, {", ".join(f"bool_or(coalesce(contains(json_extract_string(json, '$.tools'), '" + '"' + n + '"' + f"'), false)) AS {a}" for n, a in (("read", "r"), ("execute", "e"), ("send", "s")))} FROM server_rows GROUP BY project_id)
SELECT project_id, n_servers, 'SEM-MCP-005' AS check_id, CASE WHEN e THEN 'critical' ELSE 'high' END AS severity FROM g WHERE r AND s UNION ALL SELECT project_id, n_servers, 'SEM-MCP-006', 'medium' FROM g WHERE n_servers > 5"""

QUERIES = {"config_findings": (q_configs, SQL_CONFIGS), "server_findings": (q_servers, SQL_SERVER_FINDINGS), "server_chains": (q_chains, SQL_CHAINS)}
