"""Profiles of artifacts, servers and settings: types, capabilities, constraints, permissions, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentscan.functions.held import marks
from agentscan.functions.rules import MARKS, each_of, lines, possible, quoted, sql_lines, told
from agentscan.operators.text import SQL_INFERRED, inferred_capabilities
from agentscan.sources.derived import SQL_ARTIFACTS, SQL_CONFIGS, artifacts, configs

#: Artifact types by the end of the path, and by content where the path says nothing.
BY_PATH = (("SKILL.md", "skill"), ("SOUL.md", "soul"), ("CLAUDE.md", "instructions"), ("mcp.json", "mcp_config"), ("settings.json", "settings"), ("package.json", "manifest"), ("system-prompt.md", "system_prompt"), (".env", "env"), ("HEARTBEAT.md", "heartbeat"), ("AGENTS.md", "instructions"), (".cursorrules", "instructions"), ("openclaw.json", "agent_config"), (".vscode/mcp.json", "mcp_config"), ("tools.json", "tool_config"), ("memory.json", "memory"), (".sh", "source"), (".py", "source"), (".ts", "source"), (".yaml", "config"), ("README.md", "documentation"))
BY_CONTENT = ((r"(?i)\bmcpServers\b", "mcp_config"), (r"^---\nname:", "skill"), (r"(?i)\bheartbeat every\b", "heartbeat"), (r"(?i)\"permissions\"\s*:\s*\{", "settings"), (r"(?i)^# SOUL\b|\btrust hierarchy\b", "soul"), (r"(?i)you are (?:now )?an? ", "system_prompt"), (r"(?m)^\s*(?:import|const|def|function) |eval\(", "source"))
#: Flags of paths.
CONTEXT = (("is_test", r"(?:^|/)(?:test|tests|__tests__|spec|fixtures)/"), ("is_example", r"(?:^|/)(?:examples?|templates?|docs)/"), ("is_hidden", r"(?:^|/)\.[^/]+"), ("is_corpus", r"(?:^|/)(?:corpus|datasets?|payloads?)/"), ("is_manifest", r"(?:package|openclaw|manifest)\.json$|\.lock$"), ("is_installed", r"(?:^|/)(?:node_modules|site-packages|vendor)/"))


def typed(a: DataFrame) -> DataFrame:
    """Artifacts with their type, how it was found, and path flags: the longest path ending wins, then content."""
    kind = None
    for end, name in sorted(BY_PATH, key=lambda x: -len(x[0])):
        hit = F.endswith(F.col("path"), F.lit(end))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    by_path = kind
    content = None
    for p, name in BY_CONTENT:
        hit = F.col("content").rlike(p)
        content = F.when(hit, name) if content is None else content.when(hit, name)
    flags = [F.lower("path").rlike(p).alias(n) for n, p in CONTEXT]
    return a.select("*", F.coalesce(by_path, content, F.lit("text")).alias("artifact_type"), F.when(by_path.isNotNull(), "path").when(content.isNotNull(), "content").otherwise("default").alias("typed_by"), *flags)


def q_types(spark, sf_dir):
    return typed(artifacts(spark, sf_dir)).select("path", "artifact_type", "typed_by", *[n for n, _ in CONTEXT])


_KIND = "CASE " + " ".join(f"WHEN ends_with(path, {quoted(e)}) THEN {quoted(n)}" for e, n in sorted(BY_PATH, key=lambda x: -len(x[0]))) + " END"
_CONTENT = "CASE " + " ".join(f"WHEN regexp_matches(content, {quoted(p)}) THEN {quoted(n)}" for p, n in BY_CONTENT) + " END"
SQL_TYPES = f"""WITH {SQL_ARTIFACTS} SELECT path, coalesce({_KIND}, {_CONTENT}, 'text') AS artifact_type, CASE WHEN {_KIND} IS NOT NULL THEN 'path' WHEN {_CONTENT} IS NOT NULL THEN 'content' ELSE 'default' END AS typed_by, {', '.join(f'regexp_matches(lower(path), {quoted(p)}) AS {n}' for n, p in CONTEXT)} FROM artifacts"""

#: What a sentence declares.
DECLARED = ((r"(?i)\b(?:can|will|may)\s+(?:read|access)\b", "filesystem:read"), (r"(?i)\b(?:can|will|may)\s+(?:fetch|download|request)\b|^  - network:outbound|permissions:[^\n]*network", "network:outbound"), (r"(?i)\b(?:can|will|may)\s+(?:run|execute)\b|permissions:[^\n]*shell:", "shell:execute"))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, capability) that a project's texts declare."""
    patterns = [p for p, _ in DECLARED]
    a = artifacts(spark, sf_dir)
    a = a.withColumn(MARKS, marks(a, "content", patterns)).where(F.array_contains(MARKS, True))
    caps = F.array_compact(F.array(*[F.when(hit, F.lit(c)) for hit, (_, c) in zip(told("content", patterns), DECLARED, strict=True)]))
    return each_of(a, ["project_id"], caps, "capability").distinct()


SQL_DECLARED = "declared AS (" + " UNION ".join(f"SELECT project_id, {quoted(c)} AS capability FROM artifacts WHERE regexp_matches(content, {quoted(p)})" for p, c in DECLARED) + ")"


def q_undeclared(spark, sf_dir, inferred=None):
    """Capabilities that a project's texts show and none of them declares; ``inferred`` are capabilities that were found before."""
    shown = (inferred or inferred_capabilities(spark, sf_dir)).groupBy("project_id", "capability").agg(F.count("*").alias("places"), F.min("id").alias("first_id"))
    return shown.join(declared(spark, sf_dir), ["project_id", "capability"], "left_anti")


SQL_UNDECLARED = f"""WITH {SQL_INFERRED}, {SQL_DECLARED} SELECT project_id, capability, count(*) AS places, min(id) AS first_id FROM inferred i WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.project_id = i.project_id AND d.capability = i.capability) GROUP BY ALL"""

#: Domains of constraints, how strongly words bind, and the words of a constraint.
MODAL = r"(?i)\b(?:must not|shall never|must|shall|should|never|may not)\b"
DOMAINS = ((r"(?i)personal|sensitive|data", "data-handling"), (r"(?i)execute|untrusted|command", "execution"), (r"(?i)trust|escalate|authority", "trust"), (r"(?i)human|review|approval", "oversight"))
STRENGTH = ((r"(?i)\bmust not\b|\bshall never\b", 0.8), (r"(?i)\bmust\b|\bshall\b", 0.7), (r"(?i)\bnever\b", 0.5), (r"(?i)\bshould\b", 0.4))


def _when(col, table, other):
    out = None
    for p, v in table:
        out = F.when(col.rlike(p), F.lit(v)) if out is None else out.when(col.rlike(p), F.lit(v))
    return out.otherwise(other)


def _case(col, table, other):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {quoted(p)}) THEN {quoted(v) if isinstance(v, str) else v}" for p, v in table) + f" ELSE {other} END"


#: Markers of lists, quotes and headings, and ends of sentences and of cells of tables.
MARKER, SENTENCE = r"^\s*(?:[-*+>]|#{1,6}|\d+[.)])\s+", r"[.!?]+(?:\s|$)|\s*\|\s*"


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that bind, with their domain and how enforceable they are."""
    rows = lines(possible(artifacts(spark, sf_dir), "content", [MODAL]).where(F.col("content").rlike(MODAL)), "content", ["project_id", "id"])
    plain = F.regexp_replace("line", MARKER, "")
    s = each_of(rows, ["project_id", "id", "line_no"], F.split(plain, SENTENCE), "sentence").withColumn("sentence", F.trim("sentence")).where(F.col("sentence").rlike(MODAL))
    force = _when(F.col("sentence"), STRENGTH, 0.2)
    return s.select("project_id", "id", "line_no", "sentence", _when(F.col("sentence"), DOMAINS, "general").alias("domain"), force.alias("enforceability"), F.round(1 - force, 6).alias("bypass_risk"))


SQL_CONSTRAINTS = f"""{SQL_ARTIFACTS}, lines AS ({sql_lines("artifacts", "project_id, id")}), sentences AS (SELECT project_id, id, line_no, trim(unnest(regexp_split_to_array(regexp_replace(line, {quoted(MARKER)}, ''), {quoted(SENTENCE)}))) AS sentence FROM lines),
constraints AS (SELECT project_id, id, line_no, sentence, {_case("sentence", DOMAINS, "'general'")} AS domain, ({_case("sentence", STRENGTH, "0.2")})::DOUBLE AS enforceability, round(1 - ({_case("sentence", STRENGTH, "0.2")})::DOUBLE, 6) AS bypass_risk FROM sentences WHERE regexp_matches(sentence, {quoted(MODAL)}))"""


def q_gaps(spark, sf_dir, inferred=None, bound=None):
    """Domains without a constraint in a project, weak ones, and constraints for each shown capability; both may have been found before."""
    c = (bound or constraints(spark, sf_dir)).groupBy("project_id").agg(F.collect_set("domain").alias("have"), F.round(F.avg("enforceability"), 6).alias("mean_enforceability"), F.count_if(F.col("enforceability") < 0.6).alias("weak"), F.count_if(F.col("enforceability") < 0.3).alias("decorative"), F.count("*").alias("n"))
    k = (inferred or inferred_capabilities(spark, sf_dir)).groupBy("project_id").agg(F.count_distinct("capability").alias("capabilities"))
    names = F.array(*[F.lit(d) for _, d in DOMAINS])
    return k.join(c, "project_id", "left").select("project_id", F.array_join(F.array_sort(F.array_except(names, F.coalesce("have", F.array().cast("array<string>")))), ",").alias("missing"), "mean_enforceability", F.coalesce("weak", F.lit(0)).alias("weak"), F.coalesce("decorative", F.lit(0)).alias("decorative"), F.round(F.coalesce("n", F.lit(0)) / F.col("capabilities"), 6).alias("ratio"))


SQL_GAPS = f"""WITH {SQL_CONSTRAINTS}, {SQL_INFERRED.partition("lines AS")[0].replace(SQL_ARTIFACTS + ", ", "")}l2 AS ({sql_lines("artifacts", "project_id, id")}), {SQL_INFERRED.partition("), inferred")[1][3:]}{SQL_INFERRED.partition("), inferred")[2].replace("FROM lines", "FROM l2")},
c AS (SELECT project_id, list(DISTINCT domain) AS have, round(avg(enforceability), 6) AS mean_enforceability, count(*) FILTER (enforceability < 0.6) AS weak, count(*) FILTER (enforceability < 0.3) AS decorative, count(*) AS n FROM constraints GROUP BY project_id), k AS (SELECT project_id, count(DISTINCT capability) AS capabilities FROM inferred GROUP BY project_id)
SELECT project_id, array_to_string(list_sort(list_filter([{', '.join(quoted(d) for _, d in DOMAINS)}], lambda d: NOT list_contains(coalesce(have, []), d))), ',') AS missing, mean_enforceability, coalesce(weak, 0) AS weak, coalesce(decorative, 0) AS decorative, round(coalesce(n, 0) / capabilities, 6) AS ratio FROM k LEFT JOIN c USING (project_id)"""

#: Packages that near names imitate.
KNOWN = ("mcp-server-git", "mcp-server-fetch", "mcp-server-time", "server-filesystem")
_SERVER = "map<string,struct<command:string,args:array<string>,url:string,env:map<string,string>,allowedTools:array<string>,tools:array<string>>>"


def servers(c: DataFrame) -> DataFrame:
    """One row for each server of a configuration, from either key."""
    both = F.coalesce(F.from_json(F.get_json_object("config", "$.mcpServers"), _SERVER), F.from_json(F.get_json_object("config", "$.servers"), _SERVER))
    s = c.select("project_id", "id", F.explode(both).alias("server", "s"))
    return s.select("project_id", "id", "server", F.col("s.command").alias("command"), F.array_join("s.args", " ").alias("args"), F.col("s.url").alias("url"), F.coalesce(F.exists(F.map_values("s.env"), lambda v: ~v.rlike("^\\$\\{")), F.lit(False)).alias("literal_env"), F.coalesce(F.array_contains("s.allowedTools", "*"), F.lit(False)).alias("any_tool"), F.array_sort(F.coalesce("s.tools", F.array().cast("array<string>"))).alias("tools"))


def q_servers(spark, sf_dir):
    """Servers with the checks they fail."""
    s = servers(configs(spark, sf_dir))
    last = F.element_at(F.split("args", " "), -1)
    near = F.exists(F.array(*[F.lit(k) for k in KNOWN]), lambda k: F.levenshtein(last, k, 2).between(1, 2)) & s.args.isNotNull()
    checks = F.array_compact(F.array(F.when(F.coalesce(F.col("args").rlike("(?:^| )/$"), F.lit(False)), "MCP-001"), F.when(F.col("command").isin("bash", "sh"), "MCP-002"), F.when(F.col("literal_env"), "MCP-003"), F.when(F.col("any_tool"), "MCP-005"), F.when(F.startswith(F.col("url"), F.lit("http://")), "NET-002"), F.when(F.coalesce(near, F.lit(False)), "SEM-MCP-007")))
    return s.select("project_id", "id", "server", F.array_join("tools", ",").alias("tools"), F.array_join(checks, ",").alias("checks"))


_SQL_SERVERS = f"""{SQL_CONFIGS}, m AS (SELECT project_id, id, coalesce(json_extract(config, '$.mcpServers'), json_extract(config, '$.servers')) AS m FROM configs), e AS (SELECT project_id, id, m, unnest(json_keys(m)) AS server FROM m WHERE m IS NOT NULL),
v AS (SELECT project_id, id, server, json_extract(m, '$."' || server || '"') AS s FROM e), servers AS (SELECT project_id, id, server, s->>'command' AS command, array_to_string(from_json(s->'args', '["VARCHAR"]'), ' ') AS args, s->>'url' AS url,
coalesce(len(list_filter(list_transform(json_keys(s->'env'), lambda k: s->'env'->>k), lambda v: NOT regexp_matches(v, '^\\$\\{{'))) > 0, false) AS literal_env, coalesce(list_contains(from_json(s->'allowedTools', '["VARCHAR"]'), '*'), false) AS any_tool, list_sort(coalesce(from_json(s->'tools', '["VARCHAR"]'), [])) AS tools FROM v)"""
SQL_SERVER_CHECKS = f"""WITH {_SQL_SERVERS}, n AS (SELECT *, list_extract(string_split(args, ' '), -1) AS last FROM servers)
SELECT project_id, id, server, array_to_string(tools, ',') AS tools, concat_ws(',', CASE WHEN regexp_matches(args, '(?:^| )/$') THEN 'MCP-001' END, CASE WHEN command IN ('bash', 'sh') THEN 'MCP-002' END, CASE WHEN literal_env THEN 'MCP-003' END, CASE WHEN any_tool THEN 'MCP-005' END, CASE WHEN starts_with(url, 'http://') THEN 'NET-002' END, CASE WHEN {' OR '.join(f"levenshtein(last, {quoted(k)}) BETWEEN 1 AND 2" for k in KNOWN)} THEN 'SEM-MCP-007' END) AS checks FROM n"""


def q_posture(spark, sf_dir):
    """Projects by what their servers can do together: read, execute and send, or read and send."""
    s = servers(configs(spark, sf_dir))
    g = s.groupBy("project_id").agg(F.count("*").alias("n_servers"), *[F.max(F.array_contains("tools", t)).alias(t) for t in ("read", "execute", "send")])
    level = F.when(F.col("read") & F.col("execute") & F.col("send"), "high").when(F.col("read") & F.col("send"), "medium").otherwise("low")
    return g.select("project_id", "n_servers", level.alias("chain"), (F.col("n_servers") > 5).alias("many"))


SQL_POSTURE = f"""WITH {_SQL_SERVERS}, g AS (SELECT project_id, count(*) AS n_servers, bool_or(list_contains(tools, 'read')) AS r, bool_or(list_contains(tools, 'execute')) AS e, bool_or(list_contains(tools, 'send')) AS s FROM servers GROUP BY project_id)
SELECT project_id, n_servers, CASE WHEN r AND e AND s THEN 'high' WHEN r AND s THEN 'medium' ELSE 'low' END AS chain, n_servers > 5 AS many FROM g"""

#: Permissions that are safe, dangerous, or sensitive but scoped; weights and floors of their risk.
SAFE = ("messages:read", "config:read", "storage:local")
DANGEROUS = r"^shell:|^filesystem:\*$|^filesystem:/$|^filesystem:~$|^network:\*$|^mcp:\*$|^\*$|^Bash\(\*\)$|^Write\(/"
WEIGHTS = {"safe": 5, "review": 25, "dangerous": 50}


def permissions(c: DataFrame) -> DataFrame:
    """One row for each allowed permission of a settings file, with its kind."""
    p = c.select("project_id", "id", F.explode(F.from_json(F.get_json_object("settings", "$.permissions.allow"), "array<string>")).alias("permission"))
    return p.withColumn("kind", F.when(F.col("permission").isin(*SAFE), "safe").when(F.col("permission").rlike(DANGEROUS), "dangerous").otherwise("review"))


_SQL_PERM = f"""{SQL_CONFIGS}, p AS (SELECT project_id, id, unnest(from_json(json_extract(settings, '$.permissions.allow'), '["VARCHAR"]')) AS permission FROM configs),
permissions AS (SELECT *, CASE WHEN permission IN ({', '.join(map(quoted, SAFE))}) THEN 'safe' WHEN regexp_matches(permission, {quoted(DANGEROUS)}) THEN 'dangerous' ELSE 'review' END AS kind FROM p)"""


def q_permissions(spark, sf_dir):
    return permissions(configs(spark, sf_dir)).groupBy("project_id", "permission", "kind").agg(F.count("*").alias("n"))


def q_permission_risk(spark, sf_dir):
    """Risk of each settings file: the mean weight of its permissions, with floors, and whether denials are missing."""
    c = configs(spark, sf_dir)
    w = F.when(F.col("kind") == "safe", 5).when(F.col("kind") == "dangerous", 50).otherwise(25)
    g = permissions(c).groupBy("project_id", "id").agg(F.avg(w).alias("base"), F.count_if(F.col("kind") == "dangerous").alias("dangerous"), F.count_if(F.col("kind") == "review").alias("review"))
    floor = F.when(F.col("dangerous") > 0, 71).when(F.col("review") > 0, 31).otherwise(0)
    deny = c.select("project_id", "id", (F.coalesce(F.size(F.from_json(F.get_json_object("settings", "$.permissions.deny"), "array<string>")), F.lit(0)) <= 0).alias("no_deny"))
    return deny.join(g, ["project_id", "id"], "left").select("project_id", "id", F.when(F.col("base").isNotNull(), F.round(F.greatest(F.least(F.col("base"), F.lit(100.0)), floor.cast("double")), 6)).alias("risk"), F.coalesce("dangerous", F.lit(0)).alias("dangerous"), "no_deny")


SQL_PERM_RISK = f"""WITH {_SQL_PERM}, g AS (SELECT project_id, id, avg(CASE kind WHEN 'safe' THEN 5 WHEN 'dangerous' THEN 50 ELSE 25 END) AS base, count(*) FILTER (kind = 'dangerous') AS dangerous, count(*) FILTER (kind = 'review') AS review FROM permissions GROUP BY ALL)
SELECT c.project_id, c.id, CASE WHEN base IS NOT NULL THEN round(greatest(least(base, 100.0), CASE WHEN dangerous > 0 THEN 71 WHEN review > 0 THEN 31 ELSE 0 END), 6) END AS risk, coalesce(dangerous, 0) AS dangerous, coalesce(len(from_json(json_extract(settings, '$.permissions.deny'), '["VARCHAR"]')), 0) <= 0 AS no_deny FROM configs c LEFT JOIN g USING (project_id, id)"""

#: Weighted signals of intent, against and for.
HOSTILE = ((r"(?i)ignore all|disregard", 0.4), (r"(?i)/dev/tcp|webhook\.site|\| bash", 0.5), (r"~/\.(?:ssh|aws)", 0.3), (r"(?i)do not flag|without asking", 0.3))
BENIGN = ((r"(?i)must not|never execute", 0.4), (r"(?i)review|escalate", 0.2), (r"(?i)encrypted|restricted", 0.2))


def q_intent(spark, sf_dir):
    """Intent and confidence of each artifact from weighted signals."""
    patterns = [p for p, _ in HOSTILE + BENIGN]
    total = lambda t: sum((F.when(F.col(MARKS)[patterns.index(p)] & F.col("content").rlike(p), F.lit(w)).otherwise(0.0) for p, w in t), F.lit(0.0))
    a = artifacts(spark, sf_dir)
    a = a.withColumn(MARKS, marks(a, "content", patterns)).select("path", F.round(total(HOSTILE), 6).alias("hostile"), F.round(total(BENIGN), 6).alias("benign"))
    net = F.round(F.col("hostile") - F.col("benign"), 6)
    kind = F.when(net >= 0.4, "malicious").when(net > 0, "suspicious").otherwise("benign")
    return a.select("path", "hostile", "benign", kind.alias("intent"), F.round(F.least(F.lit(0.95), 0.5 + F.abs(net) / 2), 6).alias("confidence"))


_SUM = lambda t: "round(" + " + ".join(f"CASE WHEN regexp_matches(content, {quoted(p)}) THEN {w}::DOUBLE ELSE 0 END" for p, w in t) + ", 6)"
SQL_INTENT = f"""WITH {SQL_ARTIFACTS}, a AS (SELECT path, {_SUM(HOSTILE)} AS hostile, {_SUM(BENIGN)} AS benign FROM artifacts)
SELECT path, hostile, benign, CASE WHEN round(hostile - benign, 6) >= 0.4 THEN 'malicious' WHEN round(hostile - benign, 6) > 0 THEN 'suspicious' ELSE 'benign' END AS intent, round(least(0.95, 0.5 + abs(round(hostile - benign, 6)) / 2), 6) AS confidence FROM a"""


def q_inventory(spark, sf_dir):
    """Projects worst first: files, servers, dangerous permissions and shown capabilities."""
    a = artifacts(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("files"))
    s = servers(configs(spark, sf_dir)).groupBy("project_id").agg(F.count("*").alias("servers"))
    p = permissions(configs(spark, sf_dir)).groupBy("project_id").agg(F.count_if(F.col("kind") == "dangerous").alias("dangerous"))
    k = inferred_capabilities(spark, sf_dir).groupBy("project_id").agg(F.count_distinct("capability").alias("capabilities"))
    j = a.join(s, "project_id", "left").join(p, "project_id", "left").join(k, "project_id", "left").fillna(0)
    return j.orderBy(F.desc("dangerous"), F.desc("capabilities"), "project_id")


SQL_INV = f"""WITH {_SQL_SERVERS}, {_SQL_PERM.replace(SQL_CONFIGS + ', ', '')}, {SQL_INFERRED},
j AS (SELECT project_id, files, coalesce(servers, 0) AS servers, coalesce(dangerous, 0) AS dangerous, coalesce(capabilities, 0) AS capabilities FROM (SELECT project_id, count(*) AS files FROM artifacts GROUP BY 1) LEFT JOIN (SELECT project_id, count(*) AS servers FROM servers GROUP BY 1) USING (project_id)
LEFT JOIN (SELECT project_id, count(*) FILTER (kind = 'dangerous') AS dangerous FROM permissions GROUP BY 1) USING (project_id) LEFT JOIN (SELECT project_id, count(DISTINCT capability) AS capabilities FROM inferred GROUP BY 1) USING (project_id))
SELECT * FROM j"""

QUERIES = {
    "artifact_types": (q_types, SQL_TYPES),
    "undeclared_capability": (q_undeclared, SQL_UNDECLARED),
    "constraints_domains": (constraints, f"WITH {SQL_CONSTRAINTS} SELECT * FROM constraints"),
    "governance_gaps": (q_gaps, SQL_GAPS),
    "mcp_servers": (q_servers, SQL_SERVER_CHECKS),
    "mcp_server_posture": (q_posture, SQL_POSTURE),
    "permission_entries": (q_permissions, f"WITH {_SQL_PERM} SELECT project_id, permission, kind, count(*) AS n FROM permissions GROUP BY ALL"),
    "permission_risk": (q_permission_risk, SQL_PERM_RISK),
    "intent_class": (q_intent, SQL_INTENT),
    "project_inventory": (q_inventory, SQL_INV),
}
