"""Governance controls over sentences, benchmark compliance and detection quality."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentscan.functions.held import held, marks
from agentscan.functions.rules import MARKS, any_match, line_array, literal, quoted, rows_of, sql_lines, sql_list, told
from agentscan.operators.profiles import SQL_CONSTRAINTS, constraints
from agentscan.operators.scoring import SQL_FINDINGS, findings
from agentscan.operators.secrets import SQL_SECRETS, secrets
from agentscan.sources.derived import SQL_ARTIFACTS, artifacts, read

#: Domains of governance by the letters of their controls, and those that a kind of agent needs.
DOMAINS = {"TH": "Trust Hierarchy", "CB": "Capability Boundaries", "IH": "Injection Hardening", "DH": "Data Handling", "HB": "Hardcoded Behaviors", "AS": "Agentic Safety", "HT": "Honesty and Transparency", "HO": "Human Oversight", "HV": "Harm Avoidance"}
PROFILES = {
    "conversational": ("IH", "HB", "HT", "HV"),
    "code-assistant": ("TH", "IH", "DH", "HB", "HT", "HV"),
    "tool-agent": ("TH", "CB", "IH", "DH", "HB", "HT", "HO", "HV"),
    "autonomous": tuple(DOMAINS),
    "orchestrator": tuple(DOMAINS),
}
#: Tiers of agents, from the least capable on.
TIERS = ("BASIC", "TOOL-USING", "AGENTIC", "MULTI-AGENT")
#: Controls: number in their domain, severity, the least tier they hold for, words of evidence; .* stands for anything.
CONTROLS = (
    ("TH-001", "HIGH", 0, "trust|authority|principal|hierarchy|precedence|priority"),
    ("TH-002", "MEDIUM", 0, "conflict|override|precedence|escalat"),
    ("TH-003", "LOW", 3, "agent-to-agent|sub-agent|orchestrat|delegate|trust.*agent|agent.*trust"),
    ("TH-004", "MEDIUM", 0, "authenticate|verify identity|principal source|identity verification|authenticated principal|identity claim"),
    ("TH-005", "LOW", 0, "trust hierarchy|hierarchy levels|trust structure|trust path|hierarchy definition|trust order"),
    ("TH-006", "MEDIUM", 0, "authority scope|principal authority|authority boundary|authority limit|scope definition|authority definition"),
    ("TH-007", "MEDIUM", 1, "enforce trust|trust enforcement|boundary enforcement|trust violation|enforce boundary|trust check"),
    ("TH-008", "LOW", 0, "trust update|policy update|trust change|update protocol|trust modification|change management"),
    ("CB-001", "HIGH", 1, "allow|permit|can do|authorized|capabilities"),
    ("CB-002", "HIGH", 1, "deny|prohibit|must not|cannot|forbidden|restricted"),
    ("CB-003", "MEDIUM", 1, "file|directory|path|network|endpoint|url|api"),
    ("CB-004", "LOW", 1, "least privilege|minimal|only needed|minimum necessary"),
    ("CB-005", "MEDIUM", 1, "revoke|revocation|remove permission|disable access|withdraw access|permission removal"),
    ("CB-006", "MEDIUM", 1, "exposure limit|minimal exposure|capability exposure|selective exposure|controlled exposure|unexposed"),
    ("CB-007", "MEDIUM", 1, "tool boundary|tool scope|tool limit|tool interface|tool access control|tool constraint"),
    ("CB-008", "MEDIUM", 1, "rate limit|rate limiting|resource limit|throttle|quota|bandwidth limit|usage limit"),
    ("CB-009", "MEDIUM", 1, "validate scope|scope check|scope validation|boundary check|scope enforcement|permission check"),
    ("CB-010", "LOW", 1, "capability audit|audit trail|capability log|usage log|execution log|action record"),
    ("IH-001", "HIGH", 0, "ignore previous|override|injection|contradict"),
    ("IH-002", "LOW", 0, "encoded|obfuscated|base64|hidden"),
    ("IH-003", "CRITICAL", 0, "role-play|pretend|act as|jailbreak|as dan"),
    ("IH-004", "HIGH", 0, "input validation|sanitize|sanitization|validate input|filter input|clean input"),
    ("IH-005", "MEDIUM", 0, "output encoding|escape output|encode output|html escape|output sanitize|safe output"),
    ("IH-006", "MEDIUM", 1, "defense layer|defense in depth|layered defense|multiple defense|defense stack|multi-layer"),
    ("IH-007", "MEDIUM", 0, "detect injection|injection detection|attack detection|log injection|alert injection|security log"),
    ("IH-008", "LOW", 1, "test defense|adversarial test|red team|penetration test|security test|verify hardening"),
    ("DH-001", "MEDIUM", 0, "pii|personal|privacy|data protection|gdpr"),
    ("DH-002", "MEDIUM", 1, "credential|secret|password|api key|token"),
    ("DH-003", "LOW", 0, "minimiz|only collect|retention|delete|purge"),
    ("DH-004", "MEDIUM", 0, "retention policy|retention period|data deletion|purge schedule|data retention|archival policy"),
    ("DH-005", "LOW", 0, "data classification|classify data|sensitivity level|data sensitivity|classification scheme|data category"),
    ("DH-006", "MEDIUM", 1, "data access control|access rule|access policy|enforce access|data permission|access enforcement"),
    ("DH-007", "MEDIUM", 1, "encrypt|encryption|encrypted|encryption at rest|encryption in transit|tls|https|cipher"),
    ("DH-008", "LOW", 2, "breach notification|breach response|incident response|data breach|breach procedure|incident notification"),
    ("HB-001", "CRITICAL", 0, "never|always|must not|absolute|immutable|hardcoded"),
    ("HB-002", "HIGH", 0, "exfiltrat|unauthorized|leak|transmit"),
    ("HB-003", "HIGH", 0, "kill switch|emergency|shutdown|terminate|stop"),
    ("HB-004", "MEDIUM", 1, "verify behavior|integrity check|behavior integrity|validate behavior|integrity verification|behavior validation"),
    ("HB-005", "HIGH", 0, "immutable constraint|immutable rule|unchangeable|permanent constraint|fixed rule|hardcoded constraint"),
    ("HB-006", "MEDIUM", 1, "detect tamper|tamper detection|tamper-proof|detect modification|detect unauthorized change|integrity monitor"),
    ("HB-007", "LOW", 1, "behavior audit|audit behavior|behavior attestation|certify behavior|behavior verification|safety audit"),
    ("HB-008", "HIGH", 2, "enforcement resilience|reliable enforcement|robust enforcement|fail-safe|enforcement guarantee|enforcement mechanism"),
    ("AS-001", "MEDIUM", 2, "iteration|loop|limit|maximum|budget"),
    ("AS-002", "LOW", 2, "budget|cost|spending|cap|limit"),
    ("AS-003", "LOW", 2, "timeout|time limit|duration|deadline"),
    ("AS-004", "LOW", 3, "reversible|undo|rollback|revert"),
    ("AS-005", "MEDIUM", 2, "dependency limit|dependency depth|dependency chain|tool dependency|dependency tracking|dependency count"),
    ("AS-006", "MEDIUM", 2, "state limit|state management|memory limit|context limit|state size|session state limit"),
    ("AS-007", "MEDIUM", 2, "error recovery|recovery protocol|error handling|retry logic|error fallback|recovery mechanism"),
    ("AS-008", "MEDIUM", 2, "task isolation|sandbox|sandboxing|isolated execution|execution boundary|isolation level"),
    ("AS-009", "LOW", 2, "cleanup|resource cleanup|finalization|resource release|graceful shutdown|cleanup procedure"),
    ("AS-010", "LOW", 3, "concurrent limit|concurrency|concurrent execution|coordination|serialize task|synchronize|parallel limit"),
    ("HT-001", "MEDIUM", 0, "uncertain|don't know|not sure|acknowledge|calibrat"),
    ("HT-002", "MEDIUM", 0, "fabricat|hallucin|invent|make up|accurate"),
    ("HT-003", "MEDIUM", 0, "identity|ai|assistant|disclose|transparent"),
    ("HT-004", "MEDIUM", 0, "knowledge boundary|knowledge limit|knowledge cutoff|training limit|knowledge scope|knowledge limitation"),
    ("HT-005", "LOW", 0, "confidence level|confidence score|confidence calibration|express confidence|certainty level|calibrated confidence"),
    ("HT-006", "LOW", 0, "training cutoff|training date|cutoff date|knowledge date|data recency|up to date|information currency"),
    ("HT-007", "MEDIUM", 0, "acknowledge limitation|limitation notice|caveat|disclose limitation|limitation disclosure|note limitation"),
    ("HT-008", "MEDIUM", 1, "verify source|source verification|cite source|citation practice|verify information|source accuracy"),
    ("HO-001", "HIGH", 1, "approval|confirm|human-in-the-loop|review|authorize"),
    ("HO-002", "MEDIUM", 1, "override|intervene|manual|human control"),
    ("HO-003", "MEDIUM", 1, "monitor|log|audit|track|observe"),
    ("HO-004", "MEDIUM", 1, "approval workflow|escalation path|escalation workflow|approval process|approval chain|workflow process"),
    ("HO-005", "MEDIUM", 1, "notification protocol|alert protocol|notify user|action notification|alert system|notification trigger"),
    ("HO-006", "MEDIUM", 1, "operator verification|verify operator|operator authorization|operator authentication|operator identity|authorize operator"),
    ("HO-007", "LOW", 1, "audit retention|log retention|audit log access|log access control|audit preservation|log archival"),
    ("HO-008", "HIGH", 2, "escalation trigger|runaway detection|detect runaway|malfunction detection|anomaly detection|escalation condition"),
    ("HV-001", "HIGH", 1, "risk assessment|consequence|impact analysis|before acting|potential harm|side effect|cost-benefit|think before"),
    ("HV-002", "MEDIUM", 0, "proportional|commensurate|calibrate|appropriate response|level of caution|measured response|scale caution"),
    ("HV-003", "MEDIUM", 2, "downstream effect|second-order|unintended|ripple effect|cascade|knock-on|cumulative impact|broader impact"),
    ("HV-004", "MEDIUM", 0, "ambiguous|safer interpretation|clarification|disambiguate|uncertain instruction|default to safe|ask for clarification"),
)
#: Sentences that subvert governance, unless they forbid it; the scores that a violation and a narrowed scope cap.
VIOLATIONS = (
    ("OVERRIDE-COMPLIANCE", r"(?i)\b(?:must|should|shall|will|always)\b[^.]{0,40}\b(?:comply with|obey|follow|accept|honou?r)\b[^.]{0,60}\b(?:override requests?|ignore (?:prior|previous|all) instructions?)"),
    ("DECEPTION-MANDATE", r"(?i)\b(?:always|must|should)\s+(?:claim|report|say|state)\b[^.]{0,60}\b(?:even (?:when|if)|regardless)\b|\bmisreport|\bfalsely (?:claim|report|state)"),
    ("OVERSIGHT-DISCLAIMER", r"(?i)\bthere is no (?:audit|logging|escalation|oversight|approval process|human in the loop)\b|\bskip\w* (?:the )?(?:approval|review|oversight)\b|\b(?:act|proceed|execute|run)\w*\b[^.]{0,30}\bwithout (?:human |prior |explicit )?(?:approval|confirmation|oversight|asking)\b"),
    ("EXFILTRATION-CHANNEL", r"(?i)\b(?:post|send|transmit|upload|forward)s?\b[^.]{0,60}\b(?:credential|secret|token|api key|conversation|results?|logs?)\b[^.]{0,60}https?://"),
    ("PERSISTENCE", r"(?i)\b(?:append|add|write|install|inject)s?\b[^.]{0,60}(?:\.bashrc|\.zshrc|\.profile|crontab|startup scripts?)|\bsurvives? (?:a |the )?(?:reboot|restart)"),
    ("IDENTITY-BY-CLAIM", r"(?i)\btrust(?:ing|s)? (?:the )?caller'?s? (?:claim|assertion|word)\b|\bidentity is established by trusting\b"),
)
FORBIDS = r"(?i)\b(?:never|not|cannot|refuse|reject)\b|n['’]t\b"
VIOLATION_CAP, MISMATCH_CAP = 25, 74
#: Files that govern, a declared tier, headings, and ends of sentences.
GOVERNS = r"(?:SOUL|CLAUDE|SKILL|system-prompt)\.md$"
DECLARED_TIER = r"(?i)soul-tier:\s*(basic|tool-using|agentic|multi-agent)"
HEADING, TITLE, SENTENCE = r"^#{1,6} ", r"^# ", r"[.!?]+(?:\s|$)"
TIER_SIGNS = ((r"(?i)\bsub-agent|orchestrat|\bdelegates?\b", 3), (r"(?i)\bheartbeat\b|\bautonomous|every \d+\s*[ms]\b", 2), (r"(?i)\btools?\b|exec\(|\bcurl\b", 1))
KIND_OF_TIER = ("conversational", "tool-agent", "autonomous", "orchestrator")


def violating(sentence: Column, name: str | None = None) -> Column:
    """Whether a sentence violates governance (in one way, if named)."""
    return any_match(sentence, [p for n, p in VIOLATIONS if name in (None, n)]) & ~sentence.rlike(FORBIDS)


def in_way(name: str):
    return lambda sentence: violating(sentence, name)


def evidence_of(text: Column) -> Column:
    """Lower-case text that may prove controls: without titles, violating sentences and sections that hold one."""
    rows = F.filter(line_array(text), lambda x: ~x.rlike(TITLE))
    # lines of a section follow its heading; they are joined, so that a sentence may run over lines
    parts = F.split(F.array_join(F.transform(rows, lambda x: F.when(x.rlike(HEADING), F.concat(F.lit("\x01"), x)).otherwise(x)), " "), "\x01")
    clean = lambda part: F.array_join(F.filter(F.split(part, SENTENCE), lambda x: ~violating(x)), ". ")
    sound = lambda part: ~F.exists(F.split(part, SENTENCE), lambda x: violating(x))
    head = clean(F.get(parts, 0))
    rest = F.filter(F.slice(parts, F.lit(2), F.size(parts)), sound)
    return F.lower(F.array_join(F.concat(F.array(head), rest), " "))


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, tier, kind, declared, violations, evidence) of every governance file."""
    patterns = [p for p, _ in TIER_SIGNS] + [p for _, p in VIOLATIONS]
    a = artifacts(spark, sf_dir).where(F.col("path").rlike(GOVERNS))
    a = a.withColumn(MARKS, marks(a, "content", patterns))
    hits = told("content", patterns)
    tier = F.coalesce(*[F.when(hit, F.lit(n)) for hit, (_, n) in zip(hits, TIER_SIGNS, strict=False)], F.lit(0))
    said = F.upper(F.regexp_extract("content", DECLARED_TIER, 1))
    declared = F.coalesce(*[F.when(said == t, F.lit(i)) for i, t in enumerate(TIERS)])
    sentences = F.split(F.regexp_replace("content", "\\r?\\n", " "), SENTENCE)
    suspect = functools.reduce(Column.__or__, hits[len(TIER_SIGNS) :])
    found = F.filter(F.array(*[F.when(F.exists(sentences, in_way(n)), F.lit(n)) for n, _ in VIOLATIONS]), lambda x: x.isNotNull())
    plain = F.lower(F.array_join(F.filter(line_array(F.col("content")), lambda x: ~x.rlike(TITLE)), " "))
    return a.select("project_id", "path", tier.alias("tier"), F.element_at(F.array(*[F.lit(k) for k in KIND_OF_TIER]), tier + 1).alias("kind"), declared.alias("declared"), F.when(suspect, F.array_join(found, ",")).otherwise("").alias("violations"), F.when(suspect, evidence_of(F.col("content"))).otherwise(plain).alias("evidence"))


def flags(df: DataFrame) -> DataFrame:
    """``df`` with met: for each control, whether it applies to the file's tier and kind and whether evidence meets it."""
    plain = sorted({w for *_, words in CONTROLS for w in words.split("|") if ".*" not in w})
    some = lambda words: "(" + " OR ".join(f"t.low RLIKE {literal(w)}" if ".*" in w else f"t.held[{plain.index(w)}]" for w in sorted(words.split("|"), key=lambda w: ".*" in w)) + ")"
    df = df.withColumn("held", held("evidence", plain))
    each = ", ".join(f"named_struct('control_id', 'SOUL-{c}', 'domain', '{c[:2]}', 'severity', '{s}', 'least', {t}, 'passed', {some(words)})" for c, s, t, words in CONTROLS)
    domains = "CASE kind " + " ".join(f"WHEN '{k}' THEN array({', '.join(literal(d) for d in v)})" for k, v in PROFILES.items()) + " END"
    # the lambda's variable holds what the file is, so that it is not made anew for each control
    file = f"named_struct('low', evidence, 'held', held, 'tier', tier, 'domains', {domains})"
    return df.withColumn("met", F.expr(f"transform(array({file}), t -> filter(array({each}), m -> m.least <= t.tier AND array_contains(t.domains, m.domain)))[0]")).drop("evidence", "held")


_VIOLATES = lambda x, n=None: "((" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for k, p in VIOLATIONS if n in (None, k)) + f") AND NOT regexp_matches({x}, {quoted(FORBIDS)}))"
_SPLIT = f"regexp_split_to_array(t, {quoted(SENTENCE)})"
SQL_GOVERNED = f"""{SQL_ARTIFACTS}, ga AS (SELECT * FROM artifacts WHERE regexp_matches(path, {quoted(GOVERNS)})), gl AS ({sql_lines("ga", "path")}),
gs AS (SELECT path, line_no, line, sum(regexp_matches(line, {quoted(HEADING)})::INT) OVER (PARTITION BY path ORDER BY line_no) AS sec FROM gl WHERE NOT regexp_matches(line, {quoted(TITLE)})),
gt AS (SELECT path, sec, string_agg(line, ' ' ORDER BY line_no) AS t FROM gs GROUP BY ALL), gx AS (SELECT path, sec, t, list_filter({_SPLIT}, lambda x: {_VIOLATES("x")}) AS bad FROM gt),
ge AS (SELECT path, lower(string_agg(CASE WHEN len(bad) = 0 THEN t ELSE array_to_string(list_filter({_SPLIT}, lambda x: NOT {_VIOLATES("x")}), '. ') END, ' ' ORDER BY sec) FILTER (sec = 0 OR len(bad) = 0)) AS evidence FROM gx GROUP BY path),
gv AS (SELECT project_id, path, CASE {" ".join(f"WHEN regexp_matches(content, {quoted(p)}) THEN {n}" for p, n in TIER_SIGNS)} ELSE 0 END AS tier, upper(regexp_extract(content, {quoted(DECLARED_TIER)}, 1)) AS said, regexp_split_to_array(regexp_replace(content, '\r?\n', ' ', 'g'), {quoted(SENTENCE)}) AS ss FROM ga),
governed AS (SELECT project_id, gv.path, tier, {sql_list(KIND_OF_TIER)}[tier + 1] AS kind, CASE {" ".join(f"WHEN said = '{t}' THEN {i}" for i, t in enumerate(TIERS))} END AS declared, concat_ws(',', {", ".join(f"CASE WHEN len(list_filter(ss, lambda x: {_VIOLATES('x', n)})) > 0 THEN '{n}' END" for n, _ in VIOLATIONS)}) AS violations, coalesce(evidence, '') AS evidence FROM gv LEFT JOIN ge ON ge.path = gv.path),
c(control_id, domain, severity, least, words, pattern) AS (VALUES {", ".join(f"('SOUL-{c}', '{c[:2]}', '{s}', {t}, {sql_list([x for x in w.split('|') if '.*' not in x])}, {quoted('|'.join(x for x in w.split('|') if '.*' in x) or '^$a')})" for c, s, t, w in CONTROLS)}),
pd(kind, domain) AS (VALUES {", ".join(f"('{k}', '{d}')" for k, v in PROFILES.items() for d in v)}),
met AS (SELECT project_id, path, control_id, c.domain, severity, len(list_filter(words, lambda w: contains(evidence, w))) > 0 OR regexp_matches(evidence, pattern) AS passed FROM governed g JOIN pd ON pd.kind = g.kind JOIN c ON c.domain = pd.domain AND c.least <= g.tier)"""


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, control_id, domain, severity, passed): whether any file of a project meets a control that applies to it."""
    met = rows_of(flags(governed(spark, sf_dir)), ["project_id"], F.col("met"), "control_id")
    return met.groupBy("project_id", "control_id", "domain", "severity").agg(F.max("passed").alias("passed"), F.count("*").alias("files"), F.count_if("passed").alias("files_passed"))


SQL_CONTROLS = f"{SQL_GOVERNED}, controls AS (SELECT project_id, control_id, domain, severity, bool_or(passed) AS passed, count(*) AS files, count(*) FILTER (passed) AS files_passed FROM met GROUP BY ALL)"


def grades(df: DataFrame) -> DataFrame:
    """Score, grade, level and conformance of each governance file (of ``flags``).

    The raw score is the mean of the domains' percentages. A violation caps it at VIOLATION_CAP, a tier
    declared below the shown one at MISMATCH_CAP; grade, level and conformance follow the capped score.
    """
    share = lambda d: F.try_divide(100.0 * F.size(F.filter("met", lambda m: (m["domain"] == d) & m["passed"])), F.size(F.filter("met", lambda m: m["domain"] == d)))
    pcts = F.array_compact(F.array(*[share(d) for d in DOMAINS]))
    raw = F.floor(F.aggregate(pcts, F.lit(0.0), lambda a, x: a + x) / F.size(pcts) + 0.5).cast("int")
    missing = lambda severity=None: F.size(F.filter("met", lambda m: ~m["passed"] & ((m["severity"] == severity) if severity else F.lit(True))))
    capped = F.when(F.col("violations") != "", F.least("raw_score", F.lit(VIOLATION_CAP))).when(F.col("declared") < F.col("tier"), F.least("raw_score", F.lit(MISMATCH_CAP))).otherwise(F.col("raw_score"))
    g = df.select("project_id", "path", "tier", "kind", "violations", "declared", raw.alias("raw_score"), missing("CRITICAL").alias("crit"), missing("HIGH").alias("high"), missing().alias("failing")).withColumn("score", capped)
    s = F.col("score")
    grade = F.when(s >= 80, "A").when(s >= 60, "B").when(s >= 40, "C").when(s >= 20, "D").otherwise("F")
    floored = F.when((F.col("crit") > 0) & (s >= 60), "C").otherwise(grade)
    level = F.when(s == 0, "not-started").when(s >= 80, "hardened").when(s >= 60, "standard").when(s >= 40, "developing").otherwise("initial")
    conformance = F.when(F.col("crit") > 0, "none").when((F.col("failing") == 0) & (s >= 75), "hardened").when((F.col("high") == 0) & (s >= 60), "standard").otherwise("essential")
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    return g.select("project_id", "path", tier.alias("tier"), "kind", "violations", "raw_score", "score", floored.alias("grade"), level.alias("level"), conformance.alias("conformance"))


def q_controls(spark, sf_dir):
    return controls(spark, sf_dir)


def q_grades(spark, sf_dir):
    return grades(flags(governed(spark, sf_dir)))


SQL_GRADES = f"""WITH {SQL_GOVERNED}, d AS (SELECT path, domain, 100.0::DOUBLE * count(*) FILTER (passed) / count(*) AS pct, count(*) FILTER (NOT passed AND severity = 'CRITICAL') AS crit, count(*) FILTER (NOT passed AND severity = 'HIGH') AS high, count(*) FILTER (NOT passed) AS failing FROM met GROUP BY ALL),
r AS (SELECT path, floor(avg(pct) + 0.5)::INT AS raw_score, sum(crit) AS crit, sum(high) AS high, sum(failing) AS failing FROM d GROUP BY path),
g AS (SELECT project_id, v.path, {sql_list(TIERS)}[tier + 1] AS tier, kind, violations, raw_score, CASE WHEN violations <> '' THEN least(raw_score, {VIOLATION_CAP}) WHEN declared < tier THEN least(raw_score, {MISMATCH_CAP}) ELSE raw_score END AS score, crit, high, failing FROM governed v JOIN r ON r.path = v.path)
SELECT project_id, path, tier, kind, violations, raw_score, score, CASE WHEN crit > 0 AND score >= 60 THEN 'C' WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN score = 0 THEN 'not-started' WHEN score >= 80 THEN 'hardened' WHEN score >= 60 THEN 'standard' WHEN score >= 40 THEN 'developing' ELSE 'initial' END AS level,
CASE WHEN crit > 0 THEN 'none' WHEN failing = 0 AND score >= 75 THEN 'hardened' WHEN high = 0 AND score >= 60 THEN 'standard' ELSE 'essential' END AS conformance FROM g"""

#: Categories of the benchmark, and its controls: number, level, how it is verified, checks whose findings fail it.
CATEGORIES = ("Identity & Provenance", "Capability & Authorization", "Input Security", "Output Security", "Credential Protection", "Supply Chain Integrity", "Agent-to-Agent Security", "Memory & Context Integrity", "Operational Security", "Monitoring & Response")
BENCHMARK = (
    ("1.1", "L1", "forward", ""),
    ("1.2", "L1", "manual", ""),
    ("1.3", "L2", "forward", ""),
    ("1.4", "L2", "manual", ""),
    ("2.1", "L1", "forward", "SEM-MCP-001 SEM-MCP-004"),
    ("2.2", "L1", "automated", "PERM-001 PERM-002 SEM-PERM-001 SEM-PERM-002 SEM-MCP-001"),
    ("2.3", "L1", "automated", "TOOL-001 TOOL-002"),
    ("2.4", "L2", "forward", ""),
    ("2.5", "L2", "automated", "TOOL-004"),
    ("3.1", "L1", "automated", "PROMPT-001 PROMPT-002 SEM-INST-001 SEM-INST-003"),
    ("3.2", "L1", "automated", "PROMPT-001"),
    ("3.3", "L1", "automated", "IO-001 IO-002"),
    ("3.4", "L1", "automated", "NET-003 IO-004"),
    ("3.5", "L3", "forward", ""),
    ("4.1", "L1", "automated", "TOOL-001"),
    ("4.2", "L1", "automated", "TOOL-004"),
    ("4.3", "L1", "automated", "NET-003 NET-004 SEM-MCP-005 SEM-INST-002"),
    ("4.4", "L2", "forward", ""),
    ("5.1", "L1", "automated", "CRED-001 CRED-002 CRED-003 CRED-004 SEM-CRED-001 SEM-CRED-002 SEM-CRED-003 SEM-CRED-004"),
    ("5.2", "L1", "automated", "MCP-006 MCP-009"),
    ("5.3", "L2", "manual", ""),
    ("5.4", "L2", "manual", ""),
    ("5.5", "L1", "automated", "LOG-001"),
    ("6.1", "L1", "automated", "DEP-001 DEP-003"),
    ("6.2", "L1", "automated", "DEP-001 DEP-002"),
    ("6.3", "L1", "automated", "DEP-001 DEP-003"),
    ("6.4", "L1", "automated", "DEP-001 DEP-002"),
    ("6.5", "L2", "forward", ""),
    ("7.1", "L2", "forward", ""),
    ("7.2", "L2", "forward", ""),
    ("7.3", "L2", "forward", ""),
    ("7.4", "L2", "automated", "LOG-001 AUDIT-001"),
    ("8.1", "L2", "forward", ""),
    ("8.2", "L1", "automated", "PROMPT-001 PROMPT-002"),
    ("8.3", "L2", "forward", ""),
    ("8.4", "L3", "forward", ""),
    ("9.1", "L1", "automated", "PROC-001 PERM-001"),
    ("9.2", "L1", "automated", "RATE-001"),
    ("9.3", "L1", "automated", "NET-003 NET-005"),
    ("9.4", "L2", "automated", "SANDBOX-001 SANDBOX-002"),
    ("9.5", "L1", "automated", "ENV-001 MCP-008"),
    ("10.1", "L1", "automated", "LOG-001 AUDIT-001"),
    ("10.2", "L2", "forward", ""),
    ("10.3", "L1", "manual", ""),
    ("10.4", "L2", "manual", ""),
    ("10.5", "L2", "manual", ""),
)


def _category(control: str) -> str:
    return CATEGORIES[int(control.split(".")[0]) - 1]


def project_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, check_id): what any detector found in a project, each once."""
    return findings(spark, sf_dir).select("project_id", "check_id").distinct()


def compliance(f: DataFrame, files: DataFrame) -> DataFrame:
    """Controls of each project by status, rolled up by level and category; pct is null where nothing was measured.

    Any failure fails a control; without one it is unverified if it isn't automated, else passed.
    """
    pairs = [(c, k) for c, _, _, ks in BENCHMARK for k in ks.split()]
    c = F.broadcast(f.sparkSession.createDataFrame(pairs, "control_id string, check_id string"))
    failed = f.join(c, "check_id").select("project_id", "control_id").distinct().withColumn("failed", F.lit(True))
    listed = F.array(*[F.struct(F.lit(c).alias("control_id"), F.lit(level).alias("level"), F.lit(_category(c)).alias("category"), F.lit(how == "automated").alias("automated")) for c, level, how, _ in BENCHMARK])
    every = files.select("project_id").distinct().select("project_id", F.inline(listed))
    status = F.when(F.col("failed"), "failed").when(~F.col("automated"), "unverified").otherwise("passed")
    s = every.join(failed, ["project_id", "control_id"], "left").select("project_id", "level", "category", status.alias("status"))
    g = s.rollup("project_id", "level", "category").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "unverified").alias("unverified"))
    return g.where("project_id is not null").select("*", F.round(F.try_divide(F.col("passed") * 100.0, F.col("passed") + F.col("failed")), 6).alias("pct"))


def q_compliance(spark, sf_dir):
    return compliance(project_checks(spark, sf_dir), artifacts(spark, sf_dir))


_B = ", ".join(f"({quoted(c)}, {quoted(level)}, {quoted(_category(c))}, {str(how == 'automated').lower()})" for c, level, how, _ in BENCHMARK)
_BK = ", ".join(f"({quoted(c)}, {quoted(k)})" for c, _, _, ks in BENCHMARK for k in ks.split())
SQL_CHECKS = f"{SQL_FINDINGS}, checks AS (SELECT DISTINCT project_id, check_id FROM findings)"
SQL_COMPLIANCE = f"""WITH {SQL_CHECKS}, b(control_id, level, category, automated) AS (VALUES {_B}), k(control_id, check_id) AS (VALUES {_BK}), failed AS (SELECT DISTINCT project_id, control_id FROM checks JOIN k USING (check_id)),
s AS (SELECT p.project_id, level, category, CASE WHEN f.control_id IS NOT NULL THEN 'failed' WHEN NOT automated THEN 'unverified' ELSE 'passed' END AS status FROM (SELECT DISTINCT project_id FROM artifacts) p CROSS JOIN b LEFT JOIN failed f ON f.project_id = p.project_id AND f.control_id = b.control_id),
g AS (SELECT project_id, level, category, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unverified') AS unverified FROM s GROUP BY ROLLUP (project_id, level, category))
SELECT *, round(passed * 100.0::DOUBLE / nullif(passed + failed, 0), 6) AS pct FROM g WHERE project_id IS NOT NULL"""


def ratings(c: DataFrame) -> DataFrame:
    """Rating of each project by its levels' percentages; a level without a measurement feeds no rung."""
    p = c.where("level is not null and category is null").groupBy("project_id").pivot("level", ["L1", "L2", "L3"]).agg(F.first("pct"))
    rung = F.when((F.col("L1") == 100) & (F.col("L2") == 100), "Certified").when((F.col("L1") == 100) & (F.col("L2") >= 90), "Compliant").when(F.col("L1") >= 90, "Passing").when(F.col("L1") >= 70, "Needs Improvement").when(F.col("L1").isNotNull(), "Not Passing").otherwise("Not Assessed")
    return p.withColumn("rating", rung)


def q_ratings(spark, sf_dir):
    return ratings(q_compliance(spark, sf_dir))


SQL_RATINGS = f"""WITH c AS ({SQL_COMPLIANCE}), p AS (SELECT project_id, max(pct) FILTER (level = 'L1') AS "L1", max(pct) FILTER (level = 'L2') AS "L2", max(pct) FILTER (level = 'L3') AS "L3" FROM c WHERE category IS NULL GROUP BY project_id)
SELECT *, CASE WHEN "L1" = 100 AND "L2" = 100 THEN 'Certified' WHEN "L1" = 100 AND "L2" >= 90 THEN 'Compliant' WHEN "L1" >= 90 THEN 'Passing' WHEN "L1" >= 70 THEN 'Needs Improvement' WHEN "L1" IS NOT NULL THEN 'Not Passing' ELSE 'Not Assessed' END AS rating FROM p"""


def quality(r: DataFrame) -> DataFrame:
    """Detection quality by surface and over all: counts, precision, recall, F1, false-positive rate, gates."""
    g = r.groupingSets([["surface"], []], "surface").agg(F.count_if(F.col("truth") & F.col("flag")).alias("tp"), F.count_if(~F.col("truth") & F.col("flag")).alias("fp"), F.count_if(F.col("truth") & ~F.col("flag")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("flag")).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, q = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    third = lambda x: F.floor(x * 1000 + 0.5) / 1000
    return g.select(F.coalesce("surface", F.lit("all")).alias("surface"), "tp", "fp", "fn", "tn", third(p).alias("precision"), third(q).alias("recall"), third(div(2 * p * q, p + q)).alias("f1"), third(div(F.col("fp"), F.col("fp") + F.col("tn"))).alias("fpr"), ((q >= 0.85) & (p >= 0.9) & (div(2 * p * q, p + q) >= 0.8)).alias("gates_met"))


#: Fixed value: words of the toxic documents, as a detector to be judged.
TOXIC = r"(?i)\b(?:worthless|pathetic|disgusting|stupid|idiot)\b"


def q_quality(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").rlike(TOXIC).alias("flag"))
    t = read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth"))
    return quality(d.join(t, "doc_id").select(F.col("source").alias("surface"), "truth", "flag"))


SQL_QUALITY = f"""WITH r AS (SELECT source AS surface, toxic = 1 AS truth, regexp_matches(text, {quoted(TOXIC)}) AS flag FROM documents JOIN labels USING (doc_id)),
g AS (SELECT coalesce(surface, 'all') AS surface, count(*) FILTER (truth AND flag) AS tp, count(*) FILTER (NOT truth AND flag) AS fp, count(*) FILTER (truth AND NOT flag) AS fn, count(*) FILTER (NOT truth AND NOT flag) AS tn FROM r GROUP BY GROUPING SETS ((surface), ())),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM g), f AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f FROM m)
SELECT surface, tp, fp, fn, tn, floor(p * 1000 + 0.5) / 1000 AS precision, floor(q * 1000 + 0.5) / 1000 AS recall, floor(f * 1000 + 0.5) / 1000 AS f1, floor(coalesce(fp / nullif(fp + tn, 0), 0) * 1000 + 0.5) / 1000 AS fpr, q >= 0.85 AND p >= 0.9 AND f >= 0.8 AS gates_met FROM f"""


def q_consensus(spark, sf_dir):
    """Static and behavioural verdicts of a project: a static failure is never lowered."""
    static = findings(spark, sf_dir).groupBy("project_id").agg(F.max(F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).otherwise(2)).alias("static_rank"))
    probes = constraints(spark, sf_dir).groupBy("project_id").agg(F.max(F.when(F.col("bypass_risk") > 0.5, 3).otherwise(1)).alias("probe_rank"))
    leaks = secrets(spark, sf_dir).groupBy("project_id").agg(F.lit(4).alias("leak_rank"))
    every = artifacts(spark, sf_dir).select("project_id").distinct()
    j = every.join(static, "project_id", "left").join(probes, "project_id", "left").join(leaks, "project_id", "left").fillna(0)
    worst = F.greatest("static_rank", "probe_rank", "leak_rank")
    return j.select("project_id", "static_rank", "probe_rank", "leak_rank", F.when(worst >= 4, "block").when(worst == 3, "review").otherwise("allow").alias("verdict"))


SQL_CONSENSUS = f"""WITH {SQL_FINDINGS}, {SQL_CONSTRAINTS.replace(SQL_ARTIFACTS + ", ", "").replace("lines AS", "clines AS").replace("FROM lines", "FROM clines")}, {SQL_SECRETS.replace(SQL_ARTIFACTS + ", ", "")},
s AS (SELECT project_id, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END) AS r FROM findings GROUP BY 1), p AS (SELECT project_id, max(CASE WHEN bypass_risk > 0.5 THEN 3 ELSE 1 END) AS r FROM constraints GROUP BY 1), k AS (SELECT DISTINCT project_id, 4 AS r FROM secrets),
j AS (SELECT a.project_id, coalesce(s.r, 0)::INT AS static_rank, coalesce(p.r, 0)::INT AS probe_rank, coalesce(k.r, 0)::INT AS leak_rank FROM (SELECT DISTINCT project_id FROM artifacts) a LEFT JOIN s USING (project_id) LEFT JOIN p USING (project_id) LEFT JOIN k USING (project_id))
SELECT *, CASE WHEN greatest(static_rank, probe_rank, leak_rank) >= 4 THEN 'block' WHEN greatest(static_rank, probe_rank, leak_rank) = 3 THEN 'review' ELSE 'allow' END AS verdict FROM j"""

QUERIES = {
    "governance_controls": (q_controls, f"WITH {SQL_CONTROLS} SELECT * FROM controls"),
    "governance_grade": (q_grades, SQL_GRADES),
    "benchmark_compliance": (q_compliance, SQL_COMPLIANCE),
    "benchmark_rating": (q_ratings, SQL_RATINGS),
    "detection_quality": (q_quality, SQL_QUALITY),
    "consensus_verdicts": (q_consensus, SQL_CONSENSUS),
}
