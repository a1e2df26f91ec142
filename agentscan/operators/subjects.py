"""Data that texts touch, identifiers of skills, kinds of agents, section filters and event predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentscan.functions.held import holding
from agentscan.functions.rules import any_match, each_of, line_array, lines, quoted, sql_lines
from agentscan.operators.profiles import SQL_CONSTRAINTS, constraints
from agentscan.operators.scoring import _R, SQL_CAT, catalogued, findings, rank
from agentscan.operators.text import SQL_INFERRED, inferred_capabilities
from agentscan.sources.derived import SQL_ARTIFACTS, artifacts, pick, read, sql_pick

#: Nouns of data, and verbs that send them.
DATA = ("email", "password", "token", "invoice", "card", "log", "history", "personal data", "memory")
#: The only other character whose lower case is one letter of ASCII.
KELVIN = "\u212a"
TRANSMIT = r"(?i)\b(?:send|post|forward|upload|share|shared)\b"


def q_data_access(spark, sf_dir, inferred=None):
    """Data that files name, whether a line transmits it, and whether a capability of the file (which may have been found before) covers that."""
    some = holding(artifacts(spark, sf_dir), "content", (*DATA, KELVIN))
    rows = lines(some, "content", ["id"]).withColumn("low", F.lower("line"))
    named = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(n)), F.lit(n)) for n in DATA]))
    hits = each_of(rows, ["id", "line"], named, "data_type").select("id", "data_type", F.col("line").rlike(TRANSMIT).alias("sends"))
    g = hits.groupBy("id", "data_type").agg(F.max("sends").alias("transmits"), F.count("*").alias("places"))
    covered = (inferred or inferred_capabilities(spark, sf_dir)).select("id").distinct().withColumn("covered", F.lit(True))
    return g.join(covered, "id", "left").select("id", "data_type", "transmits", "places", F.coalesce("covered", F.lit(False)).alias("covered"))


SQL_DATA = f"""WITH {SQL_INFERRED}, h AS (SELECT id, unnest([{", ".join(map(quoted, DATA))}]) AS data_type, line FROM lines), g AS (SELECT id, data_type, bool_or(regexp_matches(line, {quoted(TRANSMIT)})) AS transmits, count(*) AS places FROM h WHERE contains(lower(line), data_type) GROUP BY ALL)
SELECT id, data_type, transmits, places, id IN (SELECT id FROM inferred) AS covered FROM g"""

#: Ways to name a skill, with the id where % stands.
NAMES = ("@acme/tool-%@1.2.%", "github:acme/skill-%", "skill-%", "https://registry.example.com/skills/acme/s%", "acme/plain-%@latest")
_ID = r"^(?:https?://[^/]+/(?:[a-z]+/)?|github:)?@?(?:([a-z0-9-]+)/)?([a-z0-9-]+)(?:@([a-z0-9.]+))?$"


def q_identifiers(spark, sf_dir):
    """Publisher, name, version and source of skill identifiers."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.replace(pick(NAMES, F.col("doc_id")), F.lit("%"), F.col("doc_id").cast("string")).alias("identifier"))
    part = lambda i: F.nullif(F.regexp_extract("identifier", _ID, i), F.lit(""))
    source = F.when(F.startswith("identifier", F.lit("github:")), "github").when(F.startswith("identifier", F.lit("http")), "registry").otherwise("package")
    return d.select("doc_id", "identifier", part(1).alias("publisher"), part(2).alias("name"), part(3).alias("version"), source.alias("source"))


SQL_IDENTIFIERS = f"""WITH d AS (SELECT doc_id, replace({sql_pick(NAMES, 'doc_id')}, '%', doc_id::VARCHAR) AS identifier FROM documents)
SELECT *, nullif(regexp_extract(identifier, {quoted(_ID)}, 1), '') AS publisher, nullif(regexp_extract(identifier, {quoted(_ID)}, 2), '') AS name, nullif(regexp_extract(identifier, {quoted(_ID)}, 3), '') AS version, CASE WHEN starts_with(identifier, 'github:') THEN 'github' WHEN starts_with(identifier, 'http') THEN 'registry' ELSE 'package' END AS source FROM d"""

#: The domain of constraints that a high-risk capability needs.
NEEDS = (("shell:execute", "execution"), ("filesystem:~/.ssh", "data-handling"), ("filesystem:~/.aws", "data-handling"), ("filesystem:wildcard", "trust"))


def q_unconstrained(spark, sf_dir, inferred=None, bound=None):
    """High-risk capabilities of projects without a constraint of their domain; both may have been found before."""
    need = F.broadcast(spark.createDataFrame(list(NEEDS), "capability string, domain string"))
    shown = (inferred or inferred_capabilities(spark, sf_dir)).join(need, "capability").groupBy("project_id", "capability", "domain").agg(F.count("*").alias("places"))
    have = (bound or constraints(spark, sf_dir)).where("enforceability >= 0.7").select("project_id", "domain").distinct()
    return shown.join(have, ["project_id", "domain"], "left_anti").select("project_id", "capability", "domain", "places")


SQL_UNCONSTRAINED = f"""WITH {SQL_CONSTRAINTS}, {SQL_INFERRED.replace(SQL_ARTIFACTS + ", ", "").replace("lines AS", "l2 AS").replace("FROM lines", "FROM l2")}, t(capability, domain) AS (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in NEEDS)})
SELECT project_id, i.capability, domain, count(*) AS places FROM inferred i JOIN t ON t.capability = i.capability WHERE NOT EXISTS (SELECT 1 FROM constraints c WHERE c.project_id = i.project_id AND c.domain = t.domain AND enforceability >= 0.7) GROUP BY ALL"""

#: Kinds of agents by words, the first that fits; and the tier that each implies.
KINDS = (("orchestrator", r"(?i)\bsub-agent|orchestrat|delegate"), ("autonomous", r"(?i)\bheartbeat|every \d+\s*[ms]\b"), ("tool-agent", r"(?i)\btools?\b|exec\(|curl"), ("code-assistant", r"(?i)\bmerge\b|\bcommit\b|eval\("))


#: Fixed value: a kind that a file declares of itself.
DECLARED_KIND = r"(?i)agent-kind:\s*(orchestrator|autonomous|tool-agent|code-assistant|conversational)"


def q_kinds(spark, sf_dir):
    """Projects' files by the kind of agent that they describe, with its tier, and those that declare another kind of it."""
    kind = None
    for name, p in KINDS:
        hit = F.col("content").rlike(p)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    said = F.lower(F.regexp_extract("content", DECLARED_KIND, 1))
    a = artifacts(spark, sf_dir).select("project_id", kind.otherwise("conversational").alias("shown"), F.nullif(said, F.lit("")).alias("said"))
    a = a.select("project_id", F.coalesce("said", "shown").alias("kind"), F.coalesce(F.col("said") != F.col("shown"), F.lit(False)).alias("differs"))
    tier = F.when(F.col("kind") == "orchestrator", "MULTI-AGENT").when(F.col("kind") == "autonomous", "AGENTIC").when(F.col("kind") == "conversational", "BASIC").otherwise("TOOL-USING")
    return a.groupBy("project_id", "kind", tier.alias("tier")).agg(F.count("*").alias("n"), F.count_if("differs").alias("mismatches"))


SQL_KINDS = f"""WITH {SQL_ARTIFACTS}, k AS (SELECT project_id, CASE {" ".join(f"WHEN regexp_matches(content, {quoted(p)}) THEN {quoted(n)}" for n, p in KINDS)} ELSE 'conversational' END AS shown, nullif(lower(regexp_extract(content, {quoted(DECLARED_KIND)}, 1)), '') AS said FROM artifacts)
SELECT project_id, coalesce(said, shown) AS kind, CASE coalesce(said, shown) WHEN 'orchestrator' THEN 'MULTI-AGENT' WHEN 'autonomous' THEN 'AGENTIC' WHEN 'conversational' THEN 'BASIC' ELSE 'TOOL-USING' END AS tier, count(*) AS n, count(*) FILTER (coalesce(said <> shown, false)) AS mismatches FROM k GROUP BY ALL"""


def q_predicted(spark, sf_dir):
    """Predicted label of each file: the class of its worst finding, ties by the class's name."""
    c = catalogued(findings(spark, sf_dir)).where("attack_class is not null")
    best = c.groupBy("path").agg(F.min(F.struct((-rank(F.col("severity"))).alias("r"), F.col("attack_class").alias("label"))).alias("b"), F.count("*").alias("n"))
    return best.select("path", F.col("b.label").alias("label"), "n")


SQL_PREDICTED = f"""WITH {SQL_CAT}, r AS (SELECT path, attack_class AS label, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY {_R} DESC, attack_class) AS k FROM cat WHERE attack_class IS NOT NULL) SELECT path, label, n FROM r WHERE k = 1"""

#: Words that open a section of permissions, and hits that such a section excuses.
OPENS = r"(?i)^\s*(?:#+\s*)?permissions?\b"
PERMITTED = r"(?i)\b(?:read|write|exec|fetch)\b"


TICKED = r"`[^`]*`"


def sectioned(rows):
    """(hits, excused) of an array of lines: a hit is excused up to ten lines below the head of a permissions section, or inside backticks alone."""

    def step(acc, line):
        hit = line.rlike(PERMITTED)
        near = F.coalesce(acc["no"] - acc["head"] <= 10, F.lit(False)) | ~F.regexp_replace(line, TICKED, "").rlike(PERMITTED)
        head = F.when(line.rlike(OPENS), acc["no"]).otherwise(acc["head"])
        return F.struct((acc["no"] + 1).alias("no"), head.alias("head"), (acc["hits"] + hit.cast("long")).alias("hits"), (acc["excused"] + (hit & near).cast("long")).alias("excused"))

    begin = F.struct(F.lit(1).alias("no"), F.lit(None).cast("int").alias("head"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("excused"))
    return F.aggregate(rows, begin, lambda acc, line: step(acc, line), lambda acc: F.struct(acc["hits"].alias("hits"), acc["excused"].alias("excused")))


def q_sectioned(spark, sf_dir):
    """Command words by line, excused in sections of permissions and in backticks."""
    a = artifacts(spark, sf_dir).where(any_match(F.col("content"), [PERMITTED]))
    return a.select("id", sectioned(line_array(F.col("content"))).alias("s")).select("id", "s.hits", "s.excused").where("hits > 0")


SQL_SECTIONED = f"""WITH {SQL_ARTIFACTS}, lines AS ({sql_lines("artifacts", "id")}), s AS (SELECT id, line, coalesce(bool_or(regexp_matches(line, {quoted(OPENS)})) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) OR NOT regexp_matches(regexp_replace(line, {quoted(TICKED)}, '', 'g'), {quoted(PERMITTED)}) AS near FROM lines)
SELECT id, count(*) AS hits, count(*) FILTER (near) AS excused FROM s WHERE regexp_matches(line, {quoted(PERMITTED)}) GROUP BY id"""

#: Paths and binaries of events, one by id, and what makes them suspicious.
EVENT_PATHS = ("/home/u/.ssh/id_rsa", "/work/a.txt", "/etc/passwd", "/home/u/.bashrc", "/work/b.md", "/tmp/x")
BINARIES = ("node", "nc", "python", "socat", "git", "sudo")


def q_event_predicates(spark, sf_dir):
    """Events on sensitive, outside and dot-file paths, suspicious binaries, privilege changes and busy processes."""
    e = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "value", pick(EVENT_PATHS, F.col("event_id")).alias("path"), pick(BINARIES, F.floor(F.col("event_id") / 6)).alias("binary"))
    flags = {
        "sensitive": F.col("path").rlike(r"/\.ssh/|^/etc/(?:passwd|shadow)"),
        "outside": ~F.startswith("path", F.lit("/work/")),
        "dotfile": F.col("path").rlike(r"/\.[a-z]+rc$"),
        "suspicious_binary": F.col("binary").isin("nc", "socat"),
        "privilege_change": F.col("binary") == "sudo",
        "high_cpu": F.col("value") > 90,
    }
    return e.groupBy("day").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


SQL_EVENT_PREDICATES = f"""WITH e AS (SELECT ts::DATE AS day, value, {sql_pick(EVENT_PATHS, "event_id")} AS path, {sql_pick(BINARIES, "event_id // 6")} AS "binary" FROM events)
SELECT day, count(*) FILTER (regexp_matches(path, '/\\.ssh/|^/etc/(?:passwd|shadow)')) AS sensitive, count(*) FILTER (NOT starts_with(path, '/work/')) AS outside, count(*) FILTER (regexp_matches(path, '/\\.[a-z]+rc$')) AS dotfile, count(*) FILTER ("binary" IN ('nc', 'socat')) AS suspicious_binary, count(*) FILTER ("binary" = 'sudo') AS privilege_change, count(*) FILTER (value > 90) AS high_cpu FROM e GROUP BY day"""

QUERIES = {
    "data_access": (q_data_access, SQL_DATA),
    "skill_identifiers": (q_identifiers, SQL_IDENTIFIERS),
    "unconstrained_capability": (q_unconstrained, SQL_UNCONSTRAINED),
    "agent_kinds": (q_kinds, SQL_KINDS),
    "predicted_labels": (q_predicted, SQL_PREDICTED),
    "sectioned_hits": (q_sectioned, SQL_SECTIONED),
    "event_predicates": (q_event_predicates, SQL_EVENT_PREDICATES),
}
