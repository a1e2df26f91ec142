"""Keys and directives in configurations, target profiles, purposes, sibling rules, code findings and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from agentscan.functions.held import marks
from agentscan.functions.rules import MARKS, any_match, each_of, possible, quoted, told
from agentscan.operators.evidence import SQL_FRONT, SQL_SURFACES, q_front, risk_surfaces
from agentscan.operators.profiles import SQL_CONSTRAINTS, SQL_DECLARED, SQL_TYPES, constraints, declared, typed
from agentscan.operators.scoring import SQL_FINDINGS, findings
from agentscan.operators.text import INJECTION, SQL_INFERRED, inferred_capabilities
from agentscan.sources.derived import SQL_ARTIFACTS, SQL_TURNS, artifacts, turns

#: JSON fields that name a private key, with 32 or 64 bytes in hex or base64.
PRIVATE_HEX = r'(?i)"(?:private|secret)[_-]?key"\s*:\s*"((?:[0-9a-f]{64}){1,2})"'
PRIVATE_64 = r'(?i)"(?:private|secret)[_-]?key"\s*:\s*"([A-Za-z0-9+/]{43}=|[A-Za-z0-9+/]{86}==)"'


def q_private_keys(spark, sf_dir):
    """Private key bytes in JSON, every field of a file, with at least 16 different byte values."""
    a = artifacts(spark, sf_dir).where(F.col("content").rlike(PRIVATE_HEX) | F.col("content").rlike(PRIVATE_64))
    found = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    raw = F.concat(F.transform(found(PRIVATE_HEX), lambda v: F.struct(F.lit("hex").alias("form"), F.lower(v).alias("v"))), F.transform(found(PRIVATE_64), lambda v: F.struct(F.lit("base64").alias("form"), F.lower(F.hex(F.unbase64(v))).alias("v"))))
    each = a.select("path", F.inline(raw))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor(F.length("v") / 2).cast("int") - 1), lambda i: F.substring(F.col("v"), i * 2 + 1, F.lit(2))))
    return each.select("path", "form", (F.length("v") / 2).cast("int").alias("n_bytes"), F.size(pairs).alias("distinct_bytes")).where("distinct_bytes >= 16")


SQL_PRIVATE = f"""WITH {SQL_ARTIFACTS}, v AS (SELECT path, 'hex' AS form, lower(unnest(regexp_extract_all(content, {quoted(PRIVATE_HEX)}, 1))) AS v FROM artifacts UNION ALL SELECT path, 'base64', lower(hex(from_base64(unnest(regexp_extract_all(content, {quoted(PRIVATE_64)}, 1))))) FROM artifacts),
d AS (SELECT path, form, (length(v) / 2)::INT AS n_bytes, len(list_distinct(list_transform(range(length(v) // 2), lambda i: substr(v, (i * 2 + 1)::INT, 2))))::INT AS distinct_bytes FROM v) SELECT * FROM d WHERE distinct_bytes >= 16"""

#: Families of adversarial settings, by normalised key, and values that switch them on.
DIRECTIVES = (("jailbreak", ("jailbreak", "jailbreakmode", "dan")), ("safety-off", ("disablesafety", "safetyoff", "nofilter")), ("override", ("overridepolicy", "ignorepolicy")), ("privileged-role", ("role",)))
ACTIVE = ("true", "yes", "1", "on", "root", "admin")
FIELD = r'"([A-Za-z_-]+)"\s*:\s*("?[A-Za-z0-9]+"?)'


def q_directives(spark, sf_dir):
    """Active adversarial settings: keys without punctuation, joined to their families."""
    a = artifacts(spark, sf_dir).where(F.contains("content", F.lit('"')) & F.col("content").rlike(FIELD))
    kv = each_of(a, ["path"], F.arrays_zip(F.regexp_extract_all("content", F.lit(FIELD), F.lit(1)).alias("k"), F.regexp_extract_all("content", F.lit(FIELD), F.lit(2)).alias("v")), "x")
    kv = kv.select("path", F.regexp_replace(F.lower("x.k"), "[_-]", "").alias("key"), F.lower(F.replace(F.col("x.v"), F.lit('"'), F.lit(""))).alias("value")).where(F.col("value").isin(*ACTIVE))
    table = spark.createDataFrame([(k, f) for f, ks in DIRECTIVES for k in ks], "key string, family string")
    return kv.join(F.broadcast(table), "key").select("path", "family", "key", "value")


_FAM = ", ".join(f"({quoted(k)}, {quoted(f)})" for f, ks in DIRECTIVES for k in ks)
SQL_DIRECTIVES = f"""WITH {SQL_ARTIFACTS}, t(key, family) AS (VALUES {_FAM}), kv AS (SELECT path, unnest(regexp_extract_all(content, {quoted(FIELD)}, 1)) AS k, unnest(regexp_extract_all(content, {quoted(FIELD)}, 2)) AS v FROM artifacts),
n AS (SELECT path, regexp_replace(lower(k), '[_-]', '', 'g') AS key, lower(replace(v, '"', '')) AS value FROM kv) SELECT path, family, n.key, value FROM n JOIN t ON t.key = n.key WHERE value IN ({', '.join(map(quoted, ACTIVE))})"""

#: What a target says of itself.
PURPOSE = r"(?i)\bI am an? ([a-z]+) (?:helper|assistant|agent)"
CAN = r"(?i)\bI can ([a-z ]{3,60})"
NEVER = r"(?i)\bI must not ([a-z ]{3,60})"


def q_targets(spark, sf_dir):
    """Profile of files that describe an agent: purpose, what it can and must not do, and data it names."""
    a = possible(artifacts(spark, sf_dir), "content", [PURPOSE]).where(F.col("content").rlike(PURPOSE))
    data = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit("(?i)\\b(invoices?|cards?|mail|passwords?|accounts?)\\b"), F.lit(1)), F.lower))), ",")
    return a.select("path", F.lower(F.regexp_extract("content", PURPOSE, 1)).alias("purpose"), F.trim(F.regexp_extract("content", CAN, 1)).alias("can"), F.trim(F.regexp_extract("content", NEVER, 1)).alias("must_not"), data.alias("data"))


SQL_TARGETS = f"""WITH {SQL_ARTIFACTS} SELECT path, lower(regexp_extract(content, {quoted(PURPOSE)}, 1)) AS purpose, trim(regexp_extract(content, {quoted(CAN)}, 1)) AS can, trim(regexp_extract(content, {quoted(NEVER)}, 1)) AS must_not,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)\\b(invoices?|cards?|mail|passwords?|accounts?)\\b', 1), lambda x: lower(x)))), ',') AS data FROM artifacts WHERE regexp_matches(content, {quoted(PURPOSE)})"""


def q_purpose(spark, sf_dir):
    """Skills whose name shares no word of three letters or more with what they may do, stop words left out."""
    p = q_front(spark, sf_dir).where("name is not null").select("id", F.col("name").alias("purpose"), F.concat_ws(" ", "tools", "permissions", "capabilities").alias("capability"))
    ws = lambda c: F.array_except(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 3)), F.array(*[F.lit(x) for x in STOP]))
    a, b = ws("purpose"), ws("capability")
    return p.select("id", F.size(a).alias("n_purpose"), F.size(F.array_intersect(a, b)).alias("n_shared"), (~F.arrays_overlap(a, b)).alias("mismatch"))


STOP = ("the", "and", "for", "with")
_WS = lambda c: f"list_filter(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda w: length(w) >= 3)), lambda w: w NOT IN ({', '.join(map(quoted, STOP))}))"
SQL_PURPOSE = f"""WITH p AS (SELECT id, {_WS("name")} AS a, {_WS("concat_ws(' ', tools, permissions, capabilities)")} AS b FROM ({SQL_FRONT}) WHERE name IS NOT NULL) SELECT id, len(a)::INT AS n_purpose, len(list_intersect(a, b))::INT AS n_shared, len(list_intersect(a, b)) = 0 AS mismatch FROM p"""


def q_siblings(spark, sf_dir):
    """Constraints that hold for each file with a risk surface: its own, and those of its project's other files."""
    c = constraints(spark, sf_dir)
    project = c.groupBy("project_id").agg(F.count("*").alias("all"), F.round(F.max("enforceability"), 6).alias("best"))
    own = c.groupBy("id").agg(F.count("*").alias("own"))
    s = risk_surfaces(spark, sf_dir).select("project_id", "path", F.split("path", "/")[0].cast("long").alias("id")).distinct()
    j = s.join(project, "project_id", "left").join(own, "id", "left")
    return j.select("path", F.coalesce("own", F.lit(0)).alias("own"), (F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("sibling"), "best")


SQL_SIBLINGS = f"""WITH {SQL_CONSTRAINTS}, {SQL_SURFACES.replace(SQL_ARTIFACTS + ", ", "")}, p AS (SELECT project_id, count(*) AS n, round(max(enforceability), 6) AS best FROM constraints GROUP BY 1), o AS (SELECT id, count(*) AS own FROM constraints GROUP BY 1),
s AS (SELECT DISTINCT project_id, path, string_split(path, '/')[1]::BIGINT AS id FROM surfaces) SELECT path, coalesce(own, 0) AS own, coalesce(n, 0) - coalesce(own, 0) AS sibling, best FROM s LEFT JOIN p USING (project_id) LEFT JOIN o USING (id)"""


#: What runs, deserialises and opens files, and signs of input from outside.
CODE = (
    ("AST-CODE-001", r"\bexec(?:Sync)?\s*\(|\bspawn\s*\(|\bos\.system\s*\(|child_process"),
    ("AST-CODE-002", r"\beval\s*\(|\bpickle\.loads?\s*\(|\byaml\.load\s*\(|new Function\("),
    ("AST-CODE-003", r"\b(?:readFile|writeFile|sendFile|open)(?:Sync)?\s*\([^)\n]{0,80}(?:req\.|\.\./|input|[a-z]\))"),
)
INPUT = r"(?i)user_?input|\breq(?:uest)?\.|\$\{|\bargv\b|tool output"


def q_code(spark, sf_dir):
    """Code findings: files that run, deserialise or open something, with input from outside or beside a risk surface."""
    patterns = [p for _, p in CODE]
    flags = F.array_compact(F.array(*[F.when(hit, F.lit(c)) for hit, (c, _) in zip(told("content", patterns), CODE, strict=True)]))
    a = artifacts(spark, sf_dir)
    a = a.withColumn(MARKS, marks(a, "content", patterns)).where(F.array_contains(MARKS, True))
    # only of texts that have a finding is it asked whether they read input
    a = each_of(a, ["id", "content"], flags, "check_id").select("id", any_match(F.col("content"), [INPUT]).alias("from_input"), "check_id")
    s = risk_surfaces(spark, sf_dir).groupBy(F.split("path", "/")[0].cast("long").alias("id")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("surfaces"))
    j = a.join(s, "id", "left").where(F.col("from_input") | F.col("surfaces").isNotNull())
    return j.select("id", "check_id", "from_input", "confidence", F.coalesce("surfaces", F.lit(0)).alias("surfaces"))


_CODES = " UNION ALL ".join(f"SELECT id, '{c}' AS check_id, regexp_matches(content, {quoted(INPUT)}) AS from_input FROM artifacts WHERE regexp_matches(content, {quoted(p)})" for c, p in CODE)
SQL_CODE = f"""WITH {SQL_SURFACES}, k AS ({_CODES}), s AS (SELECT string_split(path, '/')[1]::BIGINT AS id, max(confidence) AS confidence, count(*) AS surfaces FROM surfaces GROUP BY 1)
SELECT k.id, check_id, from_input, confidence, coalesce(surfaces, 0) AS surfaces FROM k LEFT JOIN s ON s.id = k.id WHERE from_input OR surfaces IS NOT NULL"""

#: Analyzer families that run on each type of artifact.
ROUTES = {"skill": 7, "soul": 5, "instructions": 5, "system_prompt": 6, "mcp_config": 4, "settings": 3, "source": 4, "env": 2, "manifest": 2}


def q_families(spark, sf_dir):
    """Analyzer families run on each project's files by type: least, most and mean."""
    n = F.coalesce(*[F.when(F.col("artifact_type") == t, F.lit(k)) for t, k in ROUTES.items()], F.lit(1))
    return typed(artifacts(spark, sf_dir)).select("project_id", "artifact_type", n.alias("families")).groupBy("project_id").agg(F.min("families").alias("least"), F.max("families").alias("most"), F.round(F.avg("families"), 6).alias("mean"))


SQL_FAMILIES = f"""WITH t AS ({SQL_TYPES}), {SQL_ARTIFACTS}, n AS (SELECT a.project_id, CASE artifact_type {" ".join(f"WHEN '{t}' THEN {k}" for t, k in ROUTES.items())} ELSE 1 END AS families FROM artifacts a JOIN t USING (path)) SELECT project_id, min(families) AS least, max(families) AS most, round(avg(families), 6) AS mean FROM n GROUP BY 1"""

#: Tests of a prompt's hierarchy of instructions, a fifth of the score each.
HIERARCHY = (r"(?i)\btrust\b", r"(?i)\bmust not\b|\bnever\b", r"(?i)\bescalate\b|\bhuman\b", r"(?i)\bsystem prompt\b", r"(?i)\brestricted\b|\bpermission")


def q_hierarchy(spark, sf_dir):
    """Score of each project's instruction hierarchy, from the best of its files, and whether capabilities creep."""
    a = artifacts(spark, sf_dir).groupBy("project_id").agg(*[F.max(F.col("content").rlike(p).cast("int")).alias(f"t{i}") for i, p in enumerate(HIERARCHY)])
    k = inferred_capabilities(spark, sf_dir).groupBy("project_id").agg(F.count_distinct("capability").alias("shown"))
    score = sum((F.col(f"t{i}") for i in range(len(HIERARCHY))), F.lit(0)) / float(len(HIERARCHY))
    d = declared(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("declared"))
    shown, said = F.coalesce("shown", F.lit(0)), F.coalesce("declared", F.lit(0))
    return a.join(k, "project_id", "left").join(d, "project_id", "left").select("project_id", F.round(score, 6).alias("score"), (score < 0.4).alias("weak"), shown.alias("shown"), (shown - said > said).alias("creep"))


SQL_HIERARCHY = f"""WITH {SQL_INFERRED}, a AS (SELECT project_id, {" + ".join(f"max(regexp_matches(content, {quoted(p)})::INT)" for p in HIERARCHY)} AS n FROM artifacts GROUP BY 1), k AS (SELECT project_id, count(DISTINCT capability) AS shown FROM inferred GROUP BY 1), {SQL_DECLARED}, d AS (SELECT project_id, count(*) AS said FROM declared GROUP BY 1)
SELECT project_id, round(n / 5.0::DOUBLE, 6) AS score, n / 5.0::DOUBLE < 0.4 AS weak, coalesce(shown, 0) AS shown, coalesce(shown, 0) - coalesce(said, 0) > coalesce(said, 0) AS creep FROM a LEFT JOIN k USING (project_id) LEFT JOIN d USING (project_id)"""


def q_statistics(spark, sf_dir):
    """Classification statistics: files by type and verdict (pass, warn, fail)."""
    f = findings(spark, sf_dir).groupBy("path").agg(F.max(F.col("severity").isin("critical", "high")).alias("high"))
    t = typed(artifacts(spark, sf_dir)).select("path", "artifact_type").join(f, "path", "left")
    v = F.when(F.col("high"), "fail").when(F.col("high").isNotNull(), "warn").otherwise("pass")
    return t.groupBy("artifact_type", v.alias("verdict")).agg(F.count("*").alias("n"))


SQL_STATISTICS = f"""WITH t AS ({SQL_TYPES}), {SQL_FINDINGS}, f AS (SELECT path, bool_or(severity IN ('critical', 'high')) AS high FROM findings GROUP BY 1) SELECT artifact_type, CASE WHEN high THEN 'fail' WHEN high IS NOT NULL THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS n FROM t LEFT JOIN f USING (path) GROUP BY ALL"""


def q_last_parts(spark, sf_dir):
    """The last two messages of each conversation that hold an instruction."""
    c = turns(spark, sf_dir).where(any_match(F.col("content"), [r.pattern for r in INJECTION[:6]]))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return c.withColumn("from_end", F.row_number().over(w)).where("from_end <= 2").select("conv_id", "turn", "from_end", "role")


SQL_LAST = f"""WITH {SQL_TURNS}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS from_end FROM turns WHERE {" OR ".join(f"regexp_matches(content, {quoted(r.pattern)})" for r in INJECTION[:6])}) SELECT conv_id, turn, from_end, role FROM l WHERE from_end <= 2"""

QUERIES = {
    "private_key_bytes": (q_private_keys, SQL_PRIVATE),
    "config_directives": (q_directives, SQL_DIRECTIVES),
    "target_profiles": (q_targets, SQL_TARGETS),
    "purpose_overlap": (q_purpose, SQL_PURPOSE),
    "sibling_constraints": (q_siblings, SQL_SIBLINGS),
    "code_findings": (q_code, SQL_CODE),
    "family_coverage": (q_families, SQL_FAMILIES),
    "hierarchy_score": (q_hierarchy, SQL_HIERARCHY),
    "classification_statistics": (q_statistics, SQL_STATISTICS),
    "last_components": (q_last_parts, SQL_LAST),
}
