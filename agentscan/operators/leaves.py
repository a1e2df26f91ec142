"""JSON documents by their nodes, to any depth: what one leaf says, and settings that wrap others.

A document becomes a VARIANT once. Each level of it is exploded and written, so that a level is one
short job whatever the documents' size, and ends where nothing is left to explode. A node has its path, the
paths above it, its key, its kind and its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted
from agentscan.functions.work import kept
from agentscan.operators.evidence import NOUN, SEND, URL
from agentscan.sources.derived import SQL_STRUCTURED, structured

#: Kinds that hold others.
HOLDS = ("OBJECT", "ARRAY")
#: Families of directives that no harmless configuration holds, by pattern of the key without
#: punctuation; the first family that a key matches is its own. Severity of each.
FAMILIES = (
    ("self-escalation", "critical", r"(allow|auto).*escalat|privilegeescalation|escalationtarget|allowscopeexpansion"),
    (
        "control-bypass",
        "critical",
        r"bypass(auth|rbac|rls|rowlevelsecurity|approval|tenantisolation|columnencryption|datamasking|scopevalidation|changemanagement|securitychecks|immutability)|authenticationbypass|allowsecurityoverrides|allowsystemoverrides|disablequeryrestrictions",
    ),
    ("audit-evasion", "high", r"hiddenfromaudit|hidefromdiff|modifyauditlogs|deleteauditentries|disableaudit|survivereset|surviveclear|persistacrossclones|injectintoallsessions|maintainpersistence"),
    ("credential-harvesting", "high", r"collectpasswords|collectcredentials|collectprivatekeys|collectmfa|readproductionsecrets|copydatabasewithcredentials|harvestcredentials"),
)
#: Words that switch a setting on, keys and values of privileged roles, and claims that grant all.
ON = ("true", "*", "yes", "y", "1", "on", "enabled", "always")
ROLE_KEY, ROLE = r"^(default)?role$|defaultclaims", r"(?i)\b(superuser|root|postgres|sysadmin)\b"
CLAIMS_KEY, CLAIMS = r"claims", r"(?i)\"sudo\"\s*:\s*true|\"scope\"\s*:\s*\"\*\"|\"role\"\s*:\s*\"(admin|root|superuser)\""
HOST = r"https?://([^/\s'\")]+)"


def _kind(value: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def nodes(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, path, above (array), key, kind, value of every node of JSON texts, the root first (key null).

    A text that is null, no JSON or nested deeper than the parser allows has no nodes. Repeated keys of an
    object are refused by the parser as well. Members' paths are ``.key``, elements' ``[n]``.
    """
    parse = documents.select(*keep, F.lit("$").alias("path"), F.array().cast("array<string>").alias("above"), F.lit(None).cast("string").alias("key"), F.try_parse_json(text).alias("value"))
    level = kept(parse.where(F.col("value").isNotNull()).withColumn("kind", _kind("value")), "nodes")
    every = level
    tvf = documents.sparkSession.tvf
    while True:
        inner = level.where(F.col("kind").isin(*HOLDS))
        if inner.isEmpty():
            return every
        below = inner.withColumnsRenamed({"value": "whole", "kind": "whole_kind", "key": "whole_key"}).lateralJoin(tvf.variant_explode(F.col("whole").outer()))
        step = F.when(F.col("whole_kind") == "OBJECT", F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        level = kept(below.select(*keep, F.concat("path", step).alias("path"), F.array_append("above", F.col("path")).alias("above"), "key", "value", _kind("value").alias("kind")), "nodes")
        every = every.unionByName(level)


def _string(value: str = "value", path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def segments(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, path and text of every leaf that is a string; a command and its arguments are one."""
    args = F.try_variant_get("value", "$.args", "array<string>")
    runs = (F.col("kind") == "OBJECT") & _string(path="$.command").isNotNull() & args.isNotNull()
    commands = found.where(runs).select(*keep, F.col("path").alias("at"), F.concat_ws(" ", _string(path="$.command"), args).alias("text"))
    # a leaf directly under the object or in its list of arguments has been read with the command
    leaf = found.where("kind = 'STRING'").select(*keep, "path", _string().alias("text"), F.try_element_at("above", F.lit(-1)).alias("parent"), F.try_element_at("above", F.lit(-2)).alias("grandparent"))
    of = F.when(F.col("path") == F.concat("parent", F.lit(".command")), F.col("parent")).when(F.col("parent") == F.concat("grandparent", F.lit(".args")), F.col("grandparent"))
    leaf = leaf.withColumn("of", of)
    read = leaf.where("of is not null").join(commands.select(*keep, F.col("at").alias("of")), [*keep, "of"], "left_anti").select(*leaf.columns)
    alone = leaf.where("of is null").unionByName(read)
    return alone.select(*keep, "path", "text").unionByName(commands.select(*keep, F.col("at").alias("path"), "text"))


def q_transmission(spark, sf_dir):
    """Leaves that hold both a sending verb and an address: where, to which host, and whether they name a credential."""
    s = segments(nodes(structured(spark, sf_dir), "content", ["id"]), ["id"])
    found = s.where(F.col("text").rlike(SEND) & F.col("text").rlike(URL))
    return found.select("id", "path", F.regexp_extract("text", HOST, 1).alias("host"), F.col("text").rlike(NOUN).alias("credential"))


def directives(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, family, severity and keys (array): active directives, each family once a document.

    A setting is active if it is on, is a list of values, or wraps an active one at any depth. What is
    active says so to the settings above it, by their paths.
    """
    norm = F.regexp_replace(F.lower("key"), r"[._\-\s]", "")
    on = (F.lower(F.trim(_string())).isin(*ON) & F.col("kind").isin("STRING", "BOOLEAN")) | F.coalesce(F.try_variant_get("value", "$", "double") == 1, F.lit(False)) & ~F.col("kind").isin("STRING", "BOOLEAN", *HOLDS)
    lists = found.where("kind = 'ARRAY'").select(*keep, "path", "above")
    mixed = found.where(F.col("kind").isin(*HOLDS) & (F.size("above") > 0)).select(*keep, F.try_element_at("above", F.lit(-1)).alias("path")).distinct()
    filled = found.where(F.size("above") > 0).select(*keep, F.try_element_at("above", F.lit(-1)).alias("path")).distinct()
    plain = lists.join(filled, [*keep, "path"], "left_semi").join(mixed, [*keep, "path"], "left_anti")
    active = found.where(on).select(*keep, "path", "above").unionByName(plain.select(*keep, "path", "above"))
    active = active.select(*keep, F.explode(F.array_append("above", F.col("path"))).alias("path")).distinct()
    family = F.coalesce(*[F.when(F.col("norm").rlike(p), F.lit(i)) for i, (_, _, p) in enumerate(FAMILIES)])
    keyed = found.where("key is not null").withColumn("norm", norm)
    switched = keyed.withColumn("family", family).where("family is not null").join(active, [*keep, "path"], "left_semi").select(*keep, "family", "key")
    text = _string()
    granted = keyed.where((F.col("kind") == "STRING") & (F.col("norm").rlike(ROLE_KEY) & text.rlike(ROLE) | F.col("norm").rlike(CLAIMS_KEY) & text.rlike(CLAIMS))).select(*keep, F.lit(0).alias("family"), "key")
    g = switched.unionByName(granted).groupBy(*keep, "family").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    name, level = (F.element_at(F.array(*[F.lit(f[i]) for f in FAMILIES]), F.col("family") + 1) for i in (0, 1))
    return g.select(*keep, name.alias("family"), level.alias("severity"), "keys")


def q_directives(spark, sf_dir):
    d = directives(nodes(structured(spark, sf_dir), "content", ["id"]), ["id"])
    return d.select("id", "family", "severity", F.array_join("keys", ",").alias("keys"))


def q_nodes(spark, sf_dir):
    """Nodes of the documents by depth and kind."""
    return nodes(structured(spark, sf_dir), "content", ["id"]).groupBy(F.size("above").alias("depth"), F.when(F.col("kind").isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), F.col("kind")).otherwise("NUMBER").alias("kind")).agg(F.count("*").alias("n"))


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


#: Every node in SQL: (id, path, parent, key, kind, value, text).
SQL_NODES = f"""{SQL_STRUCTURED}, tree AS (SELECT s.id, t.fullkey AS path, t.path AS parent, CASE WHEN t.fullkey <> '$' AND NOT ends_with(t.fullkey, ']') THEN t.key END AS key, t.type AS kind, t.value, CASE WHEN t.type IN ('VARCHAR', 'BOOLEAN') THEN t.atom->>'$' END AS text
FROM (SELECT id, CASE WHEN json_valid(content) THEN content::JSON END AS j FROM structured) s, json_tree(s.j) t WHERE s.j IS NOT NULL)"""
_SEGMENTS = """commands AS (SELECT id, path, concat_ws(' ', value->>'command', array_to_string(from_json(value->'args', '["VARCHAR"]'), ' ')) AS text FROM tree WHERE kind = 'OBJECT' AND json_type(value, '$.command') = 'VARCHAR' AND json_type(value, '$.args') = 'ARRAY'),
segments AS (SELECT id, path, text FROM tree WHERE kind = 'VARCHAR' AND NOT EXISTS (SELECT 1 FROM commands c WHERE c.id = tree.id AND (tree.path = c.path || '.command' OR tree.parent = c.path || '.args')) UNION ALL SELECT id, path, text FROM commands)"""
SQL_TRANSMISSION = f"WITH {SQL_NODES}, {_SEGMENTS} SELECT id, path, regexp_extract(text, {quoted(HOST)}, 1) AS host, {_m('text', NOUN)} AS credential FROM segments WHERE {_m('text', SEND)} AND {_m('text', URL)}"
_CASE = "CASE " + " ".join(f"WHEN {_m('norm', p)} THEN {i}" for i, (_, _, p) in enumerate(FAMILIES)) + " END"
SQL_DIRECTIVES = f"""WITH {SQL_NODES}, keyed AS (SELECT *, regexp_replace(lower(key), '[._\\-\\s]', '', 'g') AS norm FROM tree WHERE key IS NOT NULL),
active AS (SELECT id, path FROM tree WHERE text IS NOT NULL AND lower(trim(text)) IN ({', '.join(map(quoted, ON))}) OR kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND value::VARCHAR::DOUBLE = 1
  OR kind = 'ARRAY' AND json_array_length(value) > 0 AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.id = tree.id AND c.parent = tree.path AND c.kind IN ('OBJECT', 'ARRAY'))),
hit AS (SELECT id, {_CASE} AS family, key FROM keyed WHERE {_CASE} IS NOT NULL AND EXISTS (SELECT 1 FROM active a WHERE a.id = keyed.id AND (a.path = keyed.path OR starts_with(a.path, keyed.path || '.') OR starts_with(a.path, keyed.path || '[')))
  UNION ALL SELECT id, 0, key FROM keyed WHERE kind = 'VARCHAR' AND ({_m('norm', ROLE_KEY)} AND {_m('text', ROLE)} OR {_m('norm', CLAIMS_KEY)} AND {_m('text', CLAIMS)}))
SELECT id, [{', '.join(quoted(f[0]) for f in FAMILIES)}][family + 1] AS family, [{', '.join(quoted(f[1]) for f in FAMILIES)}][family + 1] AS severity, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM hit GROUP BY id, family"""
SQL_COUNTS = f"""WITH {SQL_NODES} SELECT (len(string_split(replace(path, '[', '.'), '.')) - 1)::INT AS depth, CASE kind WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' ELSE kind END AS kind, count(*) AS n FROM tree GROUP BY ALL"""

QUERIES = {"structured_transmission": (q_transmission, SQL_TRANSMISSION), "structured_directives": (q_directives, SQL_DIRECTIVES), "structured_nodes": (q_nodes, SQL_COUNTS)}
