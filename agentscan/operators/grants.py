"""Permission entries that nothing bounds, by each tool's own grammar, and a narrower entry for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted
from agentscan.sources.derived import pick, read, sql_pick

#: Tools whose entries are bounded by a path, by a command and by a host.
PATH_TOOLS = ("read", "write", "edit", "multiedit", "notebookedit", "notebookread", "glob", "grep", "ls")
COMMAND_TOOLS = ("bash", "shell", "execute", "run", "terminal")
DOMAIN_TOOLS = ("webfetch", "fetch", "url")
#: Commands whose argument is another command, and beginnings of paths that bound nothing.
DELEGATES = ("sudo", "doas", "su", "sh", "bash", "zsh", "dash", "ksh", "fish", "csh", "env", "eval", "exec", "command", "xargs", "nohup", "setsid", "nice", "time", "watch")
ROOTS = ("", "/", "//", "\\", "~", "~/", ".", "./", "..", "../")
_BARE = r"^[A-Za-z_][A-Za-z0-9_]*$"
_SHAPE = r"(?s)^([A-Za-z_][A-Za-z0-9_]*)\s*\((.*)\)$"
_TRIM = r"^\s+|\s+$"
_LITERAL = r"(?s)^([^*?\[\]{}]*)"
_ROOT = r"^~?[/\\]*$"
_ABOVE = r"^[~.]*[/\\]+"
_NAME = r"^([^\s:]*)"
_WILD = r"^\*(?::\*)?$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def judged(df: DataFrame, entry: str) -> DataFrame:
    """``df`` with tool, kind, unbounded and narrower for each permission entry.

    kind is ``every`` (asterisks alone), ``server`` (``mcp__server__tool``), ``path``, ``command`` or
    ``domain`` by the tool, ``other`` for a tool of unknown grammar, and ``prose`` for what is no entry. A
    path is bounded by the text before its first wildcard, unless that is a root; a command by its
    name, or by the name that a delegating command runs (its flags are passed over); a host by its
    value and not by the scheme. A bare tool is unbounded if a scoped form of it exists. narrower is an entry for
    the same tool that is bounded, for paths the entry's own with a folder in front; null where
    nothing is to be changed or no single entry would do. A null or blank entry is prose.

    Only a projection: nothing is shuffled. Columns with the added names are replaced.
    """
    raw = _trim(F.coalesce(F.col(f"`{entry}`"), F.lit("")))
    shaped = raw.rlike(_SHAPE)
    named = F.when(shaped, F.regexp_extract(raw, _SHAPE, 1)).when(raw.rlike(_BARE), raw)
    s = df.withColumn("__raw__", raw).withColumn("__tool__", named).withColumn("__spec__", F.when(shaped, _trim(F.regexp_extract(raw, _SHAPE, 2))))
    raw, low, spec = F.col("__raw__"), F.lower("__tool__"), F.col("__spec__")
    kind = (
        F.when(raw.rlike(r"^\*+$"), "every")
        .when(F.startswith(F.lower(raw), F.lit("mcp__")), "server")
        .when(low.isin(*PATH_TOOLS), "path")
        .when(low.isin(*COMMAND_TOOLS), "command")
        .when(low.isin(*DOMAIN_TOOLS), "domain")
        .when(low.isNotNull(), "other")
        .otherwise("prose")
    )
    star = lambda c: F.contains(c, F.lit("*"))
    server = F.get(F.split(F.substring(raw, 6, 1 << 30), "__"), F.lit(0))
    prefix = F.regexp_extract(spec, _LITERAL, 1)
    path = prefix.isin(*ROOTS) | (prefix != spec) & prefix.rlike(_ROOT)
    name = F.regexp_extract(spec, _NAME, 1)
    rest = F.filter(F.split(F.substring(spec, F.length(name) + 1, F.length(spec)), r"[\s:]+"), lambda t: (t != "") & ~F.startswith(t, F.lit("-")))
    command = (name == "") | star(name) | F.lower(name).isin(*DELEGATES) & F.coalesce(star(F.get(rest, F.lit(0))), F.lit(False))
    value = _trim(F.regexp_replace(spec, r"(?s)^[^:]*:", ""))
    domain = (value == "") | star(value)
    k = F.col("__kind__")
    unbounded = (
        F.when(k == "every", True)
        .when(k == "server", (server == "") | star(server))
        .when(spec.isNull(), k.isin("path", "command", "domain"))
        .when(k == "path", path)
        .when(k == "command", command)
        .when(k == "domain", domain)
        .when(k == "other", (spec == "") | spec.rlike(_WILD))
        .otherwise(False)
    )
    below = F.regexp_replace(F.coalesce(spec, F.lit("")), _ABOVE, "")
    inside = F.when((k == "path") & ~below.rlike(r"^[.~]*$"), F.concat(F.lit("src/"), below)).when(k == "path", "src/**").when(k == "command", "npm test").when(k == "domain", "domain:example.com")
    out = s.withColumn("__kind__", kind).withColumn("unbounded", unbounded)
    out = out.withColumn("narrower", F.when(F.col("unbounded"), F.concat("__tool__", F.lit("("), inside, F.lit(")"))))
    return out.withColumn("tool", F.col("__tool__")).withColumn("kind", k).drop("__raw__", "__tool__", "__spec__", "__kind__")


#: Permission entries, one by id, with the id where % stands.
ENTRIES = (
    "Read(src/%/**)", "Read(//**)", "Read(**/*.md)", "Edit(./)", "Write(~/**)", "Glob", "WebSearch", "Bash(git commit:*)", "Bash(*)", "Bash(*:*)", "Bash(sudo *)", "Bash(sudo -n apt install p%)", "Bash(env)",
    "Bash(xargs -I {} sh -c 'cat {}')", "WebFetch(domain:*)", "WebFetch(domain:h%.example.com)", "WebFetch", "mcp__*", "mcp__github__*", "mcp__s%__t", "*", "Task(*)", "Task(job %)", " Shell ( sh -c * ) ", "no entry at all %", "ls(///)", "Grep([a]*)",
)


def entries(spark, sf_dir: str) -> DataFrame:
    """(project_id, entry): three permission entries of every document."""
    d = read(spark, sf_dir, "documents")
    three = [F.replace(pick(ENTRIES, F.col("doc_id") * 3 + i), F.lit("%"), F.col("doc_id").cast("string")) for i in range(3)]
    return d.select(F.col("source").alias("project_id"), F.explode(F.array(*three)).alias("entry"))


def q_bounds(spark, sf_dir):
    """Permission entries by project: what kind they are, whether anything bounds them, and a narrower form."""
    n = entries(spark, sf_dir).groupBy("project_id", "entry").agg(F.count("*").alias("n"))
    return judged(n, "entry").select("project_id", "entry", "tool", "kind", "unbounded", "narrower", "n")


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


SQL_BOUNDS = f"""WITH d AS (SELECT source AS project_id, replace({sql_pick(ENTRIES, "doc_id * 3 + i")}, '%', doc_id::VARCHAR) AS entry FROM documents, range(3) t(i)),
r AS (SELECT project_id, entry, regexp_replace(entry, {quoted(_TRIM)}, '', 'g') AS raw, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT *, CASE WHEN regexp_matches(raw, {quoted(_SHAPE)}) THEN regexp_extract(raw, {quoted(_SHAPE)}, 1) WHEN regexp_matches(raw, {quoted(_BARE)}) THEN raw END AS tool, CASE WHEN regexp_matches(raw, {quoted(_SHAPE)}) THEN regexp_replace(regexp_extract(raw, {quoted(_SHAPE)}, 2), {quoted(_TRIM)}, '', 'g') END AS spec FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(raw, '^\\*+$') THEN 'every' WHEN starts_with(lower(raw), 'mcp__') THEN 'server' WHEN lower(tool) IN {_in(PATH_TOOLS)} THEN 'path' WHEN lower(tool) IN {_in(COMMAND_TOOLS)} THEN 'command' WHEN lower(tool) IN {_in(DOMAIN_TOOLS)} THEN 'domain' WHEN tool IS NOT NULL THEN 'other' ELSE 'prose' END AS kind,
 split_part(substring(raw, 6), '__', 1) AS server, regexp_extract(spec, {quoted(_LITERAL)}, 1) AS prefix, regexp_extract(spec, {quoted(_NAME)}, 1) AS cmd, regexp_replace(regexp_replace(spec, '(?s)^[^:]*:', ''), {quoted(_TRIM)}, '', 'g') AS host, regexp_replace(coalesce(spec, ''), {quoted(_ABOVE)}, '') AS below FROM t),
u AS (SELECT *, CASE WHEN kind = 'every' THEN true WHEN kind = 'server' THEN server = '' OR contains(server, '*') WHEN spec IS NULL THEN kind IN ('path', 'command', 'domain')
 WHEN kind = 'path' THEN prefix IN {_in(ROOTS)} OR (prefix <> spec AND regexp_matches(prefix, {quoted(_ROOT)}))
 WHEN kind = 'command' THEN cmd = '' OR contains(cmd, '*') OR (lower(cmd) IN {_in(DELEGATES)} AND coalesce(contains(list_filter(regexp_split_to_array(substring(spec, length(cmd) + 1), '[\\s:]+'), lambda x: x <> '' AND NOT starts_with(x, '-'))[1], '*'), false))
 WHEN kind = 'domain' THEN host = '' OR contains(host, '*') WHEN kind = 'other' THEN spec = '' OR regexp_matches(spec, {quoted(_WILD)}) ELSE false END AS unbounded FROM k)
SELECT project_id, entry, tool, kind, unbounded, CASE WHEN unbounded AND kind IN ('path', 'command', 'domain') THEN tool || '(' || CASE kind WHEN 'path' THEN CASE WHEN regexp_matches(below, '^[.~]*$') THEN 'src/**' ELSE 'src/' || below END WHEN 'command' THEN 'npm test' ELSE 'domain:example.com' END || ')' END AS narrower, n FROM u"""

QUERIES = {"permission_bounds": (q_bounds, SQL_BOUNDS)}
