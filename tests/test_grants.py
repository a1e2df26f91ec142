"""Permission entries: what bounds them, tool by tool."""

from agentscan.operators import grants

#: (entry, kind, unbounded, narrower)
CASES = (
    ("Read(src/**)", "path", False, None),
    ("Read(//**)", "path", True, "Read(src/**)"),
    ("Read(**)", "path", True, "Read(src/**)"),
    ("read( ~/** )", "path", True, "read(src/**)"),
    ("Edit(**/*.md)", "path", True, "Edit(src/**/*.md)"),
    ("Write(../*.env)", "path", True, "Write(src/*.env)"),
    ("Write()", "path", True, "Write(src/**)"),
    ("Read(/etc/passwd)", "path", False, None),
    ("Read([ab]/x)", "path", True, "Read(src/[ab]/x)"),
    ("LS", "path", True, "LS(src/**)"),
    ("WebSearch", "other", False, None),
    ("Bash(git commit:*)", "command", False, None),
    ("Bash(npm run *)", "command", False, None),
    ("Bash(*)", "command", True, "Bash(npm test)"),
    ("Bash(*:*)", "command", True, "Bash(npm test)"),
    ("Bash(:x)", "command", True, "Bash(npm test)"),
    ("Bash(sudo *)", "command", True, "Bash(npm test)"),
    ("Bash(SH -c *)", "command", True, "Bash(npm test)"),
    ("Bash(sudo apt install foo)", "command", False, None),
    ("Bash(xargs dirname *)", "command", False, None),
    ("Bash(env)", "command", False, None),
    ("Bash(xargs -I {} sh -c 'echo {}')", "command", False, None),
    ("WebFetch(domain:example.com)", "domain", False, None),
    ("WebFetch(domain:*)", "domain", True, "WebFetch(domain:example.com)"),
    ("WebFetch(*.example.com)", "domain", True, "WebFetch(domain:example.com)"),
    ("Fetch(domain: )", "domain", True, "Fetch(domain:example.com)"),
    ("*", "every", True, None),
    ("***", "every", True, None),
    ("mcp__*", "server", True, None),
    ("MCP__", "server", True, None),
    ("mcp__github__*", "server", False, None),
    ("Task(*:*)", "other", True, None),
    ("Task()", "other", True, None),
    ("Task(a*)", "other", False, None),
    ("two words", "prose", False, None),
    ("Read(a) and more", "prose", False, None),
    ("", "prose", False, None),
    (None, "prose", False, None),
)


def test_entries(spark):
    df = spark.createDataFrame([(c[0], "x", "y") for c in CASES * 2], "entry string, kind string, tool string")
    out = grants.judged(df, "entry")
    assert sorted(out.columns) == ["entry", "kind", "narrower", "tool", "unbounded"]
    got = {(r.entry, r.kind, r.unbounded, r.narrower) for r in out.collect()}
    assert got == set(CASES) and out.count() == 2 * len(CASES)
    assert grants.judged(df.where("false"), "entry").count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_narrower_entries_are_bounded(spark):
    df = spark.createDataFrame([(c[3],) for c in CASES if c[3]], "entry string")
    assert not [r.entry for r in grants.judged(df, "entry").where("unbounded").collect()]


def test_very_long_entry(spark):
    df = spark.createDataFrame([("Bash(sudo " + "-x " * 300_000 + "*)",)], "entry string")
    assert grants.judged(df, "entry").first().unbounded
