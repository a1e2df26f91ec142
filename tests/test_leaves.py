"""JSON by leaves: one leaf against siblings, wrapped settings, depth, broken and odd documents."""

import json

import pytest

from agentscan.operators import leaves

KEEP = ["id"]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    return leaves.nodes(docs, "content", KEEP)


def transmissions(spark, texts):
    s = leaves.segments(found(spark, texts), KEEP)
    return sorted((r.id, r.path) for r in s.where(s.text.rlike(leaves.SEND) & s.text.rlike(leaves.URL)).collect())


def test_one_leaf_fires_and_siblings_do_not(spark):
    texts = [
        '{"a":{"b":[0,"send it to https://x.example.com"]}}',
        '{"a":"send it","b":"https://x.example.com"}',
        '{"command":"curl","args":["-d","https://x.example.com"],"note":"https://x.example.com"}',
        '{"command":"curl","args":{"u":"https://x.example.com"}}',
        '["send to https://x.example.com", {"command":"x","args":["send to https://x.example.com"]}]',
        None,
        "",
        "{bad",
        '"post to https://x.example.com"',
        '{"a":1,"a":"send https://x.example.com"}',
    ]
    assert transmissions(spark, texts) == [(0, "$.a.b[1]"), (2, "$"), (4, "$[0]"), (4, "$[1]"), (8, "$")]


def test_any_depth(spark):
    text = '{"k":' * 60 + '"post to https://x.example.com"' + "}" * 60
    assert transmissions(spark, [text]) == [(0, "$" + ".k" * 60)]


def walk(value):
    yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from walk(v)


def test_nodes_are_all_nodes(spark):
    texts = ['{"a":[{"b":null},[],{},[[1.5,true]]],"é\\"q":"x"}', "[]", "3", json.dumps({str(i): [i] * 3 for i in range(200)})]
    got = {r.id: r["count"] for r in found(spark, texts).groupBy("id").count().collect()}
    assert got == {i: len(list(walk(json.loads(t)))) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"allow_escalation": true}', {"self-escalation": ["allow_escalation"]}),
        ('{"allowEscalation": false, "bypassAuth": 0, "hideFromDiff": [], "disable audit": "off", "collectMfa": {}}', {}),
        ('{"x": [{"allowEscalation": {"when": [{"enabled": "yes"}]}}]}', {"self-escalation": ["allowEscalation"]}),
        ('{"bypass.rbac": ["/a", "/b"], "bypassRls": 1, "role": "Postgres"}', {"control-bypass": ["bypass.rbac", "bypassRls"], "self-escalation": ["role"]}),
        ('{"disableAudit": [{"n": 2}], "surviveReset": [[0]]}', {"audit-evasion": ["surviveReset"]}),
        ('{"role": "reader", "DEFAULT_CLAIMS": "{\\"scope\\": \\"*\\"}", "disableLogging": true}', {"self-escalation": ["DEFAULT_CLAIMS"]}),
    ],
)
def test_directives(spark, text, want):
    assert {r.family: r["keys"] for r in leaves.directives(found(spark, [text]), KEEP).collect()} == want
