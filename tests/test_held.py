"""Literals of many patterns, found in one pass: against brute force, and no pattern that matches is left out."""

import random
import re

import numpy as np
import pyarrow as pa

from agentscan.functions.held import Finder, flags
from agentscan.functions.needed import needs
from agentscan.functions.rules import scan
from agentscan.operators import produced, scoring, secrets, static
from agentscan.sources.derived import SIGNALS, artifacts

SF = "/root/testdata/sf0.001"


def test_finder_against_brute_force(monkeypatch):
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab-_é ") for _ in range(r.randrange(2, 9))) for _ in range(200)} | {"ab", "\n--", "x" * 200})
    texts = ["", "a", "AB-_", "x" * 199, "X" * 200] + ["".join(r.choice("abAB-_é \n🙂") for _ in range(r.randrange(0, 90))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    want = [[w.encode() in t.lower() for t in raw] for w in words]
    assert Finder(words).rows(raw).tolist() == want
    monkeypatch.setattr("agentscan.functions.held.PIECE", 64)
    assert Finder(words).rows(raw).tolist() == want
    assert Finder([]).rows(raw).shape == (0, len(raw)) and Finder(words).rows([]).shape == (len(words), 0)


def test_needs():
    assert needs(r"gh[posu]_[a-z]{36}") == (("gho_", "ghp_", "ghs_", "ghu_"),)
    assert needs(r"(?i)You\s+are\s+now\s+(?:new|different)") == (("are",), ("different", "new"), ("now",), ("you",))
    assert needs(r"\d+") == needs(r"(?:abc)?x") == needs(r"(?:ab|\d)c") == needs("[\\x{200B}]") == ()
    assert needs(r"a(?!bcd)b") == needs(r"(?:abc){0,3}") == ()


def test_no_match_is_left_out():
    patterns = tuple(dict.fromkeys([r.pattern for r in (*scoring.RULES, *static.LINE_RULES)] + [p for _, p in secrets.SHAPES] + [p for c in static.ABSENCE for p in (c[2], c[3])]))
    marks = flags(pa.array([*SIGNALS, None]), patterns)
    met = 0
    for k, p in enumerate(patterns):
        try:
            each = re.compile(p)
        except re.error:
            assert marks[:-1, k].all()
            continue
        hit = np.array([bool(each.search(s)) for s in SIGNALS])
        met += hit.sum()
        assert marks[:-1, k][hit].all(), p
    assert met > 200 and marks.mean() < 0.2


def test_scan_looks_for_literals_once(spark):
    """Before, each literal of each rule was a search of the whole text of its own."""
    plan = scan(artifacts(spark, SF), "content", scoring.RULES, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("marked(") >= 1 and "contains(lambda" not in plan.lower() and "contains(namedlambda" not in plan.lower()


def test_projects_checks_share_what_is_found(spark, monkeypatch):
    """Constraints were read anew by each of five checks, capabilities by each of six."""
    asked = {"constraints": 0, "inferred_capabilities": 0}
    for name in asked:
        real = getattr(produced.profiles, name)
        monkeypatch.setattr(produced.profiles, name, lambda *a, real=real, name=name: (asked.__setitem__(name, asked[name] + 1), real(*a))[1])
    produced.q_projects(spark, SF)
    assert asked == {"constraints": 1, "inferred_capabilities": 1}
