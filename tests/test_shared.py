"""Marks made once for all detectors of the findings store."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agentscan.functions.held import flags, marks
from agentscan.functions.needed import formula, plain
from agentscan.operators import evidence, hidden, profiles, scoring, secrets, static, store, structure, subjects, text
from agentscan.sources import derived

SF = "/root/testdata/sf0.001"
DETECTORS = (
    *(scoring.scan_findings, scoring.instruction_findings, static.q_absence, static.q_combinations, evidence.risk_surfaces, evidence.q_harvest, secrets.secrets, structure.q_code),
    *(structure.q_targets, text.inferred_capabilities, text.q_instruction_files, profiles.constraints, profiles.declared, profiles.q_intent, hidden.q_invisible, hidden.q_homoglyphs, subjects.q_data_access),
)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def once(spark):
    with derived.marked_artifacts(spark, SF, store.ASKED) as a:
        yield a


def test_detectors_read_marks_and_make_none(spark, once):
    """Each detector sent all texts through Python, some thirty times for one store."""
    assert [d.__name__ for d in DETECTORS if "ArrowEvalPython" in _plan(d(spark, SF))] == []


def test_rows_are_the_same_on_marks(spark):
    def rows(d):
        return sorted(map(str, d(spark, SF).collect()))

    some = (secrets.secrets, structure.q_code, hidden.q_homoglyphs, subjects.q_data_access, static.q_absence)
    alone = [rows(d) for d in some]
    with derived.marked_artifacts(spark, SF, store.ASKED):
        assert [rows(d) for d in some] == alone
    assert "__shared" not in derived.artifacts(spark, SF).columns


def test_no_match_is_without_its_mark(spark, once):
    every = [p for p in store.ASKED if isinstance(p, str)]
    hit = F.array(*[F.col("content").rlike(p) for p in every])
    both = once.select("content", marks(once, "content", every).alias("may"), hit.alias("hit")).collect()
    assert [(p, r.content) for r in both for p, m, h in zip(every, r.may, r.hit, strict=True) if h and not m] == []
    assert sum(map(sum, (r.hit for r in both))) > 500


def test_alternatives_need_all_of_their_own_literals():
    pattern = r"(?i)always\s+execute|full\s+access|x(?:abc|def)+"
    texts = ["ALWAYS  execute", "access always", "full of access", "xabc", "execute", None, "xdef full"]
    assert flags(pa.array(texts), (pattern,))[:, 0].tolist() == [True, False, True, True, False, False, True]
    assert flags(pa.array(texts), (("full", "xabc"),))[:, 0].tolist() == [False, False, True, True, False, False, True]
    assert formula("a|bcd") == formula("(") == formula("(?=abc)") == ()


def test_formulas_of_all_patterns_hold_where_they_match():
    signals = pa.array(derived.SIGNALS)
    every = [p for p in store.ASKED if isinstance(p, str) and "(?m:" not in p and "\\x{" not in p]
    told = flags(signals, tuple(every))
    assert [(p, s) for i, p in enumerate(every) for j, s in enumerate(derived.SIGNALS) if re.search(p, s) and not told[j, i]] == []


def test_found_arrays_are_made_once(spark):
    """An inner generator filters by the size of its array first, so every pattern was tried twice."""
    for d in (static.q_absence, structure.q_code, text.q_instruction_files, profiles.declared):
        assert "(size(" not in _plan(d(spark, SF)), d.__name__


def test_what_several_detectors_read_is_found_once(spark):
    """Surfaces, capabilities and front matter were looked for again by each detector that reads them."""
    several = (evidence.risk_surfaces, text.inferred_capabilities, evidence.q_front)
    alone = [sorted(map(str, d(spark, SF).collect())) for d in several]
    with derived.marked_artifacts(spark, SF, store.ASKED):
        first = [d(spark, SF) for d in several]
        assert [a.inputFiles() == d(spark, SF).inputFiles() for a, d in zip(first, several, strict=True)] == [True] * 3
        assert [a.inputFiles() != derived.artifacts(spark, SF).inputFiles() for a in first[:2]] == [True] * 2
        assert not any("regexp" in _plan(d(spark, SF)).lower() or "arrow" in _plan(d(spark, SF)).lower() for d in several)
        assert [sorted(map(str, d(spark, SF).collect())) for d in several] == alone
    assert not derived._ONCE


def test_plain_literals_need_no_second_search(spark):
    """Java looked again for literals that a text's marks had told of already."""
    assert [p for p in ("(?i)api_key|token", "(?i)password") if not plain(p)] == []
    # a shared beginning, a border, a case, a short word and a class tell less than a match
    assert [p for p in ("(?i)secret|sensitive", r"(?i)\bagent\b", "token", "(?i)ab", "(?i)a.c|token", "(?i)[ab]cd", "(?i)") if plain(p)] == []
    every = [p for p in store.ASKED if isinstance(p, str) and plain(p)]
    assert len(every) > 20
    texts = spark.createDataFrame([(w,) for p in every for w in (p[4:].split("|")[0].upper(), p[4:].split("|")[-1] + "x", p[5:])] + [(None,), ("Kelvin toKen",)], "content string")
    both = texts.select(marks(texts, "content", every).alias("may"), F.array(*[F.coalesce(F.col("content").rlike(p), F.lit(False)) for p in every]).alias("hit")).collect()
    assert [r for r in both if r.may != r.hit] == []
