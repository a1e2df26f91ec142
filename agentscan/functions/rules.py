"""Rules as one array-of-struct column: every text is scanned once, whatever the number of rules.

A rule is data: an id, a severity, a pattern, an optional pattern that excuses a hit and one that paths
must have. Patterns keep to what Java's and RE2's expressions share, so that the same rule runs in
Spark and in SQL oracles. A pattern is tried only on texts that hold one of its literals, which are read
from the pattern itself; this test runs on a text lowered once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.held import marks as made
from agentscan.functions.needed import plain


#: The column of marks of rules that may match.
MARKS = "__may"


class Rule(NamedTuple):
    check_id: str
    severity: str
    pattern: str
    name: str = ""
    exclude: str | None = None
    path: str | None = None


@functools.cache
def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every match of a pattern holds one; none if that can't be told.

    Of a sequence the part with the longest literals is chosen, of alternatives all are needed. What may
    be left out, classes of characters and look-around give none.
    """
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return ()
    return tuple(sorted(_needed(tree) or ()))


def _needed(tree) -> set[str] | None:
    best: set[str] | None = None
    run = ""

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) > (min(map(len, best)) if best else 1) and len(found) <= 40:
            best = found

    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        offer({run} if run else None)
        run = ""
        if kind == "SUBPATTERN":
            offer(_needed(arg[-1]))
        elif kind == "BRANCH":
            parts = [_needed(x) for x in arg[1]]
            offer(set().union(*parts) if all(parts) else None)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            offer(_needed(arg[2]))
    offer({run} if run else None)
    return best


def holds(text: Column, low: Column, pattern: str) -> Column:
    """Whether a text matches; ``low`` is the text in lower case."""
    found = text.rlike(pattern)
    if words := literals(pattern):
        some = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            some = some | F.contains(low, F.lit(w))
        found = some & found
    return found


def lowered(text: Column, use) -> Column:
    """``use(low)`` of a text's lower-case form, which is made once: the lambda's variable holds it."""
    return F.transform(F.array(F.lower(text)), use)[0]


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    """Whether a text matches some pattern."""

    def some(low: Column) -> Column:
        out = None
        for p in patterns:
            out = holds(text, low, p) if out is None else out | holds(text, low, p)
        return out

    return F.coalesce(lowered(text, some), F.lit(False))


def literal(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _may(low: str, pattern: str) -> str:
    """Whether a text in lower case holds one of a pattern's literals, in Spark SQL."""
    return "(" + " OR ".join(f"contains({low}, {literal(w)})" for w in literals(pattern)) + ")" if literals(pattern) else "true"


def some_match(text: str, patterns: Iterable[str]) -> Column:
    """``any_match`` of a column by name, as one expression: many patterns cost no more to plan than one."""
    each = " OR ".join(f"({_may('t.low', p)} AND t.own RLIKE {literal(p)})" for p in patterns)
    return F.expr(f"coalesce(transform(array(named_struct('low', lower(`{text}`), 'own', `{text}`)), t -> {each})[0], false)")


def which(text: str, patterns: list[str], marks: str | None = None) -> Column:
    """Numbers of the patterns that a text matches; ``marks`` is a column that says which of them may (``held.may``)."""
    tried = lambda p: "" if marks and plain(p) else f" AND t.own RLIKE {literal(p)}"
    each = ", ".join(f"CASE WHEN {f't.may[{i}]' if marks else _may('t.low', p)}{tried(p)} THEN {i} END" for i, p in enumerate(patterns))
    first = f"'may', `{marks}`" if marks else f"'low', lower(`{text}`)"
    return F.expr(f"transform(array(named_struct({first}, 'own', `{text}`)), t -> filter(array({each}), x -> x IS NOT NULL))[0]")


def possible(df: DataFrame, text: str, patterns: Iterable[str], every: bool = False) -> DataFrame:
    """The rows whose text may match one of the patterns (or each of them) by the literals that it holds; a match itself is still to be seen."""
    marks = df.withColumn(MARKS, made(df, text, tuple(dict.fromkeys(patterns))))
    return marks.where(~F.array_contains(MARKS, False) if every else F.array_contains(MARKS, True)).drop(MARKS)


def told(text: str, patterns: list[str], marks: str = MARKS) -> list[Column]:
    """For each pattern whether a text matches it; ``marks`` is a column of ``may`` for the same patterns."""
    return [F.when(F.col(marks)[i], F.lit(True) if plain(p) else F.col(text).rlike(p)).otherwise(False) for i, p in enumerate(patterns)]


def _is_hit(text: str, r: Rule) -> str:
    return f"{text} RLIKE {literal(r.pattern)}" + (f" AND NOT {text} RLIKE {literal(r.exclude)}" if r.exclude else "")


def _made(text: str, r: Rule, first: str = "", matched: bool = True) -> str:
    found = f", 'matched', regexp_extract({text}, {literal(r.pattern)}, 0)" if matched else ""
    return f"named_struct({first}'check_id', {literal(r.check_id)}, 'severity', {literal(r.severity)}, 'name', {literal(r.name)}{found})"


def rows_of(df: DataFrame, keep: list[str], found: Column, needed: str) -> DataFrame:
    """``keep`` and the fields of each struct of an array.

    An outer generator and a filter after it: for an inner one the array would be made twice, once for a
    filter on its size that goes before everything else.
    """
    return df.select(*keep, F.inline_outer(found)).where(F.col(needed).isNotNull())


def each_of(df: DataFrame, keep: list, found: Column, name: str) -> DataFrame:
    """``keep`` and each element of an array that holds no null; the array is made once, as in ``rows_of``."""
    return df.select(*keep, F.explode_outer(found).alias(name)).where(F.col(name).isNotNull())


def marked(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """The rows that some rule may match, with a mark for each rule."""
    return df.withColumn(MARKS, made(df, text, [r.pattern for r in rules])).where(F.array_contains(MARKS, True))


def scan(df: DataFrame, text: str, rules: list[Rule], keep: list[str], path: str | None = None, matched: bool = True) -> DataFrame:
    """One row for each rule that matches a row's text: ``keep``, check_id, severity, name and, if asked for, matched.

    All rules are one expression, written as text: a hundred rules are planned at once. Where no match is
    asked for, a hit is searched for once.
    """
    each = ", ".join(f"CASE WHEN {f't.path RLIKE {literal(r.path)} AND ' if r.path and path else ''}t.may[{i}] AND {_is_hit('t.own', r)} THEN {_made('t.own', r, matched=matched)} END" for i, r in enumerate(rules))
    # the lambda's variable holds the columns, which may be expressions, so that they are made once
    held = f"named_struct('may', `{MARKS}`, 'own', `{text}`, 'path', {f'`{path}`' if path else 'NULL'})"
    return rows_of(marked(df, text, rules), keep, F.expr(f"transform(array({held}), t -> filter(array({each}), x -> x IS NOT NULL))[0]"), "check_id")


def line_hits(df: DataFrame, text: str, rules: list[Rule], keep: list[str], path: str | None = None) -> DataFrame:
    """``scan`` of lines: ``keep``, line_no (from 1), check_id, severity, name, matched.

    A rule whose literals stand nowhere in a text costs one search of it; of the other rules' lines
    only hits become rows, so no text is taken apart into rows.
    """
    none = "cast(array() AS array<struct<line_no:int,check_id:string,severity:string,name:string,matched:string>>)"
    lines_ = f"transform(split(`{text}`, '\\n', -1), l -> CASE WHEN endswith(l, '\\r') THEN substring(l, 1, length(l) - 1) ELSE l END)"
    first = "'line_no', i + 1, "
    each = ", ".join(
        f"CASE WHEN {f't.path RLIKE {literal(r.path)} AND ' if r.path and path else ''}t.may[{i}] THEN filter(transform(t.rows, (line, i) -> CASE WHEN {_is_hit('line', r)} THEN {_made('line', r, first)} END), x -> x IS NOT NULL) ELSE {none} END" for i, r in enumerate(rules)
    )
    return rows_of(marked(df, text, rules), keep, F.expr(f"transform(array(named_struct('may', `{MARKS}`, 'rows', {lines_}, 'path', {f'`{path}`' if path else 'NULL'})), t -> flatten(array({each})))[0]"), "check_id")


def line_array(text: Column) -> Column:
    """The lines of a text, without the carriage return of a CRLF ending."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, line_no (from 1) and line, without the carriage return of a CRLF ending.

    Long texts make many rows in one task only while these are streamed on; nothing is gathered.
    """
    each = df.select(*keep, F.posexplode_outer(F.split(text, "\n", -1)).alias("pos", "line")).where(F.col("pos").isNotNull())
    return each.select(*keep, (F.col("pos") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_lines(source: str, keep: str, text: str = "content") -> str:
    """SQL of ``lines`` over a relation."""
    return f"SELECT {keep}, unnest(generate_series(1, len(string_split({text}, chr(10)))))::INT AS line_no, regexp_replace(unnest(string_split({text}, chr(10))), '\\r$', '') AS line FROM {source}"


def sql_scan(source: str, text: str, rules: list[Rule], keep: str) -> str:
    """SQL of ``scan``: one branch for each rule."""
    parts = []
    for r in rules:
        excuse = f" AND NOT regexp_matches({text}, {quoted(r.exclude)})" if r.exclude else ""
        excuse += f" AND regexp_matches(path, {quoted(r.path)})" if r.path else ""
        parts.append(f"SELECT {keep}, {quoted(r.check_id)} AS check_id, {quoted(r.severity)} AS severity, {quoted(r.name)} AS name, regexp_extract({text}, {quoted(r.pattern)}, 0) AS matched FROM {source} WHERE regexp_matches({text}, {quoted(r.pattern)}){excuse}")
    return "\nUNION ALL ".join(parts)
