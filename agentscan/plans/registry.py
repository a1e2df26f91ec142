"""Every registered query of the scanner, with its SQL where SQL can express it."""

from __future__ import annotations

from agentscan.operators import classifier, configs, events, evidence, governance, grants, harvest, hidden, leaves, ledger, names, pages, produced, profiles, prompts, scoring, secrets, static, store, structure, subjects, text

MODULES = (text, secrets, hidden, pages, events, profiles, configs, static, scoring, governance, prompts, evidence, structure, subjects, produced, leaves, store, harvest, names, grants, ledger, classifier)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.replace(scoring.EVERY, store.SQL_EVERY) for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
