"""The catalogue of queries and of their SQL."""

from __future__ import annotations

from glosswork.plans import extra, forms, kept, learner, linked, more, relational, texts, validate, words

PARTS = (learner, words, relational, texts, more, linked, kept, extra, forms, validate)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
