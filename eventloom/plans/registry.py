"""Every registered query of the listing engine, with its SQL where there is one; and the stated cases, which read no
table and are tests only."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
#: Functions, rules and connectors on inputs whose results are stated: (query, SQL of the results) by name.
STATED: dict = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def state(name, sql):
    def add(fn):
        STATED[name] = (fn, sql)
        return fn

    return add


def _load():
    from . import connectors, feeds, gates, golden, listing, page_queries, records, scalars, texts, windows  # noqa: F401  they register themselves


def queries():
    _load()
    return QUERIES


def oracle_sql():
    _load()
    return ORACLES


def stated():
    _load()
    return STATED
