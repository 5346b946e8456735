"""All registered queries and their SQL, by key."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

MODULES = ("retrieval_queries", "ledger_queries", "corpus_queries", "answer_queries", "case_queries", "stream_queries")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f".{module}", __package__), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def _in_utc(query):
    @wraps(query)
    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run


def queries() -> dict:
    return {name: _in_utc(query) for name, query in _collect("QUERIES").items()}


def oracle_sql() -> dict:
    return _collect("SQL")
