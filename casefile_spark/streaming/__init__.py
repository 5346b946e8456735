from . import budgets, ingest, runs

__all__ = ["budgets", "ingest", "runs"]
