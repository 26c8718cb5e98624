"""The registered queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that must give the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register
