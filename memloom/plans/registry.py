"""How modules of queries register them: a query under its function's name, with its SQL if there is any."""

from __future__ import annotations


def registry():
    """(QUERIES, SQL, query): two tables and the decorator that fills them."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
