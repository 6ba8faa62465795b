"""Registered queries and their SQL counterparts. Names begin with the inventory id that they cover."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..session import ship
from . import book_queries, corpus_queries, edit_queries, import_queries, layout_queries, markdown_queries, node_queries, translation_queries

_ALL = {**book_queries.ALL, **corpus_queries.ALL, **layout_queries.ALL, **edit_queries.ALL, **import_queries.ALL, **markdown_queries.ALL, **node_queries.ALL, **translation_queries.ALL}


def _shipping(f: Callable) -> Callable:
    @wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    return {name: _shipping(f) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Without those whose outcome SQL can't express: an injected function, probing folds and prose repair."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
