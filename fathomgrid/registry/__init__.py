"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from fathomgrid.registry import catalog, graphs, integrity, scalars, search, shapes, streams, texts

MODULES = [search, texts, shapes, catalog, graphs, integrity, scalars, streams]


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
