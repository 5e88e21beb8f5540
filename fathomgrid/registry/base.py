"""A list of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Named:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return add
