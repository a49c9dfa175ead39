"""A decorator that files a query and its oracle SQL under the function's name."""

from __future__ import annotations

from collections.abc import Callable

from orelink.sources.mart import with_tables


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_tables(sql)
            return f

        return put
