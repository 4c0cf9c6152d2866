"""Registers queries with their SQL twins."""

from __future__ import annotations

from siltstone.sources.views import sql as with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            if name in self.queries:
                raise ValueError(name)
            self.queries[name] = f
            if sql:
                self.oracles[name] = with_views(sql)
            return f

        return put
