"""How modules register queries with their SQL."""

from __future__ import annotations

from tessera.sources import views as V


def registrar(queries: dict, oracles: dict):
    """A decorator factory: ``query(name, sql)`` puts a function into ``queries``, and its SQL on top of the views into ``oracles``."""

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                oracles[name] = V.sql(sql)
            return f

        return add

    return query
