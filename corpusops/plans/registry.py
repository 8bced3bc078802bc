"""Collects queries (spark, sf_dir) -> DataFrame written over Inputs."""

from __future__ import annotations

from .fixtures import Inputs


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return f

        return add
