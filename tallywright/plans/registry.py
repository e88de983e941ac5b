"""Registration of queries: a function of the views, and SQL that names the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import Views, with_views


class Registry:
    def __init__(self):
        self.queries, self.oracles, self.plain = {}, {}, {}  # plain: the SQL without the views in front

    def add(self, name: str, run: Callable[[Views], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: run(Views(spark, sf_dir))
        if sql:
            self.oracles[name], self.plain[name] = with_views(sql), sql
