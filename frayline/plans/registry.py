"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from frayline.plans.oracle_views import with_views
from frayline.sources.corpus import Corpus


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Corpus], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Corpus(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register ``f(corpus) -> DataFrame`` under its own name; ``covers`` lists inventory ids."""

    def wrap(fn: Callable[[Corpus], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = Query(key, covers, fn, with_views(sql) if sql else None)
        return fn

    return wrap
