"""All registered queries of the retrieval engine, by operator id, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir)`` under ``name``; whole numbers come out as longs, as in SQL."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.select(*[F.col(f"`{f.name}`").cast("long") if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f"`{f.name}`") for f in df.schema])

        run.__name__, run.__doc__ = name, function.__doc__
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark questions over all documents."""
    return QUERIES["q00_hybrid_search"](spark, sf_dir)


from . import corpus_queries, search_queries, text_queries  # noqa: E402, F401  they register themselves
