"""The named queries of the engine and their ANSI-SQL equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query fn(t, spark), where t(name) reads a table, with its SQL."""

    def add(fn):
        def run(spark, sf_dir, fn=fn):
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


from . import extraction_queries, layout_queries, relational_queries, text_queries  # noqa: E402, F401
