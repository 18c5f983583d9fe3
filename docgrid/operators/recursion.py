"""Recursive queries: what lies below what, to any depth, by Spark's recursive common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Levels that a recursion may have where its caller sets no bound of its own.
DEEPEST = 1000


def recursive(start: DataFrame, edges: DataFrame, on: str, deepest: int = DEEPEST, **step: str) -> DataFrame:
    """start, and again and again the rows that edges (e) make of the rows found in the round before (t), where `on` holds.

    step: for each column of start, its value in the next round, as an expression over e and t; columns without one are
    kept from t. Cycles must be ended by `on`, as by an array of what has been visited; beyond `deepest` rounds Spark
    raises RECURSION_LEVEL_LIMIT_EXCEEDED. Every action runs the recursion anew, so write what is used more than once.
    """
    columns = ", ".join(f"CAST({step.get(c, f't.`{c}`')} AS {kind}) AS `{c}`" for c, kind in start.dtypes)
    text = f"WITH RECURSIVE t MAX RECURSION LEVEL {deepest} AS (SELECT * FROM {{start}} UNION ALL SELECT {columns} FROM {{edges}} e JOIN t ON {on}) SELECT * FROM t LIMIT ALL"
    return start.sparkSession.sql(text, start=start, edges=edges)


def same(keys: list[str]) -> str:
    """The condition that t and e have equal keys, nulls included."""
    return " AND ".join(f"t.`{k}` <=> e.`{k}`" for k in keys) or "true"
