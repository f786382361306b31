"""Joins of many rows with facts about their key, where one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_facts(rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins many ``rows`` to ``facts`` with few rows per key, by one plan for all sizes.

    Spark sends ``facts`` to every task only below
    ``spark.sql.autoBroadcastJoinThreshold``. Beyond it both sides are sorted by
    key, and adaptive execution splits a hot key's rows over many tasks, each of
    which reads the few facts of that key (``spark.sql.adaptive.skewJoin``). That
    covers ``how`` of inner, left, left_semi and left_anti. Nothing is counted
    or collected beforehand.
    """
    return rows.join(facts, list(on), how)
