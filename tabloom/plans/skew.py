"""Joins in which a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 10_000


def join_weighted(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Rows with the columns of a table that has one row per key and ``weight`` rows for it.

    Keys that hold more than 1 / ``HEAVY`` of all rows are at most ``HEAVY`` in number and are broadcast, so
    their rows stay where they are; only the others are shuffled.  Both sides are read twice and should be stored.
    """
    limit = (table.agg(F.sum(weight)).first()[0] or 0) / HEAVY
    heavy = F.broadcast(table.where(F.col(weight) > limit).drop(weight))
    light = table.where(F.col(weight) <= limit).drop(weight)
    rest = rows.join(heavy.select(*on), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light, on))
