"""Folds over append-only rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """The last row of each key: one partial aggregation, no sort."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("x")).select(*keys, "x.*")


def active_reading(log: DataFrame, keys: list[str], order: str, person: Column, *columns: str) -> DataFrame:
    """The reading that holds the seat: a person's last one, or else the machine's last."""
    rank = F.struct(person.cast("int"), F.col(order))
    return log.groupBy(*keys).agg(F.max_by(F.struct(order, *columns), rank).alias("x")).select(*keys, "x.*")


def guarded(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not withdrawn."""
    return rows.join(blocked.select(key).distinct(), key, "left_anti")
