"""Running sums and top rows of lanes of any size, without a lane in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _range(rows: DataFrame, order: str, ranges: int) -> Column:
    """The number of a row's range by a numeric column: the bounds are quantiles, so ranges are about equal."""
    marks = sorted(set(rows.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    return F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col(order))) if marks else F.lit(0)


def running(rows: DataFrame, lane: list[str], order: str, value: Column, name: str, ties: tuple[str, ...] = (), descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of their lane up to and with them, by ``order`` and ``ties``.

    Each lane is cut into ranges of ``order``: sums run inside a range, and sums of
    whole ranges, of which a lane has ``ranges`` at most, are added.
    """
    cut = rows.withColumn("_range", _range(rows, order, ranges)).withColumn("_value", value)
    sign = F.desc if descending else F.asc
    inside = Window.partitionBy(*lane, "_range").orderBy(sign(order), *ties)
    sums = cut.groupBy(*[F.col(c).alias(f"_lane{i}") for i, c in enumerate(lane)], F.col("_range").alias("_of")).agg(F.sum("_value").alias("_sum"))
    lanes = [f"_lane{i}" for i in range(len(lane))]
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*lanes).orderBy(sign("_of")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    same = F.col("_range") == F.col("_of")
    for c, k in zip(lane, lanes):
        same &= F.col(c).eqNullSafe(F.col(k))
    met = cut.withColumn("_inside", F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(before, same)
    return met.withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_value", "_inside", "_before", "_of", *lanes)


def last_rows(rows: DataFrame, lane: list[str], order: str, k: int, salts: int = RANGES) -> DataFrame:
    """The ``k`` rows of each lane with the largest ``order``: first of each of ``salts`` parts of a lane, then of these."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = F.row_number().over(Window.partitionBy(*lane, "_salt").orderBy(F.desc(order)))
    whole = F.row_number().over(Window.partitionBy(*lane).orderBy(F.desc(order)))
    return salted.withColumn("_r", part).where(F.col("_r") <= k).withColumn("_r", whole).where(F.col("_r") <= k).drop("_r", "_salt")
