"""Joins of the panel model: dense spine, label alignment, as-of in both directions, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(bars: DataFrame) -> DataFrame:
    """t (from 0), date: one row for each date of bars. The window has one row per date."""
    return bars.select("date").distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int")).select("t", "date")


def spine(bars: DataFrame) -> DataFrame:
    """Every date with every security: t, date, ticker."""
    return calendar(bars).crossJoin(bars.select("ticker").distinct())


def align(panel: DataFrame, x: DataFrame, on: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """x's columns beside the panel's rows; NULL where x has no row."""
    return panel.join(x, list(on), "left")


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: tuple[str, ...], values: tuple[str, ...], strict: bool = False) -> DataFrame:
    """For each row of left, the values of right's last row at or before it (before it, if strict).

    Both sides are united and the last value is carried forward within `by`:
    one shuffle on `by`, no range comparison of pairs.
    """
    l = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_own", F.lit(True))
    r = right.select(*by, on, F.struct(*values).alias("_v")).withColumn("_side", F.lit(1 if strict else 0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = w.orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_own")
    return out.select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))


def asof_forward(left: DataFrame, right: DataFrame, on: str, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """For each row of left, the values of right's first row at or after it."""
    l = left.withColumn("_side", F.lit(0)).withColumn("_own", F.lit(True))
    r = right.select(*by, on, F.struct(*values).alias("_v")).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(0, Window.unboundedFollowing)
    out = l.unionByName(r, allowMissingColumns=True).withColumn("_v", F.first("_v", ignorenulls=True).over(w)).where("_own")
    return out.select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))


def in_ranges(left: DataFrame, at: str, ranges: DataFrame, start: str, stop: str, by: str, how: str = "inner") -> DataFrame:
    """left rows whose `at` lies in a range [start, stop] of the same `by`; a NULL stop is open. An equi-join on `by`, then a filter."""
    r = ranges.select(*(F.col(c).alias(f"_{c}") for c in ranges.columns))
    hit = (F.col(by) == F.col(f"_{by}")) & (F.col(at) >= F.col(f"_{start}")) & (F.col(f"_{stop}").isNull() | (F.col(at) <= F.col(f"_{stop}")))
    return left.join(r, hit, how)
