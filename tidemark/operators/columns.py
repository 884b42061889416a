"""Column builders that the research operators share: null-safe arithmetic, panel windows, cross-sectional ranks.

Windows run over the dense spine: `by_time` is one security's rows in calendar
order, `by_date` one date's securities. A missing value is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    return Window.partitionBy("ticker").orderBy("t")


def by_date():
    return Window.partitionBy("t")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: str | Column, b: str | Column) -> Column:
    """a / b; NULL where b is 0 or either is NULL."""
    return F.try_divide(col(a), col(b))


def finite(x: str | Column) -> Column:
    """NULL for NaN and infinities."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def back(n: int):
    """The last n rows of a security, this one included."""
    return by_time().rowsBetween(-(n - 1), 0)


def rolling(agg, x: str | Column, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, NULL with fewer than `least` (n) values."""
    x, w = col(x), back(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def rolling_median(x: str | Column, n: int, least: int | None = None) -> Column:
    """Median over the last n rows. Percentiles take no frame, so the frame's values are collected (at most n) and sorted."""
    v = F.array_sort(F.collect_list(col(x)).over(back(n)))
    k = F.size(v)
    mid = (F.element_at(v, F.greatest(F.floor((k + 1) / 2), F.lit(1)).cast("int")) + F.element_at(v, F.greatest(F.ceil((k + 1) / 2), F.lit(1)).cast("int"))) / 2
    return F.when(k >= max(1, n if least is None else least), mid)


def ffill(x: str | Column) -> Column:
    return F.last(col(x), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def pct_rank(x: str | Column, among: str | Column | None = None, partition: tuple[str, ...] = ("t",)) -> Column:
    """Average rank of ties over the number of values, among the rows where `among` holds; NULL elsewhere."""
    v = col(x) if among is None else F.when(col(among), col(x))
    keys = [F.col(k) for k in partition]
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(v.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), (rank + (ties - 1) / 2) / F.count(v).over(Window.partitionBy(*keys)))


def xs_norm(x: str | Column, among: str | Column | None = None) -> Column:
    """Rank mapped to mean 0 and variance 1."""
    return (pct_rank(x, among) - 0.5) * 12**0.5


def weights(x: str | Column, partition: tuple[str, ...] = ("t",)) -> Column:
    """x over its sum in the cross-section; 0 where the sum is 0."""
    x = F.coalesce(col(x), F.lit(0.0))
    return F.coalesce(div(x, F.sum(x).over(Window.partitionBy(*partition))), F.lit(0.0))


def run_length(df: DataFrame, flag: str, name: str, key: str = "ticker", order: str = "t") -> DataFrame:
    """df with the length of the run of true flags that ends in each row; 0 where the flag is not true."""
    w = Window.partitionBy(key).orderBy(order)
    on = F.coalesce(F.col(flag), F.lit(False))
    df = df.withColumn("_reset", F.sum(F.when(on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.when(on, 1).otherwise(0)).over(Window.partitionBy(key, "_reset").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, n).drop("_reset")


def compound(x: str | Column) -> Column:
    """Aggregate: product of (1 + x) - 1; right also where x is -1."""
    return F.product(1 + col(x)) - 1


def half_even(x: str | Column) -> Column:
    """Round to whole numbers, halves to even."""
    return F.bround(col(x), 0)


def stacked(df: DataFrame, key: str, value: str, parts: dict[str, Column], *keep: str) -> DataFrame:
    """keep, key, value: one row for each of the named parts of every row. The parts are computed side by side, in one window stage."""
    names = list(parts)
    wide = df.select(*keep, *(parts[n].cast("double").alias(f"_{i}") for i, n in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(n).alias(key), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)))
    return wide.select(*keep, F.explode(rows).alias("_x")).select(*keep, f"_x.{key}", f"_x.{value}")
