"""Weekly panels from the transaction tables, and the same panels as SQL.

A security is a supplier (or a brand), a bar is a week: close is value over
quantity in whole cents, volume the quantity: sums of whole numbers, so that both
engines have the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import joins
from ..operators.panel import Panel, ret

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: str | Column, n: int = 8) -> Column:
    """Rounded, with -0 as 0."""
    return F.round(C.col(x), n) + F.lit(0.0)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    g = li.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"))  # as `joins.align` deals them: no second shuffle
    k = F.substring("ticker", 2, 20).cast("long")
    b = g.agg(
        (F.round(F.sum("l_extendedprice") * 100) / F.sum("l_quantity") / 100).alias("close"), F.sum("l_quantity").alias("volume"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.round(F.sum("l_discount") * 100) / F.count("l_discount") / 100).alias("char_disc"),
    )
    return b.select("ticker", "date", "close", "volume", "high", "low", (F.col("close") * (1000 + k)).alias("mkt_cap"), "char_disc")


def panel(spark: SparkSession, sf_dir: str) -> Panel:
    b = bars(spark, sf_dir)
    df = joins.align(joins.spine(b), b)
    df = df.withColumn("eligible", F.col("close").isNotNull() & (F.count("close").over(C.by_time()) >= 10))
    return Panel(df, market="SUP", entry_lag=1, periods_per_year=52)


def with_ret(p: Panel) -> DataFrame:
    return p.df.withColumn("ret1", ret(1))


PANEL = """
bars AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  round(sum(l_extendedprice) * 100) / sum(l_quantity) / 100 AS close, sum(l_quantity) AS volume,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  round(sum(l_discount) * 100) / count(l_discount) / 100 AS char_disc, l_suppkey AS k FROM lineitem GROUP BY l_suppkey, 2),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)),
sec AS (SELECT DISTINCT ticker FROM bars),
panel AS (SELECT t, cal.date, sec.ticker, close, volume, high, low, close * (1000 + k) AS mkt_cap, char_disc,
  close IS NOT NULL AND count(close) OVER (PARTITION BY sec.ticker ORDER BY t) >= 10 AS eligible,
  close / nullif(lag(close) OVER (PARTITION BY sec.ticker ORDER BY t), 0) - 1 AS ret1
  FROM cal CROSS JOIN sec LEFT JOIN bars ON bars.date = cal.date AND bars.ticker = sec.ticker)"""


def sql(body: str, more: str = "") -> str:
    """A statement over the panel; more: further CTEs."""
    return f"WITH {PANEL}{',' if more else ''} {more} {body}"


def rank_cte(name: str, source: str, factor: str, among: str = "eligible", partition: str = "t") -> str:
    """CTE with pr: the percentage rank of a factor expression."""
    return f"""{name}_v AS (SELECT *, CASE WHEN {among} THEN {factor} END AS v_ FROM {source}),
{name} AS (SELECT *, CASE WHEN v_ IS NOT NULL THEN (rank() OVER (PARTITION BY {partition} ORDER BY v_ NULLS LAST) + (count(*) OVER (PARTITION BY {partition}, v_) - 1) / 2.0::DOUBLE) / count(v_) OVER (PARTITION BY {partition}) END AS pr FROM {name}_v)"""


WT = "PARTITION BY ticker ORDER BY t"


def roll(agg: str, n: int, least: int | None = None, x: str | None = None) -> str:
    frame = f"OVER ({WT} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    inner = x or agg[agg.index("(") + 1 : -1]
    return f"CASE WHEN count({inner}) {frame} >= {n if least is None else least} THEN {agg} {frame} END"
