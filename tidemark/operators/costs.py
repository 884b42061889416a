"""Spreads, turnover costs, rate schedules, borrow and market impact; holdings are long rows (t, ticker, h)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import columns as C
from . import joins


def roll_spread(df: DataFrame, price: str = "close", least: int = 30) -> DataFrame:
    """ticker, spread: twice the root of minus the covariance of neighbouring price changes; NULL where it is not negative."""
    d = df.where(F.col(price).isNotNull())
    w = Window.partitionBy("ticker").orderBy("t")
    d = d.withColumn("d", F.col(price) - F.lag(price).over(w)).withColumn("b", F.lag("d").over(w))
    c = d.groupBy("ticker").agg(F.covar_samp("d", "b").alias("c"), F.count(price).alias("n"))
    return c.select("ticker", F.when((F.col("n") >= least) & (F.col("c") < 0), 2 * F.sqrt(-F.col("c"))).alias("spread"))


def corwin_schultz(high: str = "high", low: str = "low") -> Column:
    """Spread from two bars' highs and lows, within 0 and 0.2."""
    w = C.by_time()
    h0, l0 = F.lag(high).over(w), F.lag(low).over(w)
    one = F.ln(C.div(high, low))
    beta = one * one + F.ln(C.div(h0, l0)) * F.ln(C.div(h0, l0))
    known = h0.isNotNull() & F.col(high).isNotNull()
    gamma = F.ln(C.div(F.greatest(h0, F.col(high)), F.least(l0, F.col(low))))
    k = 3 - 2 * 2**0.5
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma * gamma / k)
    s = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.when(known & s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(0.2)))


def fit_spread(df: DataFrame, value: str, spread_bp: str, least: int = 20) -> DataFrame:
    """a, b of ln(spread) = a + b ln(value)."""
    x = df.where((F.col(value) > 0) & (F.col(spread_bp) > 0)).select(F.ln(value).alias("x"), F.ln(spread_bp).alias("y"))
    return x.agg(F.when(F.count("*") >= least, F.regr_intercept("y", "x")).alias("a"), F.when(F.count("*") >= least, F.regr_slope("y", "x")).alias("b"))


def spread_bp(adv: str, a: float, b: float, measured: str | None = None, lo: float = 1.0, hi: float = 300.0) -> Column:
    s = F.exp(F.lit(a) + F.lit(b) * F.ln(F.when(F.col(adv) > 0, F.col(adv))))
    s = F.coalesce(F.col(measured), s) if measured else s
    return F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(lo)), F.lit(hi)))


def trades(h: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Holdings with d, the change of each position; the first row is the build and is not traded."""
    w = Window.partitionBy(*keys, "ticker").orderBy("t")
    return h.withColumn("d", F.coalesce(F.col("h") - F.lag("h").over(w), F.lit(0.0)))


def turnover(h: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return trades(h, keys).groupBy(*keys, "t").agg((F.sum(F.abs("d")) / 2).alias("turnover"))


def turnover_cost(h: DataFrame, bp: float | str) -> DataFrame:
    """t, cost. A number is a round trip, of which each unit traded pays half; a column is one way, its unknown cells the median."""
    d = trades(h)
    if isinstance(bp, str):
        middle = d.agg(F.median(bp).alias("_m"))
        rate = F.coalesce(F.col(bp), F.col("_m")) / 1e4
        d = d.crossJoin(F.broadcast(middle))
    else:
        rate = F.lit(bp / 2 / 1e4)
    return d.groupBy("t").agg(F.sum(F.abs("d") * rate).alias("cost"))


def side_cost(h: DataFrame, buy_bp: str, sell_bp: str) -> DataFrame:
    """t, cost: bought value times the buying rate and sold value times the selling rate."""
    return trades(h).groupBy("t").agg((F.sum(F.greatest("d", F.lit(0.0)) * F.col(buy_bp)) / 1e4 + F.sum(F.greatest(-F.col("d"), F.lit(0.0)) * F.col(sell_bp)) / 1e4).alias("cost"))


def borrow_cost(h: DataFrame, fee_bp: str, periods: int) -> DataFrame:
    """t, cost, unknown: fee on the value held short; unknown counts short positions without fee, which a caller has to refuse."""
    short = F.greatest(-F.col("h"), F.lit(0.0))
    return h.groupBy("t").agg((F.sum(short * F.coalesce(F.col(fee_bp), F.lit(0.0))) / 1e4 / periods).alias("cost"), F.count_if((F.col("h") < 0) & F.col(fee_bp).isNull()).alias("unknown"))


def rate_schedule(dates: DataFrame, entries: DataFrame) -> DataFrame:
    """dates with the value of the last entry (effective_date, value) at or before each; dates before the first entry are refused."""
    out = joins.asof_backward(dates, entries.select(F.col("effective_date").alias("date"), "value"), "date", (), ("value",))
    return out.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.lit("a date before the first entry of the schedule"))).otherwise(F.col("value")))


@dataclass(frozen=True)
class ImpactModel:
    """Square-root impact: y * volatility * sqrt(traded value / daily value), at most max_cost_bp; unknown is the most."""

    aum: float
    y: float = 1.0
    vol_window: int = 20
    adv_window: int = 30
    max_cost_bp: float = 100.0

    def __post_init__(self):
        if min(self.aum, self.y, self.max_cost_bp) <= 0 or min(self.vol_window, self.adv_window) < 2:
            raise ValueError("impact parameters must be positive")

    def cost(self, df: DataFrame, h: DataFrame) -> DataFrame:
        """t, cost. df: panel rows with ret1, close, volume."""
        at = df.select(
            "t", "ticker", C.rolling(F.stddev_samp, "ret1", self.vol_window, self.vol_window // 2).alias("s"), C.rolling(F.avg, F.col("close") * F.col("volume"), self.adv_window).alias("adv")
        )
        d = trades(h).join(at, ["t", "ticker"], "left")
        size = F.abs("d")
        rate = F.least(self.y * F.col("s") * F.sqrt(C.div(size * self.aum, "adv")), F.lit(self.max_cost_bp / 1e4))
        rate = F.coalesce(F.when(F.col("s").isNotNull() & F.col("adv").isNotNull(), rate), F.lit(self.max_cost_bp / 1e4))
        return d.groupBy("t").agg(F.sum(F.when(size > 0, size * rate).otherwise(0.0)).alias("cost"))


def at_execution(rate: str, lag: int) -> Column:
    """A dated rate as of the execution day; the last rows repeat the last rate. Over rows ordered by t."""
    w = Window.orderBy("t")
    return F.coalesce(F.lead(rate, lag).over(w), F.last(rate).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
