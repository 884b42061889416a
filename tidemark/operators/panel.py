"""The point-in-time panel: a long DataFrame, dense on dates and securities, with the few scalars that decide timing."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import columns as C
from . import joins

OPTIONAL = ("open", "high", "low", "volume", "mkt_cap", "funding", "delist_after", "shortable", "can_buy", "can_sell")


@dataclass(frozen=True)
class Panel:
    """df: t, date, ticker, close, eligible and any of OPTIONAL, char_*. A signal at close(t) is entered at close(t + entry_lag)."""

    df: DataFrame
    market: str = "KR"
    entry_lag: int = 1
    periods_per_year: int = 252
    meta: dict = field(default_factory=dict)

    @staticmethod
    def of(bars: DataFrame, **scalars) -> Panel:
        """From bars (date, ticker, close, eligible, ...): duplicates refused, prices cleaned, aligned to the dense spine."""
        twice = bars.groupBy("date", "ticker").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two bars of {twice[0]['ticker']} on {twice[0]['date']}")
        for name in ("close", "eligible"):
            if name not in bars.columns:
                raise KeyError(name)
        df = joins.align(joins.spine(bars), bars)
        for name in ("eligible", "delist_after", "shortable", "can_buy", "can_sell"):  # unknown is no permission
            if name in bars.columns:
                df = df.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
        p = Panel(clean_prices(df), **scalars)
        if p.entry_lag < 0:
            raise ValueError("entry_lag must not be negative")
        return p

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def validate(self, least: int = 10) -> None:
        """At least one eligible cell, and `least` eligible names on half of the dates that have any."""
        by = self.df.groupBy("t").agg(F.count_if("eligible").alias("n")).where("n > 0")
        days, thin = by.agg(F.count("*"), F.count_if(F.col("n") < least)).first()
        if not days:
            raise ValueError("no eligible cell")
        if thin * 2 > days:
            raise ValueError(f"fewer than {least} eligible names on {thin} of {days} dates")

    def check_periods(self) -> None:
        gap = self.df.select("date").distinct().withColumn("g", F.unix_timestamp(F.col("date").cast("timestamp")) - F.unix_timestamp(F.lag("date").over(Window.orderBy("date")).cast("timestamp")))
        g = gap.agg(F.median("g")).first()[0]
        if g and g >= 86400 and not 0.5 <= (365.25 * 86400 / g) / self.periods_per_year <= 2:
            warnings.warn(f"median gap of {g / 86400:.1f} days does not fit {self.periods_per_year} periods a year", stacklevel=2)

    def truncate(self, last) -> Panel:
        return self.with_df(self.df.where(F.col("date") <= F.lit(last)))

    def ret1(self) -> Column:
        return ret(1)

    def adv(self, window: int = 20) -> Column:
        return C.rolling(F.avg, F.col("close") * F.col("volume"), window)

    def forward(self, h: int, delist_return: float | None = None, single: bool = True) -> DataFrame:
        return forward(self, h, delist_return, single)

    def fingerprint(self) -> str:
        """16 hex digits that do not depend on the order of rows or partitions."""
        names = sorted(self.df.columns)
        row = self.df.select(F.xxhash64(*names).alias("a"), F.xxhash64(F.lit(1), *names).alias("b"))
        n, a, b = row.agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        import hashlib

        return hashlib.sha256(f"{names}|{n}|{a}|{b}|{self.market}|{self.entry_lag}|{self.periods_per_year}".encode()).hexdigest()[:16]

    def assert_causal(self, make: Callable[[Panel], DataFrame], dates: int = 3) -> None:
        """make(panel) (date, ticker, value) must not change on past dates when later rows are cut off."""
        whole = make(self).select("date", "ticker", F.col("value").alias("whole"))
        n = self.df.agg(F.max("t")).first()[0]
        for k in range(1, dates + 1):
            last = self.df.where(F.col("t") == n * k // (dates + 1)).select("date").first()[0]
            part = make(self.truncate(last)).select("date", "ticker", F.col("value").alias("part"))
            if not part.join(whole, ["date", "ticker"]).where("NOT (whole <=> part)").isEmpty():
                raise AssertionError(f"values up to {last} change with later data")


def clean_prices(df: DataFrame) -> DataFrame:
    """Prices <= 0 and infinite ones become NULL, but for the first zero after a security's last positive price: a final -100 % bar."""
    price = C.finite("close")
    positive = F.when(price > 0, F.col("t"))
    every = Window.partitionBy("ticker")
    df = df.withColumn("_last", F.max(positive).over(every)).withColumn("_zero", F.when((price == 0) & (F.col("t") > F.col("_last")), F.col("t")))
    keep = (price > 0) | (F.col("t") == F.min("_zero").over(every))
    return df.withColumn("close", F.when(keep, price)).drop("_last", "_zero")


def ret(n: int) -> Column:
    """n-row return without filling gaps."""
    return C.div("close", F.lag("close", n).over(C.by_time())) - 1


def forward(p: Panel, h: int, delist_return: float | None = None, single: bool = True) -> DataFrame:
    """df with fwd: close(t + lag + h) / close(t + lag) - 1. After a flagged last bar the price stays at its value times 1 + delist_return."""
    df, price = p.df, F.col("close")
    if delist_return is not None and p.has("delist_after"):
        gone = F.coalesce(F.max(F.col("delist_after").cast("int")).over(C.by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
        df = df.withColumn("_px", F.when(gone, C.ffill("close") * (1 + delist_return)).otherwise(price))
    else:
        df = df.withColumn("_px", price)
    a, b = F.lead("_px", p.entry_lag).over(C.by_time()), F.lead("_px", p.entry_lag + h).over(C.by_time())
    fwd = C.div(b, a) - 1
    return df.withColumn("fwd", fwd.cast("float").cast("double") if single else fwd).drop("_px")


def compounded(p: Panel, h: int) -> DataFrame:
    """df with cum: one-bar returns of the h bars after entry, compounded with missing as 0; NULL where the sample ends before."""
    df = p.df.withColumn("_r", F.coalesce(ret(1), F.lit(0.0)))
    w = C.by_time().rowsBetween(p.entry_lag + 1, p.entry_lag + h)
    return df.withColumn("cum", F.when(F.count("_r").over(w) == h, F.product(1 + F.col("_r")).over(w) - 1)).drop("_r")


def pit_eligible(listed: Column | None = None, min_value: float | None = None, excluded: Column | None = None, window: int = 20) -> Column:
    """Price there, listed, mean traded value of a full window at least min_value, not excluded."""
    ok = F.coalesce(F.col("close") > 0, F.lit(False))
    if listed is not None:
        ok &= F.coalesce(listed, F.lit(False))
    if min_value is not None:
        ok &= F.coalesce(C.rolling(F.avg, F.col("close") * F.col("volume"), window) >= min_value, F.lit(False))
    if excluded is not None:
        ok &= ~F.coalesce(excluded, F.lit(False))
    return ok


def check_alignment(p: Panel, x: DataFrame, what: str) -> None:
    """x (date, ticker) must share dates and tickers with the panel; a warning below half."""
    for key in ("date", "ticker"):
        mine = p.df.select(key).distinct()
        n, hit = mine.count(), mine.join(x.select(key).distinct(), key, "left_semi").count()
        if not hit:
            raise ValueError(f"{what} shares no {key} with the panel")
        if hit * 2 < n:
            warnings.warn(f"{what} has {hit} of {n} values of {key}", stacklevel=2)


def survivors_only(p: Panel, gap_days: int = 5) -> Panel:
    """Only securities whose last price is within gap_days of the last date."""
    last = p.df.agg(F.max("date").alias("end"))
    alive = p.df.where("close IS NOT NULL").groupBy("ticker").agg(F.max("date").alias("d")).crossJoin(F.broadcast(last)).where(F.datediff("end", "d") <= gap_days)
    return p.with_df(p.df.join(alive, "ticker", "left_semi"))


def audit(p: Panel) -> DataFrame:
    """One row: counts, share of extreme moves, market's worst day, deepest fall and annual return, spread of the names' volatility, gaps at the open against daily moves, coverage of the last 20 dates, share of names that end, and what these make suspect."""
    df = p.df.withColumn("_all", ret(1)).withColumn("_r", F.when(F.col("eligible"), F.col("_all")))
    end = df.agg(F.max("t").alias("end"), F.max("date").alias("last"), F.min("date").alias("first"))
    last = df.where("close IS NOT NULL").groupBy("ticker").agg(F.max("t").alias("l"), F.max("date").alias("d")).crossJoin(F.broadcast(end))
    gone = F.datediff("last", "d") > 30
    ended = last.agg(F.avg((F.col("l") < F.col("end")).cast("double")).alias("ended_share"), F.avg(gone.cast("double")).alias("ended_before_end_share"), F.count("*").alias("_names"), (F.max(F.datediff("last", "first")) / 365.25).alias("_years"))
    day = df.where("eligible").groupBy("t").agg(F.avg("_r").alias("m"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    eq = day.where("m IS NOT NULL").withColumn("e", F.product(1 + F.col("m")).over(w)).withColumn("dd", F.col("e") / F.max("e").over(w) - 1)
    market = eq.agg(F.min("m").alias("worst_market"), F.avg("m").alias("mean_market"), F.min("dd").alias("market_max_drawdown"), (F.pow(F.product(1 + F.col("m")), F.lit(float(p.periods_per_year)) / F.count("m")) - 1).alias("market_annual_return"))
    vol = df.groupBy("ticker").agg((F.stddev_samp("_r") * p.periods_per_year**0.5).alias("v")).where("v > 0").agg(F.percentile("v", 0.05).alias("volatility_p05"), F.percentile("v", 0.95).alias("volatility_p95"))
    cover = df.groupBy("t").agg(F.count("close").alias("k")).crossJoin(F.broadcast(end)).agg(F.avg(F.when(F.col("t") > F.col("end") - 20, F.col("k"))).alias("_tail"), F.percentile(F.when(F.col("t") <= F.col("end") - 20, F.col("k")), 0.5).alias("_body"), F.count("*").alias("_dates"))
    extreme = lambda c: F.avg((F.abs(c) > 0.3).cast("double"))
    gap = C.div("open", F.lag("close").over(C.by_time())) - 1 if p.has("open") else F.lit(None).cast("double")
    cells = df.withColumn("_gap", F.when(F.col("eligible"), gap)).agg(
        F.countDistinct("t").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct(F.when(F.col("eligible"), F.col("ticker"))).alias("n_ever_eligible"), F.count("close").alias("n_prices"), F.count_if("eligible").alias("n_eligible"),
        F.avg((F.abs("_all") > 0.5).cast("double")).alias("extreme_share"), F.percentile("_all", 0.05).alias("p05"), F.percentile("_all", 0.95).alias("p95"), extreme(F.col("_r")).alias("extreme_eligible"), extreme(F.col("_gap")).alias("extreme_gaps"),
    )
    out = cells.crossJoin(ended).crossJoin(market).crossJoin(vol).crossJoin(cover)
    ratio = F.col("extreme_gaps") / F.greatest("extreme_eligible", F.lit(1e-11))
    out = out.withColumn("gap_vs_daily", ratio).withColumn("tail_coverage", F.when(F.col("_dates") > 60, C.div("_tail", "_body"))).withColumn("truncation_suspected", F.coalesce(F.col("tail_coverage") < 0.5, F.lit(False)))
    return out.withColumn("survivorship_suspected", (F.col("_names") >= 30) & (F.col("_years") >= 3) & (F.col("ended_before_end_share") < 0.01)).drop("_names", "_years", "_tail", "_body", "_dates")


def eligible_by_year(p: Panel) -> DataFrame:
    """year, names: mean number of eligible names on its dates, and growth against the first year."""
    day = p.df.groupBy("t", "date").agg(F.count_if("eligible").alias("k"))
    y = day.groupBy(F.year("date").alias("year")).agg(F.avg("k").alias("names"))
    return y.withColumn("growth", C.div("names", F.first("names").over(Window.orderBy("year"))))
