"""Panel builders for stored market data: daily coins, listed securities with windows, intraday grids, fundamentals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import joins
from ..operators.execution import listing_windows
from ..operators.panel import Panel
from .bars import aggregate_bars, bar_minutes, funding_to_bars, next_day_eligibility


def coin_panel(bars: DataFrame, *, top_n: int | None = 50, min_age: int = 60, turnover_window: int = 30, exclude: list[str] | None = None, survivors_only: bool = False, market: str | None = None, **scalars) -> Panel:
    """From daily bars (date, ticker, open, high, low, close, volume, quote_volume): frozen zero-volume bars go, the calendar is dense,
    eligible are the top_n by trailing median turnover among names of min_age bars; the last real bar of an ended name is flagged.
    survivors_only keeps names that trade on the last day (for comparison, a biased sample). char_dollar_vol, and with market (a ticker) char_beta over 60 bars, at least 40."""
    live = bars.where("volume > 0")
    if exclude:
        live = live.where(~F.col("ticker").isin(exclude))
    days = live.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))
    days = days.withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))
    df = days.crossJoin(live.select("ticker").distinct()).join(live, ["date", "ticker"], "left")
    df = df.withColumn("_age", F.count("close").over(C.by_time())).withColumn("_m", C.rolling_median("quote_volume", turnover_window, max(1, turnover_window // 2)))
    ok = F.col("close").isNotNull() & (F.col("_age") >= min_age) & F.col("_m").isNotNull()
    if top_n:
        r = F.row_number().over(Window.partitionBy("t").orderBy(F.desc_nulls_last(F.when(ok, F.col("_m"))), "ticker"))
        df = df.withColumn("_r", r)
        ok &= F.col("_r") <= top_n
    end, last = F.max("t").over(Window.partitionBy()), F.max(F.when(F.col("close").isNotNull(), F.col("t"))).over(Window.partitionBy("ticker"))
    df = df.withColumn("eligible", ok).withColumn("delist_after", (F.col("t") == last) & (last < end)).withColumn("char_dollar_vol", F.when(F.col("_m") > 0, F.ln("_m")))
    if market is not None:
        r = F.col("_ret")
        df = df.withColumn("_ret", C.div("close", F.lag("close").over(C.by_time())) - 1)
        df = df.join(F.broadcast(df.where(F.col("ticker") == market).select("t", F.col("_ret").alias("_mkt"))), "t", "left")
        w = C.back(60)
        df = df.withColumn("char_beta", F.when(F.count(r * F.col("_mkt")).over(w) >= 40, C.div(F.covar_samp("_ret", "_mkt").over(w), F.var_samp("_mkt").over(w)))).drop("_ret", "_mkt")
    if survivors_only:
        alive = df.groupBy("ticker").agg(F.max(F.when(F.col("close").isNotNull(), F.col("t"))).alias("_l")).crossJoin(F.broadcast(df.agg(F.max("t").alias("_e")))).where("_l = _e").select("ticker")
        df = df.join(alive, "ticker", "left_semi")
    return Panel(df.drop("_age", "_m", "_r"), **({"market": "COIN", "periods_per_year": 365} | scalars))


def listed_panel(bars: DataFrame, master: DataFrame, *, least_bars: int = 100, min_age: int = 60, min_value: float | None = None, min_price: float | None = None, **scalars) -> Panel:
    """From end-of-day bars (date, ticker, close and adj_close where there are adjusted prices) and a master (ticker, start, stop): bars outside the listing go; calendar days need least_bars bars. With adj_close returns come from it, raw_close keeps the price that min_price and traded value are judged by."""
    inside = listing_windows(bars, master)
    if "adj_close" in bars.columns:
        scale = C.div("adj_close", "close")
        inside = inside.withColumn("raw_close", F.col("close")).withColumn("_scale", scale).withColumn("close", F.col("adj_close")).drop("adj_close")
        for c in ("open", "high", "low"):
            if c in bars.columns:
                inside = inside.withColumn(c, F.col(c) * F.col("_scale"))
        inside = inside.drop("_scale")
    price = F.col("raw_close") if "adj_close" in bars.columns else F.col("close")
    days = inside.groupBy("date").count().where(F.col("count") >= least_bars).select("date")
    inside = inside.join(days, "date", "left_semi")
    df = joins.align(joins.spine(inside), inside).join(master.select("ticker", F.col("stop").alias("_stop")), "ticker", "left")
    ok = F.col("close").isNotNull() & (F.count("close").over(C.by_time()) >= min_age)
    if min_value is not None:
        ok &= F.coalesce(C.rolling_median(price * F.col("volume"), 30) >= min_value, F.lit(False))
    if min_price is not None:
        ok &= F.coalesce(price >= min_price, F.lit(False))
    last = F.max(F.when(F.col("close").isNotNull(), F.col("t"))).over(Window.partitionBy("ticker"))
    df = df.withColumn("eligible", ok).withColumn("delist_after", F.col("_stop").isNotNull() & (F.col("t") == last) & (last < F.max("t").over(Window.partitionBy())))
    return Panel(df.drop("_stop"), **scalars)


def intraday_panel(bars: DataFrame, daily: DataFrame, funding: DataFrame | None = None, **scalars) -> Panel:
    """From bars (symbol, bar_end, close, volume, ...): each symbol's terminal bars without volume go; eligible by the day before; funding (symbol, bar_end, rate) on its bar."""
    end = bars.where("volume > 0").groupBy("symbol").agg(F.max("bar_end").alias("_e"))
    live = next_day_eligibility(daily, bars.join(end, "symbol").where("bar_end <= _e").drop("_e"))
    x = live.withColumnRenamed("symbol", "ticker").withColumnRenamed("bar_end", "date")
    df = joins.align(joins.spine(x), x).withColumn("eligible", F.coalesce("eligible", F.lit(False)) & F.col("close").isNotNull())
    if funding is not None:
        f = funding.select(F.col("symbol").alias("ticker"), F.col("bar_end").alias("date"), F.col("rate").alias("funding"))
        df = df.join(f, ["ticker", "date"], "left").withColumn("funding", F.coalesce("funding", F.lit(0.0)))
    return Panel(df, **({"market": "COIN"} | scalars))


def minute_panel(
    minutes: DataFrame, start, end, *, bar: str = "5m", adv_window: int = 30, min_age_days: int = 60, min_value: float = 5e6, top_n: int | None = None, settlements: DataFrame | None = None, entry_lag: int = 1, ended_days: int = 3,
) -> Panel:
    """A panel of bars over [start, end] (dates) from one-minute rows (symbol, ts, open .. volume, quote_volume) that reach back over the warm-up days.

    Bars stand on a dense grid labelled by their end. The tail without turnover at the end of a symbol goes; flat bars before it stay. Each day's
    bars are eligible by the days before alone: traded days, trailing median turnover over adv_window days, and its rank. A symbol whose last bar is
    more than ended_days before the end is flagged. Funding settlements (symbol, ts, rate) fall on the first bar that ends at or after them.
    """
    if entry_lag < 1:
        raise ValueError("a bar's close is known at its end: entry_lag must be at least 1")
    m = bar_minutes(bar)
    bars = aggregate_bars(minutes, bar)
    tail = bars.where("quote_volume > 0").groupBy("symbol").agg(F.max("bar_end").alias("_l"))
    bars = bars.join(tail, "symbol").where("bar_end <= _l").drop("_l")
    day = F.to_date(F.col("bar_end") - F.expr("INTERVAL 1 MINUTE"))
    turnover = bars.groupBy("symbol", day.alias("day")).agg(F.sum("quote_volume").alias("q"))
    span = turnover.agg(F.min("day").alias("a"), F.greatest(F.max("day"), F.lit(end).cast("date")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.partitionBy("symbol").orderBy("day")
    daily = span.crossJoin(turnover.select("symbol").distinct()).join(turnover, ["symbol", "day"], "left").withColumn("q", F.when(F.col("q") > 0, F.col("q"))).withColumn("age", F.count("q").over(w))
    recent = F.array_sort(F.collect_list("q").over(w.rowsBetween(-(adv_window - 1), 0)))
    middle = (F.get(recent, F.lit((adv_window - 1) // 2)) + F.get(recent, F.lit(adv_window // 2))) / 2
    daily = daily.withColumn("adv", F.when(F.size(recent) == adv_window, middle))
    ok = (F.col("age") >= min_age_days) & F.coalesce(F.col("adv") >= min_value, F.lit(False))
    if top_n:
        daily = daily.withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc_nulls_last(F.when(ok, F.col("adv"))), "symbol")))
        ok = ok & (F.col("_r") <= top_n)
    spark = minutes.sparkSession
    first = F.timestamp_add("MINUTE", F.lit(m), F.lit(start).cast("date").cast("timestamp"))
    grid = spark.range(1).select(F.explode(F.sequence(first, F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"), F.expr(f"INTERVAL {m} MINUTES"))).alias("bar_end"))
    grid = grid.withColumn("t", (F.row_number().over(Window.orderBy("bar_end")) - 1).cast("int"))
    df = grid.crossJoin(bars.select("symbol").distinct()).join(bars, ["symbol", "bar_end"], "left")
    df = next_day_eligibility(daily.select("symbol", "day", ok.alias("ok")), df).withColumn("eligible", F.col("eligible") & F.col("close").isNotNull())
    last = F.max(F.when(F.col("close").isNotNull(), F.col("bar_end"))).over(Window.partitionBy("symbol"))
    stop = F.max("bar_end").over(Window.partitionBy())
    df = df.withColumn("delist_after", F.coalesce((F.col("bar_end") == last) & (last < stop - F.expr(f"INTERVAL {ended_days} DAYS")), F.lit(False)))
    if settlements is not None:
        paid = funding_to_bars(settlements, m)
        df = df.join(paid.withColumnRenamed("rate", "funding"), ["symbol", "bar_end"], "left").withColumn("funding", F.coalesce("funding", F.lit(0.0)))
    df = df.withColumn("volume", C.div("quote_volume", "close")).withColumnRenamed("symbol", "ticker").withColumnRenamed("bar_end", "date")
    return Panel(df, market="COIN-INTRADAY", entry_lag=entry_lag, periods_per_year=365 * 1440 // m, meta={"bar": bar})


def sell_tax(cells: DataFrame, schedule: DataFrame) -> DataFrame:
    """cells (t, date, ticker, market) with rate: the market's last dated rate (effective_date, market, value); where the market is unknown, the day's highest."""
    days = cells.select("date").distinct().crossJoin(schedule.select("market").distinct())
    rates = joins.asof_backward(days, schedule.select(F.col("effective_date").alias("date"), "market", "value"), "date", ("market",), ("value",))
    worst = rates.groupBy("date").agg(F.max("value").alias("_w"))
    return cells.join(rates.withColumnRenamed("value", "rate"), ["date", "market"], "left").join(worst, "date", "left").withColumn("rate", F.coalesce("rate", "_w")).drop("_w")


def market_cap(cells: DataFrame, shares: DataFrame) -> DataFrame:
    """cells (date, ticker, close) with mkt_cap: close times the last share count (date, ticker, shares) known by then."""
    return joins.asof_backward(cells, shares, "date", ("ticker",), ("shares",)).withColumn("mkt_cap", F.col("close") * F.col("shares")).drop("shares")


def business_days_after(day: str | Column, n: int) -> Column:
    """The n-th weekday after a date (a date on a weekend counts as the Friday before)."""
    d = F.col(day) if isinstance(day, str) else day
    k = F.weekday(d)  # Monday is 0
    d, k = F.date_sub(d, F.greatest(k - 4, F.lit(0))), F.least(k, F.lit(4))
    return F.date_add(d, (F.lit(n) + 2 * F.floor((k + n) / 5)).cast("int"))


def filings(quarterly: DataFrame, annual: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """ticker, date and names from quarterly rows, and from annual ones where a quarter's value is missing."""
    q, a = (x.select("ticker", "date", *names) for x in (quarterly, annual))
    both = q.join(a.select("ticker", "date", *(F.col(n).alias(f"_{n}") for n in names)), ["ticker", "date"], "full")
    return both.select("ticker", "date", *(F.coalesce(n, f"_{n}").alias(n) for n in names))


def characteristics(cells: DataFrame, filed: DataFrame, names: tuple[str, ...], lag: int = 45, coverage: float = 0.3) -> DataFrame:
    """cells with char_*: each filing's values from `lag` business days after its date on; characteristics known in less than `coverage` of the cells are left out."""
    late = filed.withColumn("date", business_days_after("date", lag))
    df = joins.asof_backward(cells, late, "date", ("ticker",), names)
    share = df.agg(*(F.avg(F.col(n).isNotNull().cast("double")).alias(n) for n in names)).first()
    keep = [n for n in names if (share[n] or 0) >= coverage]
    return df.select(*cells.columns, *(F.col(n).alias(f"char_{n}") for n in keep))


def draw_order(tickers: DataFrame, seed: int) -> DataFrame:
    """ticker, place: a fixed random order; every beginning of it is a random sample."""
    order = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "ticker"), "ticker"))
    return tickers.select("ticker").distinct().withColumn("place", order.cast("long"))


def plain_tickers(frame: DataFrame) -> DataFrame:
    """Rows whose ticker is one to five capital letters."""
    return frame.where(F.col("ticker").rlike("^[A-Z]{1,5}$"))


def liquidity_cost_bp(taker_fee_bp: float = 5.0, half_spread_bp: float = 2.0, window: int = 30, thin: float | None = None, thin_extra_bp: float = 10.0, tick: str | None = None, spread: str = "fixed") -> Column:
    """One-way cost of a cell: fee, half spread (at least half a tick of the price, where ticks are known), and more where trailing turnover is thin or unknown. spread: fixed, or corwin_schultz: half the trailing median of the column cs (`costs.corwin_schultz`), at least the fixed one."""
    if spread not in ("fixed", "corwin_schultz"):
        raise ValueError("spread is fixed or corwin_schultz")
    fixed = F.lit(half_spread_bp)
    estimate = C.rolling_median("cs", window, max(1, window // 2)) / 2 * 1e4
    spread = F.greatest(fixed, estimate) if spread == "corwin_schultz" else fixed
    if tick:
        spread = F.greatest(spread, C.div(F.col(tick) / 2, "close") * 1e4)
    cost = F.lit(taker_fee_bp) + spread
    if thin is not None:
        value = C.rolling_median(F.col("close") * F.col("volume"), window, max(1, window // 2))
        cost = cost + F.when(F.coalesce(value < thin, F.lit(True)), thin_extra_bp).otherwise(0.0)
    return cost
